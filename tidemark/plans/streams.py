"""Queries run as streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming.windows import day_dwell, gaps, read_stream, run_now, sessions, window_counts


def _stamp(c: str, name: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)


def stream_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day and type, as a stream in complete mode."""
    rows = window_counts(read_stream(spark, folder, "events"), "ts", ["event_type"], value="value")
    out = run_now(rows, "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_minute_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """A user's events of one minute, counted."""
    out = run_now(window_counts(read_stream(spark, folder, "events"), "ts", ["user_id"], "1 minute", value="value"), "complete")
    return out.select("user_id", _stamp("window_start", "minute"), "n", F.round("total", 4).alias("total"))


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions parted by pauses of more than 30 minutes."""
    out = run_now(sessions(read_stream(spark, folder, "events"), "ts", "user_id"), "complete")
    return out.select("user_id", _stamp("session_start", "session_start"), _stamp("session_end", "session_end"), "n")


def stream_day_dwell(spark: SparkSession, folder: str) -> DataFrame:
    out = run_now(day_dwell(read_stream(spark, folder, "events"), "ts", "user_id"), "complete")
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "span_minutes", "n")


def stream_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds since a user's last event, from a state of one time a user."""
    out = run_now(gaps(read_stream(spark, folder, "events"), "ts", "user_id"))
    return out.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.round("gap_s", 3).alias("gap_s"))


QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_minute_baskets, stream_sessions, stream_day_dwell, stream_gaps)}
_AT = "strftime({}, '%Y-%m-%d %H:%M:%S') AS {}".format
SQL = {
    "stream_daily_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_minute_baskets": f"SELECT user_id, {_AT("date_trunc('minute', ts)", 'minute')}, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id, date_trunc('minute', ts)",
    "stream_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) "
    f"SELECT user_id, {_AT('min(ts)', 'session_start')}, {_AT('max(ts)', 'session_end')}, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_day_dwell": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max(hour(ts) * 60 + minute(ts)) - min(hour(ts) * 60 + minute(ts)) AS span_minutes, count(*) AS n FROM events GROUP BY ALL",
    "stream_gaps": "SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6, 3) AS gap_s FROM events",
}
