"""Queries for sessions (p5) and entity tables (p6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import DAY_US, micros, shown
from tidemark.operators.entity_table import EntityStore, cumulative_table, entity_table
from tidemark.operators.sessions import sessionize
from tidemark.session import shared_folder
from tidemark.sources.tables import table

#: The parts of part_ref have the ids 1 to 137.
PART_IDS = list(range(1, 138))
PART_WINDOWS = (30,)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with at least two different lines."""
    s = sessionize(table(spark, folder, "train_transactions"), "custid", "sales_datetime", "line_id", min_lines=2)
    return s.select("custid", shown(micros("session_start")).alias("session_start"), shown(micros("session_end")).alias("session_end"))


def p5_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """All sessions with start, end, duration and counts."""
    s = sessionize(table(spark, folder, "train_transactions"), "custid", "sales_datetime", "line_id")
    return s.select(
        "custid",
        shown(micros("session_start")).alias("session_start"),
        shown(micros("session_end")).alias("session_end"),
        F.round("duration_s", 3).alias("duration_s"),
        "n_rows",
        "n_lines",
    )


def plain_name(name: str | Column) -> Column:
    """A typed name without case, white space and marks."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def _typed(sales: DataFrame, name: Column, names: DataFrame, *more: str) -> DataFrame:
    """Lines with the part that their ``name`` means; a value that isn't in ``names`` is part 0, none if blank."""
    rows = sales.select("line_id", "custid", "sales_datetime", "net_amt", *more, name.alias("nm"), F.when(F.trim("part_nm") != "", 0).alias("rest"))
    return rows.join(names, "nm", "left").withColumn("part_id", F.coalesce("part_id", "rest"))


def _now(sales: DataFrame) -> int:
    return sales.agg(F.max(micros("sales_datetime"))).first()[0] or 0


def part_features(sales: DataFrame, name: Column, names: DataFrame, part_ids: Sequence[int] = (0, *PART_IDS)) -> DataFrame:
    """One row per custid with lines, days since the last and net_amt of each part, over all time and the
    last 30 days, as of the last sale in the table. ``names`` (nm, part_id; each nm once) says which part a
    ``name`` means; values that aren't in it have columns of their own, ``_k0``; null and blank ones count
    only in the sums over all."""
    now = _now(sales)
    cum = cumulative_table(_typed(sales, name, names), "custid", "part_id", "sales_datetime", "net_amt", "line_id")
    return entity_table(cum, now // DAY_US, now, part_ids, PART_WINDOWS).withColumnRenamed("entity", "custid")


def _plain_names(spark: SparkSession, folder: str) -> DataFrame:
    # part_ref is fixed at 137 rows
    ref = table(spark, folder, "part_ref")
    names = ref.select("part_id", F.explode(F.array("part_nm", "part_nm_en")).alias("nm")).select(plain_name("nm").alias("nm"), "part_id")
    return F.broadcast(names.where("nm <> ''").groupBy("nm").agg(F.min("part_id").cast("int").alias("part_id")))


def p6_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of parts by their plain names: a part_nm counts for the part whose Korean or English
    name it is but for case, spacing and marks; any other text counts in the columns ``_k0``.
    ``p6_parts`` of the llm package has every spelling."""
    return part_features(table(spark, folder, "train_transactions"), plain_name("part_nm"), _plain_names(spark, folder))


def p6_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a stored table: what was loaded up to the middle of the loading times is one batch,
    the rest, with lines that come late or again, is added to it as another."""
    sales = table(spark, folder, "train_transactions")
    store, now = EntityStore(spark, shared_folder(spark, "entities")), _now(sales)
    rows = _typed(sales, plain_name("part_nm"), _plain_names(spark, folder), "loaded_at")
    low, high = sales.agg(F.min(micros("loaded_at")), F.max(micros("loaded_at"))).first()
    early = F.coalesce(micros("loaded_at") <= ((low or 0) + (high or 0)) // 2, F.lit(True))
    for batch, part in enumerate((rows.where(early), rows.where(~early))):
        store.append(batch, part, "custid", "part_id", "sales_datetime", "net_amt", "line_id")
    return entity_table(store.cumulative(), now // DAY_US, now, (0, *PART_IDS), PART_WINDOWS).withColumnRenamed("entity", "custid")


QUERIES = {"p5_found": p5_found, "p5_sessions": p5_sessions, "p6_features": p6_features, "p6_stored": p6_stored}

_SESSIONS = """
WITH r AS (SELECT custid, sales_datetime t, line_id FROM train_transactions WHERE custid IS NOT NULL AND sales_datetime IS NOT NULL),
g AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END b FROM r WINDOW w AS (PARTITION BY custid ORDER BY t)),
s AS (SELECT *, sum(b) OVER (PARTITION BY custid ORDER BY t) k FROM g)
SELECT custid, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS session_end"""


def _p6_sql() -> str:
    plain = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')".format
    since = "date_diff('microsecond', max(sales_datetime){}, (SELECT max(sales_datetime) FROM train_transactions)) / 86400000000.0 AS days_since{}".format
    recent = "sales_datetime >= (SELECT date_trunc('day', max(sales_datetime)) - INTERVAL 29 DAY FROM train_transactions)"
    out = ["custid", "count(*) AS n", "CAST(coalesce(sum(net_amt), 0) AS BIGINT) AS total", f"count(*) FILTER ({recent}) AS n_30", f"CAST(coalesce(sum(net_amt) FILTER ({recent}), 0) AS BIGINT) AS total_30", since("", "")]
    for k in (0, *PART_IDS):
        f = f"part_id = {k}"
        out += [
            f"count(*) FILTER ({f}) AS n_k{k}",
            f"CAST(coalesce(sum(net_amt) FILTER ({f}), 0) AS BIGINT) AS total_k{k}",
            f"count(*) FILTER ({f} AND {recent}) AS n_30_k{k}",
            f"CAST(coalesce(sum(net_amt) FILTER ({f} AND {recent}), 0) AS BIGINT) AS total_30_k{k}",
            since(f" FILTER ({f})", f"_k{k}"),
        ]
    return (
        f"WITH names AS (SELECT nm, min(part_id) AS part_id FROM (SELECT {plain('part_nm')} AS nm, part_id FROM part_ref UNION ALL SELECT {plain('part_nm_en')}, part_id FROM part_ref) WHERE nm <> '' GROUP BY nm), "
        f"lines AS (SELECT DISTINCT line_id, custid, sales_datetime, net_amt, {plain('part_nm')} AS nm, CASE WHEN trim(part_nm) <> '' THEN 0 END AS rest FROM train_transactions WHERE custid IS NOT NULL), "
        f"parts AS (SELECT lines.*, coalesce(part_id, rest) AS part_id FROM lines LEFT JOIN names USING (nm)) "
        f"SELECT {', '.join(out)} FROM parts GROUP BY custid"
    )


SQL = {
    "p5_found": _SESSIONS + "\nFROM s GROUP BY custid, k HAVING count(DISTINCT line_id) >= 2",
    "p5_sessions": _SESSIONS + ", round(date_diff('microsecond', min(t), max(t)) / 1e6, 3) AS duration_s, count(*) AS n_rows, count(DISTINCT line_id) AS n_lines\nFROM s GROUP BY custid, k",
    "p6_features": _p6_sql(),
    "p6_stored": _p6_sql(),
}
