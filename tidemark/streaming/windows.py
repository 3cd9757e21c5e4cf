"""Streaming counterparts of the batch blocks: counts by window, sessions, gaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import shared_folder
from tidemark.sources.predictions import exists


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """A table of a folder as a stream of files, with the schema of what lies there. Times become zoned."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    path, glob = (folder, f"{name}.parquet") if name else (folder, "*")
    df = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def window_counts(stream: DataFrame, ts: str, keys: list[str], width: str = "1 day", late: str = "1 day", value: str | None = None) -> DataFrame:
    """``window_start, keys, n, total``: counts and sums by tumbling window; rows later than ``late`` behind
    the newest are dropped once their window is closed (in append and update mode)."""
    total = F.sum(value) if value else F.count("*")
    agg = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), total.alias("total"))
    return agg.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(stream: DataFrame, ts: str, entity: str, gap_seconds: int = 1800, late: str = "1 day") -> DataFrame:
    """``entity, session_start, session_end, n`` of sessions parted by pauses of more than ``gap_seconds``;
    a microsecond is added to the gap, since a session window ends with it."""
    agg = stream.withWatermark(ts, late).groupBy(F.session_window(ts, f"{gap_seconds} seconds 1 microsecond"), entity)
    out = agg.agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("n"))
    return out.select(entity, "session_start", "session_end", "n")


def day_dwell(stream: DataFrame, ts: str, entity: str, late: str = "1 day") -> DataFrame:
    """``entity, day, span_minutes, n``: clock minutes between an entity's first and last event of a day."""
    clock = F.hour(ts) * 60 + F.minute(ts)
    agg = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), entity).agg((F.max(clock) - F.min(clock)).alias("span_minutes"), F.count("*").alias("n"))
    return agg.select(entity, F.col("window.start").alias("day"), "span_minutes", "n")


def gaps(stream: DataFrame, ts: str, entity: str) -> DataFrame:
    """``entity, ts, gap_s``: seconds since the entity's last row in an earlier or the same batch, null for
    its first. The state is one time an entity; rows that come late count from the newest seen."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = sorted(t for b in batches for t in b[ts])
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        out = []
        for t in times:
            out.append((key[0], t, None if last is None else (t - last).total_seconds()))
            last = t if last is None else max(last, t)
        state.update((int(last.value // 1000),))
        yield pd.DataFrame(out, columns=[entity, ts, "gap_s"]).astype({"gap_s": "float64"})

    kind = stream.schema[entity].dataType.simpleString()
    return stream.groupBy(entity).applyInPandasWithState(step, f"{entity} {kind}, {ts} timestamp, gap_s double", "last long", "append", GroupStateTimeout.NoTimeout)


def run_now(df: DataFrame, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Runs a streaming query over all there is and gives its result from a table in the shared folder: in
    complete mode the last batch's, in append mode all batches', each written once under its number."""
    spark = df.sparkSession
    place = shared_folder(spark, "stream")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/out" if mode == "complete" else f"{place}/out/batch={batch}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not exists(spark, f"{place}/out"):
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{place}/out")
