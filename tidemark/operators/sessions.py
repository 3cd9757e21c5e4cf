"""Sessions: an entity's rows parted by pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.times import from_micros, micros


def sessionize(df: DataFrame, entity: str, ts: str, line: str | None = None, gap_seconds: int = 1800, slice_hours: int = 6, min_lines: int = 0) -> DataFrame:
    """One row per session: ``entity, session_id, session_start, session_end, duration_s, n_rows,
    n_lines, min_line, max_line``.

    A new session begins where more than ``gap_seconds`` have passed since the entity's previous row.

    Method: lag over the entity's rows flags the pauses, the running sum of the flags numbers the
    sessions, and each number is aggregated. The windows run over (entity, slice of ``slice_hours``),
    so that an entity with a third of all rows is spread over as many tasks as its time has slices; a
    second window then mends only the sessions that lie within one gap of a slice's edge, at most two
    a slice, by the same lag and running sum. Rows are shuffled once, sessions once more.

    Defined cases: rows with null entity or time belong to no session. Equal times are in one session.
    A line delivered again (same ``line`` and time) adds to ``n_rows`` but not to ``n_lines``; a null
    line adds only to ``n_rows``. Without ``line`` every row is a line. Loading order doesn't matter.
    ``min_lines`` 2 keeps only sessions with two different lines (others: with that many ``n_lines``).
    An empty table gives no rows. Columns of other names are ignored.
    """
    gap, span = gap_seconds * 1_000_000, slice_hours * 3_600_000_000
    if gap >= span:
        raise ValueError("the gap must be shorter than a slice")
    rows = df.select(F.col(entity).alias("e"), micros(df[ts]).alias("t"), (df[line] if line else F.monotonically_increasing_id()).alias("l"))
    rows = rows.where("e is not null and t is not null").withColumn("s", F.floor(F.col("t") / F.lit(span)))
    by = W.partitionBy("e", "s").orderBy("t", "l")
    rows = rows.withColumns({"pt": F.lag("t").over(by), "pl": F.lag("l").over(by)})
    new = (F.col("pt").isNull() | (F.col("t") - F.col("pt") > gap)).cast("int")
    fresh = (F.col("l").isNotNull() & ~(F.col("pt").eqNullSafe(F.col("t")) & F.col("pl").eqNullSafe(F.col("l")))).cast("long")
    local = (
        rows.select("e", "s", "t", "l", fresh.alias("f"), F.sum(new).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("k"))
        .groupBy("e", "s", "k")
        .agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"), F.sum("f").alias("f"), F.min("l").alias("l0"), F.max("l").alias("l1"))
    )
    edge = (F.col("a") - F.col("s") * span <= gap) | ((F.col("s") + 1) * span - F.col("b") <= gap)
    enough = (F.col("l0") != F.col("l1")) if min_lines == 2 else (F.col("f") >= min_lines)
    if min_lines:
        local = local.where(edge | enough)
    # sessions away from the edges are whole; each keeps a key of its own
    local = local.withColumns({"k1": F.when(~edge, F.col("s")), "k2": F.when(~edge, F.col("k"))})
    at = W.partitionBy("e", "k1", "k2").orderBy("a")
    pause = F.lag("b").over(at)
    local = local.withColumn("c", (pause.isNull() | (F.col("a") - pause > gap)).cast("int"))
    whole = (
        local.withColumn("c", F.sum("c").over(at.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy("e", "k1", "k2", "c")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), F.sum("f").alias("f"), F.min("l0").alias("l0"), F.max("l1").alias("l1"))
    )
    if min_lines:
        whole = whole.where(enough)
    return whole.select(
        F.col("e").alias(entity),
        F.xxhash64("e", "a").alias("session_id"),
        from_micros("a").alias("session_start"),
        from_micros("b").alias("session_end"),
        ((F.col("b") - F.col("a")) / 1e6).alias("duration_s"),
        F.col("n").alias("n_rows"),
        F.col("f").alias("n_lines"),
        F.col("l0").alias("min_line"),
        F.col("l1").alias("max_line"),
    )
