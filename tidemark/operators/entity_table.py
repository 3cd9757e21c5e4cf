"""One row per entity from events: counts, totals and recency by event type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.times import DAY_US, micros
from tidemark.session import cut
from tidemark.sources.predictions import exists


def cumulative_table(df: DataFrame, entity: str, kind: str, ts: str, value: str, line: str | None = None) -> DataFrame:
    """The stored form: a row per (entity, kind, day with events), ``cum_n`` and ``cum_total`` up to and
    with that day, ``last_us`` the latest time so far. Day is a number of days since 1970-01-01.

    Rows are shuffled by (entity, kind, day), so that a hot entity is spread over its days and kinds;
    what is left, at most kinds x days rows for an entity, is shuffled by entity for the running sums.

    Defined cases: rows with a null entity are left out. A null time stands before all days (day null)
    and so counts in every sum that goes back to the beginning, never in a window or a recency. A null
    value counts and adds 0. A line delivered again counts once; null lines count each.
    """
    t = micros(df[ts])
    rows = df.select(
        F.col(entity).alias("e"),
        F.col(kind).alias("k"),
        F.floor(t / F.lit(DAY_US)).cast("int").alias("day"),
        t.alias("t"),
        F.col(value).alias("v"),
        (F.col(line) if line else F.lit(None).cast("long")).alias("l"),
    ).where("e is not null")
    once = (
        rows.repartition("e", "k", "day")
        .groupBy("e", "k", "day", "l")
        .agg(F.count("*").alias("c"), F.max("t").alias("t"), F.max("v").alias("v1"), F.sum("v").alias("vs"))
    )
    known = F.col("l").isNotNull()
    daily = once.groupBy("e", "k", "day").agg(
        F.sum(F.when(known, 1).otherwise(F.col("c"))).alias("n"),
        F.coalesce(F.sum(F.when(known, F.col("v1")).otherwise(F.col("vs"))), F.lit(0)).alias("total"),
        F.max("t").alias("t"),
    )
    upto = W.partitionBy("e", "k").orderBy(F.col("day").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.repartition("e").select(
        F.col("e").alias("entity"),
        F.col("k").alias("kind"),
        "day",
        F.sum("n").over(upto).alias("cum_n"),
        F.sum("total").over(upto).alias("cum_total"),
        F.max("t").over(upto).alias("last_us"),
    )


def as_of(cum: DataFrame, day: int, windows: Sequence[int] = ()) -> DataFrame:
    """A row per (entity, kind) as of the end of ``day``: ``n, total, last_us`` over all time and
    ``n_<w>, total_<w>`` over the last ``w`` days, each the difference of the cumulative values at the
    window's two ends. Kinds without an event up to then are left out. With a column ``batch``, every
    batch is a cumulative table of its own, and their values as of the day are added up."""
    keys = ["entity", "kind", *(["batch"] if "batch" in cum.columns else [])]
    at = {0: F.lit(True) & (F.col("day").isNull() | (F.col("day") <= day))}
    for w in windows:
        at[w] = F.col("day").isNull() | (F.col("day") <= day - w)
    aggs = []
    order = F.coalesce(F.col("day"), F.lit(-(2**31)))
    for w, cond in at.items():
        for c in ("cum_n", "cum_total"):
            aggs.append(F.max_by(F.when(cond, F.col(c)), F.when(cond, order)).alias(f"{c}_{w}"))
    aggs.append(F.max(F.when(at[0], F.col("last_us"))).alias("last_us"))
    ends = cum.groupBy(*keys).agg(*aggs).where("cum_n_0 is not null")
    if "batch" in keys:
        sums = [c for w in at for c in (f"cum_n_{w}", f"cum_total_{w}")]
        ends = ends.groupBy("entity", "kind").agg(*[F.sum(c).alias(c) for c in sums], F.max("last_us").alias("last_us"))
    out = [F.col("entity"), F.col("kind"), F.col("cum_n_0").alias("n"), F.col("cum_total_0").alias("total"), F.col("last_us")]
    for w in windows:
        out += [
            (F.col("cum_n_0") - F.coalesce(F.col(f"cum_n_{w}"), F.lit(0))).alias(f"n_{w}"),
            (F.col("cum_total_0") - F.coalesce(F.col(f"cum_total_{w}"), F.lit(0))).alias(f"total_{w}"),
        ]
    return ends.select(*out)


def entity_table(cum: DataFrame, day: int, now_us: int, kinds: Sequence[int], windows: Sequence[int] = ()) -> DataFrame:
    """One row per entity: over all kinds ``n, total, days_since`` and ``n_<w>, total_<w>``, then the
    same for each of ``kinds`` as ``n_k<kind>`` and so on. ``kind`` must be a whole number; a null kind
    or one outside ``kinds`` counts only in the sums over all. No event of a kind: counts and totals 0,
    ``days_since`` null. ``days_since`` is in days with fractions, from the latest event to ``now_us``.

    An entity's kinds are gathered in a map of at most ``len(kinds)`` entries.
    """
    parts = as_of(cum, day, windows)
    fields = ["n", "total", *[f"{x}_{w}" for w in windows for x in ("n", "total")]]
    listed = F.col("kind").isNotNull() & F.col("kind").between(min(kinds), max(kinds))
    entry = F.struct("kind", F.struct(*fields, "last_us"))
    rows = parts.groupBy("entity").agg(
        *[F.sum(f).alias(f) for f in fields],
        F.max("last_us").alias("last_us"),
        F.map_from_entries(F.collect_list(F.when(listed, entry))).alias("m"),
    )
    days = lambda us: (F.lit(now_us) - us) / F.lit(float(DAY_US))
    out = [F.col("entity"), *[F.col(f) for f in fields], days(F.col("last_us")).alias("days_since")]
    for k in kinds:
        s = F.try_element_at(F.col("m"), F.lit(k).cast(parts.schema["kind"].dataType))
        out += [F.coalesce(s[f], F.lit(0)).alias(f"{f}_k{k}") for f in fields]
        out.append(days(s["last_us"]).alias(f"days_since_k{k}"))
    return rows.select(*out)


class EntityStore:
    """Cumulative tables on disk, one for each load batch, under ``root``: ``cum/batch=<b>`` as
    ``cumulative_table`` gives it and, where lines have ids, ``lines/batch=<b>`` with the days' line ids.

    Cumulative values are linear, so as of a day they add up over batches: a day is added by writing its
    own batch, nothing stored is read or changed but the line ids of the days that it holds, and events
    that come late count from their day on. ``compact`` turns all batches into one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, what: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/{what}") if exists(self.spark, f"{self.root}/{what}") else None

    def append(self, batch: int, df: DataFrame, entity: str, kind: str, ts: str, value: str, line: str | None = None) -> None:
        """Adds the events of ``df``; lines that an earlier batch has at the same entity and day are left
        out. A batch that is written again is replaced."""
        day = F.floor(micros(df[ts]) / F.lit(DAY_US)).cast("int")
        if line is not None:
            df = df.withColumn("__day", day)
            known = self._read("lines")
            if known is not None:
                own = df.select("__day").agg(F.min("__day"), F.max("__day")).first()
                # the ids are stored by day: only the days of this batch are read
                known = known.where((F.col("batch") != batch) & (F.col("day").isNull() | F.col("day").between(*own))).select(F.col("e").alias("__e"), F.col("day").alias("__d"), F.col("l").alias("__l"))
                df = df.join(known, (F.col(entity) == F.col("__e")) & F.col("__day").eqNullSafe(F.col("__d")) & (F.col(line) == F.col("__l")), "left_anti")
            df = cut(df)
            ids = df.where(F.col(entity).isNotNull() & F.col(line).isNotNull()).select(F.col(entity).alias("e"), F.col("__day").alias("day"), F.col(line).alias("l"))
            ids.distinct().repartitionByRange("day").sortWithinPartitions("day").write.mode("overwrite").parquet(f"{self.root}/lines/batch={batch}")
        cumulative_table(df, entity, kind, ts, value, line).write.mode("overwrite").parquet(f"{self.root}/cum/batch={batch}")

    def cumulative(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/cum")

    def compact(self, batch: int, to: EntityStore) -> None:
        """Writes one batch with the sums of all to another store."""
        cum = self.cumulative()
        w = W.partitionBy("batch", "entity", "kind").orderBy(F.col("day").asc_nulls_first())
        daily = cum.select("entity", "kind", "day", (F.col("cum_n") - F.lag("cum_n", 1, 0).over(w)).alias("n"), (F.col("cum_total") - F.lag("cum_total", 1, 0).over(w)).alias("total"), "last_us")
        daily = daily.groupBy("entity", "kind", "day").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last_us").alias("t"))
        upto = W.partitionBy("entity", "kind").orderBy(F.col("day").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
        one = daily.select("entity", "kind", "day", F.sum("n").over(upto).alias("cum_n"), F.sum("total").over(upto).alias("cum_total"), F.max("t").over(upto).alias("last_us"))
        one.write.mode("overwrite").parquet(f"{to.root}/cum/batch={batch}")
        lines = self._read("lines")
        if lines is not None:
            lines.drop("batch").repartitionByRange("day").sortWithinPartitions("day").write.mode("overwrite").parquet(f"{to.root}/lines/batch={batch}")
