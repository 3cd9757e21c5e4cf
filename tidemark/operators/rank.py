"""Exact numbering and running totals within keys that may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.bits import order_bits


def spread_rank(df: DataFrame, keys: list[str], order: list[str], weight: str | None = None, name: str = "rank", salts: int = 64) -> DataFrame:
    """Adds ``name``: 0-based places within ``keys`` without a gap, in an order drawn from ``order``;
    with ``weight``, the sum of ``weight`` over the rows placed before.

    No key is handled as one group: rows are numbered within (key, salt), and the totals of the salts
    (at most ``salts`` rows a key) give where each starts. ``df`` is read twice, so cut its lineage
    first if it is dear. Rows equal in ``order`` get different places, in no stated order.
    """
    w = F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight), F.lit(0)).cast("long")
    salted = df.withColumns({"__salt": F.pmod(F.xxhash64(*order), F.lit(salts)), "__w": w})
    starts = (
        salted.groupBy(*keys, "__salt")
        .agg(F.sum("__w").alias("__s"))
        .withColumn("__start", F.sum("__s").over(W.partitionBy(*keys).orderBy("__salt")) - F.col("__s"))
        .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__salt").alias("__ks"), "__start")
    )
    inner = W.partitionBy(*keys, "__salt").orderBy(F.xxhash64(F.lit(7), *order), *order)
    before = F.sum("__w").over(inner.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__w")
    same: Column = F.col("__salt") == F.col("__ks")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return salted.withColumn("__before", before).join(starts, same).select(*df.columns, (F.col("__before") + F.col("__start")).alias(name))


def digest_rank(df: DataFrame, keys: list[str], key: str, seed: int, name: str = "rank") -> DataFrame:
    """Adds ``name``: the 0-based place of the row in the order of md5(seed-key), key within ``keys``. The
    same in every engine, and spread over the digests' first two signs instead of one group a key."""
    rows = df.withColumn("__d", F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))))
    rows = rows.withColumn("__salt", F.substring("__d", 1, 2))
    sizes = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__salt").alias("__ks")).agg(F.count("*").alias("__c"))
    by = [f"__k{i}" for i in range(len(keys))]
    sizes = sizes.withColumn("__b", F.sum("__c").over(W.partitionBy(*by).orderBy("__ks").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__c"))
    same: Column = F.col("__salt") == F.col("__ks")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    place = F.row_number().over(W.partitionBy(*keys, "__salt").orderBy("__d", key)) - 1
    return rows.withColumn("__r", place).join(sizes, same).select(*df.columns, (F.col("__b") + F.col("__r")).alias(name))


def average_rank(df: DataFrame, keys: list[str], value: str, name: str = "rank", pieces: int = 64) -> DataFrame:
    """Adds ``name``, the 1-based rank of ``value`` within ``keys``, ties at their average, and
    ``name_n``, the number of values. Null values are left out.

    Each key is cut into ``pieces`` ranges of values at approximate quantiles; values are counted, so that
    equal ones are one row, and numbered within (key, range) with the ranges' totals for their start.
    Where the cuts lie doesn't change the result.
    """
    rows = df.where(F.col(value).isNotNull())
    by = [f"__k{i}" for i in range(len(keys))]
    renamed = [F.col(k).alias(b) for k, b in zip(keys, by, strict=True)]
    counts = rows.groupBy(*renamed, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    cuts = counts.groupBy(*[F.col(b).alias(f"{b}c") for b in by]).agg(F.percentile_approx("__v", [i / pieces for i in range(1, pieces)], 1000).alias("__cuts"))

    def same(a: list[str], b: list[str]) -> Column:
        c: Column = F.lit(True)
        for x, y in zip(a, b, strict=True):
            c = c & F.col(x).eqNullSafe(F.col(y))
        return c

    placed = counts.join(F.broadcast(cuts) if not keys else cuts, same(by, [f"{b}c" for b in by])).withColumn("__p", F.size(F.filter("__cuts", lambda x: x < F.col("__v"))))
    placed = placed.select(*by, "__v", "__c", "__p")
    totals = placed.groupBy(*[F.col(b).alias(f"{b}t") for b in by], F.col("__p").alias("__pt")).agg(F.sum("__c").alias("__t"))
    w = W.partitionBy(*[f"{b}t" for b in by])
    totals = totals.withColumns({"__b": F.sum("__t").over(w.orderBy("__pt").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__t"), "__n": F.sum("__t").over(w)})
    inner = W.partitionBy(*by, "__p").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = placed.withColumn("__u", F.sum("__c").over(inner)).join(totals, same(by, [f"{b}t" for b in by]) & (F.col("__p") == F.col("__pt")))
    ranked = ranked.select(*by, "__v", (F.col("__b") + F.col("__u") - (F.col("__c") - 1) / 2).alias(name), F.col("__n").alias(f"{name}_n"))
    return rows.join(ranked, same(keys, by) & (F.col(value) == F.col("__v"))).select(*df.columns, name, f"{name}_n")


def running_counts(rows: DataFrame, keys: list[str], value: str, near: Sequence[str] = ()) -> DataFrame:
    """``keys, value, n, upto, total``: for each key and value the number of its rows, that of the key's rows
    with at most this value, and of all the key's rows. Null keys and values are left out. ``near`` names
    columns by which the rows lie together already (and by which a key has few groups): they are counted
    there before anything is shuffled.

    No key is sorted as one group: values that share the exponent and the first 6 bits of the mantissa are
    a range; rows are summed within (key, range), and the ranges' totals give where each starts. A key has
    at most 64 ranges for each power of two that its values reach, so their table is far smaller than the counts."""
    # NaN, the greatest value, has no bits; a value's range is told once it is counted, not for every row
    own = list(dict.fromkeys([*near, *keys, value]))
    counts = rows.where(" and ".join(f"{c} is not null" for c in (*keys, value))).groupBy(*own).agg(F.count("*").alias("n"))
    counts = counts.withColumn("__p", F.coalesce(F.shiftright(order_bits(counts, value), 46), F.lit(1 << 40)))
    if near:
        by = [*keys, value, "__p"]
        counts = counts.select(*by, "n").repartition(*keys, "__p").groupBy(*by).agg(F.sum("n").alias("n"))
    at = [f"__k{i}" for i in range(len(keys))]
    totals = counts.groupBy(*[F.col(k).alias(b) for k, b in zip(keys, at, strict=True)], F.col("__p").alias("__pt")).agg(F.sum("n").alias("__t"))
    inner = W.partitionBy(*keys, "__p").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    w = W.partitionBy(*at)
    totals = totals.withColumns({"__b": F.sum("__t").over(w.orderBy("__pt").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__t"), "total": F.sum("__t").over(w)})
    same: Column = F.col("__p") == F.col("__pt")
    for k, b in zip(keys, at, strict=True):
        same = same & (F.col(k) == F.col(b))
    return counts.withColumn("__u", F.sum("n").over(inner)).join(totals, same).select(*keys, value, "n", (F.col("__b") + F.col("__u")).alias("upto"), "total")
