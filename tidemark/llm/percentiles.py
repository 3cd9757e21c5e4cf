"""Percentiles per group by radix selection over order-preserving integers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.bits import WHOLE, order_bits, ordered, value_of
from tidemark.session import cut, if_small

#: The bits below the digits read so far, level by level: 16 bits are read at each.
SHIFTS = (48, 32, 16, 0)

#: Up to so many followed digits, of about 200 bytes each, are broadcast; beyond, the digits are shuffled.
FOLLOWED = 20_000


def histogram(df: DataFrame, keys: Sequence[str], value: str, shift: int = 40) -> DataFrame:
    """The form that can be merged: for each combination of ``keys`` and bin, ``n`` values between ``lo``
    and ``hi``. A bin holds the values that share all but the last ``shift`` bits, so with 40 their
    relative difference is below 2**-12. Null and NaN values are left out."""
    x = F.col(value)
    # the filter reads the column itself, for it would else make the bits a second time
    rows = df.where(x.isNotNull() & ~F.isnan(x.cast("double"))).select(*keys, order_bits(df, value).alias("k"))
    return rows.groupBy(*keys, F.shiftright("k", shift).alias("bin")).agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))


def merge(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histograms of parts (days, load batches, partitions), put under one another, summed by ``keys``."""
    return hist.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _ranks(qs: Sequence[float], total: Column) -> Column:
    """(q, rank) for each q: the rank of the smallest value with at least a share q at or below it."""
    return F.array(*[F.struct(F.lit(float(q)).alias("q"), F.greatest(F.lit(1), (total - F.floor(total - total * F.lit(float(q))))).cast("long").alias("r")) for q in qs])


def find_bins(hist: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """The bin that holds each quantile: ``keys, q, r, bin, n, lo, hi, total``, ``r`` the rank within it.
    Only bins are sorted in a group, at most 2**16 at the first level whatever its rows."""
    w = W.partitionBy(*keys)
    rows = hist.withColumns({"total": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))})
    here = F.filter(_ranks(qs, F.col("total")), lambda x: (x["r"] > F.col("upto") - F.col("n")) & (x["r"] <= F.col("upto")))
    rows = rows.withColumn("x", F.explode(here))
    return rows.select(*keys, F.col("x.q").alias("q"), (F.col("x.r") - F.col("upto") + F.col("n")).alias("r"), "bin", "n", "lo", "hi", "total")


def from_histogram(hist: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """``keys, q, value, low, high, n`` from a merged histogram: the quantile lies between ``low`` and
    ``high``, and ``value``, their middle, is off by at most half of their difference."""
    at = find_bins(hist, keys, qs)
    low, high = value_of(F.col("lo")), value_of(F.col("hi"))
    return at.select(*keys, "q", F.when(F.col("lo") == F.col("hi"), low).otherwise(low + (high - low) / 2).alias("value"), low.alias("low"), high.alias("high"), F.col("total").alias("n"))


def percentiles(df: DataFrame, group: str, value: str, qs: Sequence[float], levels: Sequence[int] = SHIFTS) -> DataFrame:
    """``group, q, value, low, high, n``: for each group the smallest value with at least a share ``q``
    of the group's values at or below it. With all ``levels`` it is exact; with the first two, ``low``
    and ``high`` bound it with a relative difference below 2**-20.

    Method: radix selection. At each level the next 16 bits of the order-preserving integers are counted,
    and only the digit with the target rank is followed. A digit whose values are all equal is done. Rows
    are counted before each shuffle, so a group with a third of all rows is as cheap as its digits, and
    the running sums see at most 2**16 digits of a group (and followed digit) each. Whole numbers are their
    own order-preserving integers, and levels above their largest bit are left out.

    Defined cases: null and NaN values are left out, a group with no other value gives no row; rows with
    a null group are left out. -0.0 is 0; infinities count as the ends. Rows are counted as delivered,
    repeated ones too. An empty table gives no rows. ``df`` is read once a level.
    """
    plain = df.select(F.col(group).alias("g"), F.col(value).alias("k")).where("g is not null and k is not null")
    whole = df.schema[value].dataType.simpleString() in WHOLE and levels[-1] == 0
    if whole:
        rows = plain.withColumn("k", F.col("k").cast("long"))
        low, high = rows.agg(F.coalesce(F.min("k"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
        bits = max(abs(low), abs(high)).bit_length()
        levels = [x for x in levels if x < bits] or [0]
        back: Callable[[Column], Column] = lambda k: k.cast("double")
    else:
        rows, back = plain.where(~F.isnan(F.col("k").cast("double"))).withColumn("k", ordered(F.col("k"))), value_of

    def counted(shift: int, keys: list[Column]) -> DataFrame:
        return rows.groupBy("g", *keys, F.shiftright("k", shift).alias("bin")).agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))

    at = cut(find_bins(counted(levels[0], []), ["g"], qs))
    done = [at.where("lo = hi")]
    for last, shift in zip(levels, levels[1:], strict=False):
        open_ = at.where("lo < hi")
        if open_.isEmpty():
            break
        wanted = cut(open_.groupBy("g", "bin").agg(F.collect_list(F.struct("q", "r")).alias("want"), F.first("total").alias("total")))
        wanted = wanted.select(F.col("g").alias("wg"), F.col("bin").alias("up"), "want", F.col("total").alias("all"))
        digits = counted(shift, [F.shiftright("k", last).alias("up_")])
        hist = digits.join(if_small(wanted.select("wg", "up"), FOLLOWED), (F.col("g") == F.col("wg")) & (F.col("up_") == F.col("up")), "left_semi")
        w = W.partitionBy("g", "up_")
        hist = hist.withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)))
        hist = hist.join(if_small(wanted, FOLLOWED), (F.col("g") == F.col("wg")) & (F.col("up_") == F.col("up")))
        here = F.filter("want", lambda x: (x["r"] > F.col("upto") - F.col("n")) & (x["r"] <= F.col("upto")))
        hist = hist.withColumn("x", F.explode(here))
        at = cut(hist.select("g", F.col("x.q").alias("q"), (F.col("x.r") - F.col("upto") + F.col("n")).alias("r"), "bin", "n", "lo", "hi", F.col("all").alias("total")))
        done.append(at.where("lo = hi"))
    done.append(at.where("lo < hi"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    low, high = back(F.col("lo")), back(F.col("hi"))
    return out.select(F.col("g").alias(group), "q", F.when(F.col("lo") == F.col("hi"), low).otherwise(low + (high - low) / 2).alias("value"), low.alias("low"), high.alias("high"), F.col("total").alias("n"))
