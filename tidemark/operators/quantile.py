"""Exact quantiles of a whole column, and by groups that may be hot."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.rank import running_counts

#: Up to so many different values the built-in aggregate, which holds them all, is used.
HELD = 2_000_000


def quantiles(df: DataFrame, column: str, qs: Sequence[float], held: int = HELD) -> list[float | None]:
    """The quantiles ``qs`` with linear interpolation, as ``percentile`` gives them. A column with over
    ``held`` different values (estimated first) isn't held in one task: its range is cut into equal bins,
    counted, and only the bin with each needed rank is cut again, until it has at most ``held`` different
    values. No rows: nulls. Null and NaN values don't count."""
    x = F.col(column).cast("double")
    rows = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    n, distinct, low, high = rows.agg(F.count("*"), F.approx_count_distinct("x"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(qs)
    if distinct <= held:
        return list(rows.agg(F.percentile("x", [float(q) for q in qs])).first()[0])
    need = sorted({k for q in qs for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    value = {k: _order_statistic(rows, k, low, high, held) for k in need}
    out = []
    for q in qs:
        at = q * (n - 1)
        a, b = value[math.floor(at)], value[math.ceil(at)]
        out.append(a + (b - a) * (at - math.floor(at)))
    return out


def quantiles_of(df: DataFrame, columns: Sequence[str], qs: Sequence[float], held: int = HELD) -> dict[str, list[float | None]]:
    """``quantiles`` of several columns. Columns that together have at most ``held`` different values share a
    pass; what one task holds is bounded as for one column."""
    if not columns:
        return {}
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    sizes = df.agg(*[F.approx_count_distinct(number[c]) for c in columns]).first()
    out, groups, room = {}, [], 0
    for c, n in sorted(zip(columns, sizes, strict=True), key=lambda x: x[1]):
        if n > held:
            out[c] = quantiles(df, c, qs, held)
        elif groups and n <= room:
            groups[-1].append(c)
            room -= n
        else:
            groups.append([c])
            room = held - n
    for group in groups:
        found = df.agg(*[F.percentile(number[c], [float(q) for q in qs]) for c in group]).first()
        out |= {c: list(x) if x is not None else [None] * len(qs) for c, x in zip(group, found, strict=True)}
    return out


def _order_statistic(rows: DataFrame, k: int, low: float, high: float, held: int, bins: int = 4096) -> float:
    """The value with ``k`` values before it, between ``low`` and ``high``."""
    few = False
    while low < high:
        inside = rows.where(F.col("x").between(low, high))
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        bin_ = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1))
        before = k - rows.where(F.col("x") < low).count()
        for r in sorted(inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.approx_count_distinct("x").alias("d")).collect(), key=lambda r: r["b"]):
            if before < r["c"]:
                low, high, few = r["lo"], r["hi"], r["d"] <= held
                break
            before -= r["c"]
        if few:
            break
    if low == high:
        return low
    # where the range can't be cut any finer, it holds no more values than there are doubles in it
    before = k - rows.where(F.col("x") < low).count()
    for r in sorted(rows.where(F.col("x").between(low, high)).groupBy("x").count().collect(), key=lambda r: r["x"]):
        if before < r["count"]:
            return r["x"]
        before -= r["count"]
    return high


#: Keys with more rows than this aren't sorted as one group.
GROUP = 200_000


def group_quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]], near: Sequence[str] = (), group: int = GROUP) -> DataFrame:
    """``keys`` and, for each name of ``wanted``, the quantile of a column (column, q) with linear
    interpolation, as ``percentile`` gives it; null where a key has no
    value in a column; keys that are null or have none at all are left out. A key may have any number of
    rows and values: those of at most ``group`` rows (counted first) are sorted, each in its task; rows of the others are counted by value,
    and the counts summed in ranges of values (``running_counts``, which says what ``near`` is). The value
    at a rank is the least with so many rows up to it."""
    keys = list(keys)
    sizes = df.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).count()
    hot = sizes.where(F.col("count") > group).select(*keys)
    found = hot.collect()
    if not found:
        return _sorted_quantiles(df, keys, wanted)
    some = F.broadcast(df.sparkSession.createDataFrame(found, hot.schema))
    return _sorted_quantiles(df.join(some, keys, "left_anti"), keys, wanted).unionByName(_range_quantiles(df.join(some, keys, "left_semi"), keys, wanted, near))


def _at_ranks(ranked: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], column: str) -> DataFrame:
    """The quantiles of ``column`` from rows with ``__v``, ``upto`` and ``total``."""
    aggs = []
    for name, (c, q) in wanted.items():
        if c == column:
            at = F.lit(float(q)) * (F.col("total") - 1)
            low = F.min(F.when(F.col("upto") > F.floor(at), F.col("__v"))).cast("double")
            high = F.min(F.when(F.col("upto") > F.ceil(at), F.col("__v"))).cast("double")
            part = F.first(at - F.floor(at))
            aggs.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def _sorted_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    out, w = None, W.partitionBy(*keys)
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        rows = df.select(*keys, F.col(column).alias("__v")).where(" and ".join(f"{c} is not null" for c in (*keys, "__v")))
        one = _at_ranks(rows.withColumns({"upto": F.row_number().over(w.orderBy("__v")), "total": F.count("*").over(w)}), keys, wanted, column)
        out = one if out is None else out.join(one, keys, "full_outer")
    return out


def _range_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], near: Sequence[str]) -> DataFrame:
    out = None
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        one = _at_ranks(running_counts(df.withColumn("__v", F.col(column)), keys, "__v", near), keys, wanted, column)
        out = one if out is None else out.join(one, keys, "full_outer")
    return out
