"""Assembly and cleaning of wide feature tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantile import quantiles, quantiles_of
from tidemark.operators.rank import average_rank
from tidemark.session import cut


def safe_names(names: Sequence[str]) -> list[str]:
    """Names of letters, digits, Hangul and _, repeated ones with a number behind."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        n = re.sub(r"[^0-9A-Za-z가-힣_]", "_", n)
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}__{k}" if k else n)
    return out


def on_spine(spine: DataFrame, blocks: Sequence[DataFrame], key: str, fill: float | dict = 0.0) -> DataFrame:
    """``spine`` with every block's columns by left joins on ``key``; nulls filled after the joins. Clashing
    names get a number. Blocks keyed alike are shuffled alike, so a partitioned spine is shuffled once."""
    names = safe_names([c for b in blocks for c in b.columns if c != key])
    at, out = 0, spine
    for b in blocks:
        cols = [c for c in b.columns if c != key]
        out = out.join(b.select(F.col(key), *[F.col(f"`{c}`").alias(n) for c, n in zip(cols, names[at:], strict=False)]), key, "left")
        at += len(cols)
    return out.na.fill(fill)


def gathered(spine: DataFrame, blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """``on_spine`` for any number of blocks of numbers, filled with 0, if every key stands once in ``spine``
    and in each block. A block's row goes as one array, and the arrays of a key meet in one shuffle and one
    aggregate; a chain of joins would hold a sorter for every block in each task."""
    names = safe_names([c for b in blocks for c in b.columns if c != key])
    rest = [c for c in spine.columns if c != key]
    rows = spine.select(key, F.struct(*rest).alias("__s"), F.lit(None).cast("struct<k:int,v:array<double>>").alias("__x"))
    for k, b in enumerate(blocks):
        v = F.array(*[F.col(f"`{c}`").cast("double") for c in b.columns if c != key])
        rows = rows.unionByName(b.select(key, F.struct(F.lit(k).alias("k"), v.alias("v")).alias("__x")), allowMissingColumns=True)
    own = rows.groupBy(key).agg(F.max("__s").alias("__s"), F.map_from_entries(F.collect_list("__x")).alias("__m")).where("__s is not null")
    own = own.select(key, *[F.col(f"__s.{c}").alias(c) for c in rest], *[F.try_element_at("__m", F.lit(k)).alias(f"__b{k}") for k in range(len(blocks))])
    places = [(k, i) for k, b in enumerate(blocks) for i in range(len(b.columns) - 1)]
    return own.select(key, *rest, *[F.coalesce(F.get(f"__b{k}", F.lit(i)), F.lit(0.0)).alias(n) for (k, i), n in zip(places, names, strict=True)])


def align(df: DataFrame, like: DataFrame, fill: float = 0.0) -> DataFrame:
    """``df`` with exactly the columns of ``like``, missing ones filled."""
    have = set(df.columns)
    return df.select(*[F.coalesce(F.col(c), F.lit(fill).cast(t)).alias(c) if c in have and t not in ("string", "date") else F.col(c) if c in have else F.lit(fill).cast(t).alias(c) for c, t in like.dtypes])


def clip_log(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``columns`` clipped to their percentiles ``low`` and ``high``, then ln(1 + x) of the part above 0. A
    column without values stays."""
    df = cut(df)
    edges = quantiles_of(df, columns, [low, high])
    return df.withColumns({c: F.log1p(F.greatest(F.greatest(F.least(F.col(c).cast("double"), F.lit(float(hi))), F.lit(float(lo))), F.lit(0.0))) for c, (lo, hi) in edges.items() if lo is not None})


def finite(x: Column) -> Column:
    """``x``, 0 where it is null, NaN or infinite."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def columns_like(df: DataFrame, prefixes: Sequence[str] = (), parts: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` and those whose names begin with one of ``prefixes`` or hold one of ``parts``."""
    names = [c for c in df.columns if c not in keep and (c.startswith(tuple(prefixes)) or any(p in c for p in parts))]
    return df.select(*keep, *[F.col(f"`{c}`") for c in names])


def z_scores(df: DataFrame, columns: Sequence[str], fit: DataFrame) -> DataFrame:
    """``columns`` less their mean over ``fit``, by its deviation (population; 0 where it is 0)."""
    r = fit.agg(*[a for c in columns for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(r[f"m_{c}"])) / F.lit(r[f"s_{c}"]) if r[f"s_{c}"] else F.when(F.col(c).isNotNull(), 0.0) for c in columns})


def quantile_bins(df: DataFrame, column: str, fit: DataFrame, bins: int, name: str) -> DataFrame:
    """Adds ``name``, the number of the right-closed bin between the quantiles of ``fit`` (equal ones once),
    from 0; null stays null."""
    edges = sorted({x for x in quantiles(fit, column, [i / bins for i in range(1, bins)]) if x is not None})
    number = F.lit(0)
    for e in edges:
        number = number + F.when(F.col(column) > e, 1).otherwise(0)
    return df.withColumn(name, F.when(F.col(column).isNotNull(), number))


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x))."""
    return 1 / (1 + F.exp(-x))


def informative(df: DataFrame, columns: Sequence[str], least_variance: float = 1e-6, least_share: float = 0.003) -> list[str]:
    """The columns with enough variance and enough values other than 0, from one pass."""
    aggs = [a for c in columns for a in (F.var_samp(c).alias(f"v_{c}"), F.avg(F.when(F.col(c) != 0, 1.0).otherwise(0.0)).alias(f"s_{c}"))]
    r = df.agg(*aggs).first()
    return [c for c in columns if (r[f"v_{c}"] or 0.0) >= least_variance and (r[f"s_{c}"] or 0.0) >= least_share]


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Products ('mul') and guarded quotients ('div') of named columns; an unknown name is an error."""
    missing = {c for a, b, _ in pairs for c in (a, b)} - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.withColumns({f"{a}_{op}_{b}": F.col(a) * F.col(b) if op == "mul" else F.col(a) / (F.abs(b) + 1e-5) for a, b, op in pairs})


def gauss_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds ``name``: the inverse normal of (average rank - 1/2) / n."""

    @F.pandas_udf("double")
    def inverse(p: pd.Series) -> pd.Series:
        inv = NormalDist().inv_cdf
        return p.map(lambda x: inv(min(max(x, 1e-9), 1 - 1e-9)))

    ranked = average_rank(df, [], column, "__g")
    return ranked.withColumn(name, inverse((F.col("__g") - 0.5) / F.col("__g_n"))).drop("__g", "__g_n")


def values_of(df: DataFrame, column: str, most: int = 2000) -> list[str]:
    """The distinct values of a category, sorted: the columns of a pivot. Over ``most`` is an error."""
    got = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{column} has over {most} values")
    return sorted(got)


def fixed_pivot(df: DataFrame, key: str, column: str, values: Sequence[str], prefix: str) -> DataFrame:
    """``key`` and a count for each of ``values``, which are stated, so that every table has one schema."""
    if not values:
        return df.select(key).distinct()
    names = safe_names([f"{prefix}{v}" for v in values])
    return df.groupBy(key).agg(*[F.sum(F.when(F.col(column) == v, 1).otherwise(0)).alias(n) for v, n in zip(values, names, strict=True)])


def per_visit(df: DataFrame, columns: Sequence[str], visits: str) -> DataFrame:
    """Adds ``<column>_per_visit`` for counts."""
    return df.withColumns({f"{c}_per_visit": F.col(c) / (F.col(visits) + 1e-5) for c in columns})
