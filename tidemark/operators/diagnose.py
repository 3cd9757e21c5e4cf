"""Diagnostics of scores: KS, Gini, lift, PSI, disagreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.blend import auc, rank_correlations
from tidemark.operators.quantile import group_quantiles, quantiles
from tidemark.operators.rank import average_rank
from tidemark.session import cut, if_small


def ks_gini_lift(preds: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """``keys, gini, ks, lift, top_share``: 2 * AUC - 1, the largest distance of the classes' cumulative
    shares, and the positive rate of the highest tenth by rank over that of all, with its share of
    positives. From ranks and counts by score, ranges at a time, as ``average_rank`` does."""
    ranked = average_rank(preds, keys, score, "__rank")
    pos = F.when(F.col(label) == 1, 1).otherwise(0)
    counts = ranked.groupBy(*keys, "__rank", "__rank_n").agg(F.sum(pos).alias("p"), F.count("*").alias("c"))
    counts = counts.withColumn("piece", F.floor((F.col("__rank") - 1) * 64 / F.col("__rank_n")))
    part = counts.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("piece").alias("__piece")).agg(F.sum("p").alias("sp"), F.sum("c").alias("sc"))
    by = W.partitionBy(*[f"__{k}" for k in keys])
    run = by.orderBy("__piece").rowsBetween(W.unboundedPreceding, W.currentRow)
    part = part.withColumns({"bp": F.sum("sp").over(run) - F.col("sp"), "bc": F.sum("sc").over(run) - F.col("sc"), "tp": F.sum("sp").over(by), "tc": F.sum("sc").over(by)})
    cond = F.col("piece") == F.col("__piece")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inner = W.partitionBy(*keys, "piece").orderBy("__rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = counts.withColumns({"ip": F.sum("p").over(inner), "ic": F.sum("c").over(inner)}).join(part, cond)
    cp, cc = F.col("bp") + F.col("ip"), F.col("bc") + F.col("ic")
    gap = F.abs(cp / F.col("tp") - (cc - cp) / (F.col("tc") - F.col("tp")))
    top = F.col("__rank") > 0.9 * F.col("__rank_n")
    out = rows.groupBy(*keys).agg(
        F.max(gap).alias("ks"),
        ((F.sum(F.when(top, F.col("p"))) / F.sum(F.when(top, F.col("c")))) / (F.first("tp") / F.first("tc"))).alias("lift"),
        (F.sum(F.when(top, F.col("p"))) / F.first("tp")).alias("top_share"),
    )
    return out.join(auc(preds, keys, score, label).select(*keys, (2 * F.col("auc") - 1).alias("gini")), keys)


def psi(expected: DataFrame, actual: DataFrame, score: str = "score", bins: int = 10, keys: list[str] | None = None) -> DataFrame:
    """``keys, psi``: population stability of ``actual`` against ``expected``, over the expected deciles;
    empty bins count as a share of 1e-6."""
    keys = keys or []
    names = {f"q{i}": (score, i / bins) for i in range(1, bins)}
    if keys:
        edges = group_quantiles(expected, keys, names)
    else:
        found = quantiles(expected, score, [q for _, q in names.values()])
        edges = expected.sparkSession.createDataFrame([tuple(found)], ", ".join(f"{n} double" for n in names))
    edges = if_small(cut(edges.select(*keys, F.array(*names).alias("edges"))))

    def shares(df: DataFrame, name: str) -> DataFrame:
        both = df.join(edges, keys) if keys else df.crossJoin(edges)
        rows = both.withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(score))))
        counts = rows.groupBy(*keys, "bin").agg(F.count("*").alias("c"))
        return counts.withColumn(name, F.col("c") / F.sum("c").over(W.partitionBy(*keys))).drop("c")

    both = shares(expected, "e").join(shares(actual, "a"), [*keys, "bin"], "full_outer")
    e, a = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-6)) for c in ("e", "a"))
    return both.groupBy(*keys).agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def disagreement(table: DataFrame, models: list[str], label: str, at: float = 0.5) -> DataFrame:
    """``pattern, n, positive_rate``: entities by which of the models are right."""
    right = F.concat(*[F.when((F.col(m) >= at) == (F.col(label) == 1), "1").otherwise("0") for m in models])
    return table.groupBy(right.alias("pattern")).agg(F.count("*").alias("n"), F.avg(label).alias("positive_rate"))


def error_groups(table: DataFrame, models: list[str], label: str, profile: list[str], at: float = 0.5) -> DataFrame:
    """``error_group, n, share, positive_rate`` and for each column of ``profile`` its mean and the ratio to
    that of all: entities by how many models are right and, where it is one alone, which."""
    right = [((F.col(m) >= at) == (F.col(label) == 1)).cast("int") for m in models]
    n = sum(right[1:], right[0])
    only = F.coalesce(*[F.when(r == 1, F.lit(f"only {m}")) for r, m in zip(right, models, strict=True)])
    group = F.when(n == len(models), "all right").when(n == 0, "all wrong").when(n == 1, only).otherwise(F.concat(n.cast("string"), F.lit(" right")))
    whole = table.agg(F.count("*").alias("__n"), *[F.avg(c).alias(f"__{c}") for c in profile])
    rows = table.groupBy(group.alias("error_group")).agg(F.count("*").alias("n"), F.avg(label).alias("positive_rate"), *[F.avg(c).alias(c) for c in profile])
    # the comparison is one row
    rows = rows.crossJoin(F.broadcast(whole)).withColumn("share", F.col("n") / F.col("__n"))
    return rows.select("error_group", "n", "share", "positive_rate", *profile, *[(F.col(c) / (F.col(f"__{c}") + 1e-9)).alias(f"{c}_ratio") for c in profile])


def augmentation(before: DataFrame, after: DataFrame, label: str = "label", score: str = "score", entity: str = "custid", at: float = 0.5) -> dict[str, float]:
    """Two scores of the same labelled entities compared: AUC of each over all and over those that the first
    gets wrong, and the share of positives there that each finds."""
    both = cut(before.select(entity, label, F.col(score).alias("b")).join(after.select(entity, F.col(score).alias("a")), entity))
    wrong = both.where((F.col("b") >= at) != (F.col(label) == 1))
    one = lambda df, c: auc(df, [], c, label).first()["auc"]
    found = wrong.where(F.col(label) == 1).agg(F.avg((F.col("b") >= at).cast("int")), F.avg((F.col("a") >= at).cast("int"))).first()
    return {"auc_before": one(both, "b"), "auc_after": one(both, "a"), "n_wrong": wrong.count(), "wrong_auc_before": one(wrong, "b"), "wrong_auc_after": one(wrong, "a"), "wrong_found_before": found[0], "wrong_found_after": found[1]}


def teacher_gate(table: DataFrame, candidate: str, teachers: list[str], most: float = 0.97) -> DataFrame:
    """``model, corr, passes``: whether a candidate's ranks go along with each teacher's less than ``most``."""
    pairs = rank_correlations(table, [candidate, *teachers]).where(F.col("model_a") == candidate)
    return pairs.select(F.col("model_b").alias("model"), "corr", (F.col("corr") < most).alias("passes"))


def gap_correlation(results: DataFrame, by: list[str], own: str, other: str, outcome: str) -> DataFrame:
    """``by, n, corr``: how the gap ``own`` - ``other`` of results goes along with ``outcome``."""
    gap = F.col(own) - F.col(other)
    agg = results.groupBy(*by) if by else results.groupBy()
    return agg.agg(F.count(gap).alias("n"), F.corr(gap, F.col(outcome)).alias("corr"))
