"""Selection of confident unlabelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantile import quantiles
from tidemark.operators.rank import average_rank


def teacher(ranks: DataFrame, entity: str, models: list[str]) -> DataFrame:
    """``entity, p, lo, hi, n_teachers``: mean, least and greatest of the available teachers' ranks."""
    return ranks.where(F.col("model").isin(models)).groupBy(entity).agg(F.avg("r").alias("p"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n_teachers"))


def select_rows(scores: DataFrame, entity: str, mode: str, high: float = 0.85, low: float = 0.15, share: float = 0.1) -> DataFrame:
    """``entity, target, weight`` of the rows that the mode takes: ``hard`` by the mean, ``consensus`` by
    every teacher, ``quota`` the highest and lowest ``share`` of rows, ``quantile`` beyond the quantiles
    ``share`` and 1 - ``share``, ``soft`` all rows with the mean as target where it is at least ``share``
    from a half; ``weight`` is twice the distance from a half."""
    p = F.col("p")
    weight = (2 * F.abs(p - 0.5)).alias("weight")
    hard = F.when(p >= 0.5, 1.0).otherwise(0.0).alias("target")
    if mode == "hard":
        rows = scores.where((p >= high) | (p <= low))
    elif mode == "consensus":
        rows = scores.where((F.col("lo") >= high) | (F.col("hi") <= low))
    elif mode == "soft":
        return scores.where(F.abs(p - 0.5) >= share).select(entity, p.alias("target"), weight)
    elif mode == "quantile":
        low, high = quantiles(scores, "p", [share, 1 - share])
        rows = scores.where((p <= F.lit(low)) | (p >= F.lit(high)))
    elif mode == "quota":
        ranked = average_rank(scores, [], "p", "__rank")
        rows = ranked.where((F.col("__rank") <= F.floor(F.col("__rank_n") * share)) | (F.col("__rank") > F.col("__rank_n") - F.floor(F.col("__rank_n") * share)))
    else:
        raise ValueError(f"no mode {mode}")
    return rows.select(entity, hard, weight)
