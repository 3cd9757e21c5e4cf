"""Ranks, metrics and blends of prediction sets: long tables (model, entity, ..., score)."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rank import average_rank
from tidemark.session import cut


def rank_normalise(preds: DataFrame, keys: list[str], score: str = "score", name: str = "r") -> DataFrame:
    """Adds the average-tie rank of ``score`` within ``keys`` over the number of scores."""
    ranked = average_rank(preds, keys, score, "__rank")
    return ranked.withColumn(name, F.col("__rank") / F.col("__rank_n")).drop("__rank", "__rank_n")


def auc(preds: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """``keys, auc, n_pos, n_neg``: the share of (positive, negative) pairs in the right order, ties a half.
    Null where a class is missing. Scores are counted by value and class before anything is sorted."""
    ranked = average_rank(preds.where(F.col(label).isNotNull()), keys, score, "__rank")
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    agg = ranked.groupBy(*keys) if keys else ranked.groupBy()
    out = agg.agg(F.sum(F.when(F.col(label) == 1, F.col("__rank"))).alias("__s"), pos.alias("n_pos"), (F.count("*") - pos).alias("n_neg"))
    p, n = F.col("n_pos"), F.col("n_neg")
    return out.withColumn("auc", F.when((p > 0) & (n > 0), (F.col("__s") - p * (p + 1) / 2) / (p.cast("double") * n))).drop("__s")


def weighted_blend(ranks: DataFrame, weights: dict[str, float], by: list[str], score: str = "r", model: str = "model") -> DataFrame:
    """``by, blend``: the weighted sum of the members' ranks, for entities that have every member."""
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(model))
    rows = ranks.where(F.col(model).isin(list(weights)))
    return rows.groupBy(*by).agg(F.sum(w * F.col(score)).alias("blend"), F.countDistinct(model).alias("__n")).where(F.col("__n") == len(weights)).drop("__n")


def power_mean(x: Column, k: float) -> Column:
    """Aggregate: the power mean of values clipped to [1e-6, 1]."""
    return F.pow(F.avg(F.pow(F.greatest(F.least(x, F.lit(1.0)), F.lit(1e-6)), F.lit(float(k)))), F.lit(1.0 / k))


def wide(ranks: DataFrame, models: Sequence[str], by: list[str], score: str = "r", model: str = "model") -> DataFrame:
    """A column for each model, in the given order; the models are named, so the schema is fixed."""
    return ranks.groupBy(*by).agg(*[F.max(F.when(F.col(model) == m, F.col(score))).alias(m) for m in models])


def rank_correlations(table: DataFrame, models: Sequence[str]) -> DataFrame:
    """``model_a, model_b, corr`` of every pair of columns of a wide table, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    one = table.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def blend_aucs(table: DataFrame, models: Sequence[str], label: str, weights: Sequence[Sequence[float]], bins: int = 4096, keep: Sequence[Column] = (), of: Sequence[int] = ()) -> list[float]:
    """AUC of each weighted sum of a wide table's columns, all in one pass: sums fall into ``bins`` equal
    parts of their range and only the bins' counts are gathered. Values within a bin count as tied, which
    moves an AUC by less than the share of pairs in one bin. With ``keep``, conditions on rows, the i-th
    sum is measured over the rows of the condition number ``of[i]``."""
    chosen = np.array(list(of) if keep else [0] * len(weights))
    ws = np.array([[float(w) for w in one] for one in weights])
    span = np.array([sum(abs(float(w)) for w in one) or 1.0 for one in weights])
    k, kept, shape = len(models), len(keep), "i int, low long, c binary"

    def part(i: np.ndarray, low: list[int], c: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(low, pa.int64()), pa.array(c, pa.binary())], names=["i", "low", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of every sum the bins' counts by class: what a task holds and hands on doesn't grow with its rows
        held = np.zeros((len(ws), bins, 2), dtype=np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = [batch.column(j + 1).to_numpy(zero_copy_only=False).astype(float) for j in range(k)]
            conditions = [batch.column(k + 1 + j).to_numpy(zero_copy_only=False).astype(bool) for j in range(kept)] or [np.ones(len(y), dtype=bool)]
            for c, cond in enumerate(conditions):
                rows = np.flatnonzero(cond & ((y == 0) | (y == 1)))
                mine, other = [v[rows] for v in x], (y[rows] == 0).astype(np.int64)
                for i in np.flatnonzero(chosen == c) if len(rows) else ():
                    total = np.zeros(len(rows))
                    for v, w in zip(mine, ws[i], strict=True):
                        total += v * w
                    if np.isnan(total).any():
                        raise ValueError("a row lacks a model's score")
                    at = np.floor((total / span[i] + 1) / 2 * (bins - 1)).astype(np.int64)
                    inside = (at >= 0) & (at < bins)
                    held[i] += np.bincount(at[inside] * 2 + other[inside], minlength=2 * bins).reshape(bins, 2)
                    # scores beyond [-1, 1] have bins of their own
                    for b in np.unique(at[~inside]):
                        here = other[at == b]
                        yield part(np.array([i]), [int(b)], [np.array([[(here == 0).sum(), here.sum()]], dtype=np.int64).tobytes()])
        some = np.flatnonzero(held.any((1, 2)))
        yield part(some, [0] * len(some), [held[i].tobytes() for i in some])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, dict[int, np.ndarray]]] = {}
        for batch in batches:
            for i, low, c in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                n = np.frombuffer(c, dtype=np.int64).reshape(-1, 2)
                whole, beyond = found.setdefault(i, (np.zeros((bins, 2), dtype=np.int64), {}))
                if 0 <= low < bins:
                    whole += n
                else:
                    beyond[low] = beyond.get(low, 0) + n[0]
        for i, (whole, beyond) in found.items():
            n = np.concatenate([*[beyond[b][None] for b in sorted(beyond) if b < 0], whole, *[beyond[b][None] for b in sorted(beyond) if b >= 0]]).astype(float)
            good, pos, neg = float((n[:, 0] * (np.cumsum(n[:, 1]) - n[:, 1] / 2)).sum()), n[:, 0].sum(), n[:, 1].sum()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([good / (pos * neg) if pos and neg else None], pa.float64())], names=["i", "auc"])

    rows = table.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), *[F.col(m).cast("double").alias(f"x{j}") for j, m in enumerate(models)], *[c.alias(f"k{j}") for j, c in enumerate(keep)])
    got = {r["i"]: r["auc"] for r in rows.mapInArrow(run, shape).repartition("i").mapInArrow(add_up, "i int, auc double").collect()}
    return [float("nan") if got.get(i) is None else got[i] for i in range(len(weights))]


def hill_climb(table: DataFrame, models: Sequence[str], label: str, steps: int = 20, start: int = 3) -> dict[str, float]:
    """Weights by greedy selection with replacement: from the ``start`` best models on, the model that lifts
    the mean's AUC most is added; the best prefix counts. One pass over the table a step."""
    table = cut(table)
    eye = [[1.0 if i == j else 0.0 for j in range(len(models))] for i in range(len(models))]
    single = blend_aucs(table, models, label, eye)
    chosen = sorted(range(len(models)), key=lambda i: -single[i])[:start]
    counts = [chosen.count(i) for i in range(len(models))]
    best, kept = blend_aucs(table, models, label, [counts])[0], list(counts)
    for _ in range(steps):
        tries = [[c + (i == j) for j, c in enumerate(counts)] for i in range(len(models))]
        scores = blend_aucs(table, models, label, tries)
        at = max(range(len(models)), key=lambda i: scores[i])
        counts = tries[at]
        if scores[at] > best + 1e-9:
            best, kept = scores[at], list(counts)
    return {m: c / sum(kept) for m, c in zip(models, kept, strict=True)}


def stable_members(table: DataFrame, models: Sequence[str], label: str, entity: str, bags: int = 25, share: float = 0.8, steps: int = 25, least: float = 0.5, start: int = 3, seed: int = 42) -> dict[str, float]:
    """How often each model is chosen by ``hill_climb`` over hashed samples of the entities without
    replacement; those below ``least`` of the bags are left out. All bags take a step in one pass."""
    table, n = cut(table), len(models)
    keep = [F.pmod(F.xxhash64(F.lit(seed + b), entity), F.lit(1000)) < share * 1000 for b in range(bags)]

    def aucs(tries: list[list[list[float]]]) -> list[list[float]]:
        flat = blend_aucs(table, models, label, [w for ts in tries for w in ts], keep=keep, of=[b for b, ts in enumerate(tries) for _ in ts])
        flat = [-1.0 if x != x else x for x in flat]
        out, at = [], 0
        for ts in tries:
            out.append(flat[at : at + len(ts)])
            at += len(ts)
        return out

    counts = []
    for single in aucs([[[float(i == j) for j in range(n)] for i in range(n)] for _ in range(bags)]):
        first = sorted(range(n), key=lambda i: -single[i])[:start]
        counts.append([float(i in first) for i in range(n)])
    best = [x[0] for x in aucs([[c] for c in counts])]
    kept = [list(c) for c in counts]
    for _ in range(steps):
        tries = [[[c + (i == j) for j, c in enumerate(cs)] for i in range(n)] for cs in counts]
        for b, scores in enumerate(aucs(tries)):
            at = max(range(n), key=lambda i: scores[i])
            counts[b] = tries[b][at]
            if scores[at] > best[b] + 1e-9:
                best[b], kept[b] = scores[at], list(counts[b])
    chosen = {m: sum(k[i] > 0 for k in kept) / bags for i, m in enumerate(models)}
    return {m: c for m, c in chosen.items() if c >= least}


def search_weights(table: DataFrame, models: Sequence[str], label: str, low: float = -0.3, rounds: int = 8, size: int = 12, seed: int = 42) -> dict[str, float]:
    """Weights in [``low``, 1] by differential evolution on the AUC; each generation is one pass."""
    table, rng = cut(table), random.Random(seed)
    people = [[rng.uniform(low, 1.0) for _ in models] for _ in range(size)]
    score = blend_aucs(table, models, label, people)
    for _ in range(rounds):
        new = []
        for i in range(size):
            a, b, c = rng.sample([j for j in range(size) if j != i], 3)
            new.append([min(1.0, max(low, people[a][k] + 0.7 * (people[b][k] - people[c][k]))) if rng.random() < 0.8 else people[i][k] for k in range(len(models))])
        for i, s in enumerate(blend_aucs(table, models, label, new)):
            if s > score[i]:
                people[i], score[i] = new[i], s
    best = people[max(range(size), key=lambda i: score[i])]
    return dict(zip(models, best, strict=True))


def recipe_auc(ranks: DataFrame, weights: dict[str, float], entity: str = "custid", label: str = "label", proxies: dict[str, str] | None = None) -> float | None:
    """The AUC of a recipe over labelled ranks; members without ranks of their own have those of their
    proxy. None if a member has neither."""
    use: dict[str, float] = {}
    for m, w in weights.items():
        m = (proxies or {}).get(m, m)
        use[m] = use.get(m, 0.0) + w
    have = {r[0] for r in ranks.where(F.col("model").isin(list(use))).select("model").distinct().collect()}
    if have != set(use):
        return None
    blended = weighted_blend(ranks, use, [entity, label])
    return auc(blended.withColumn("blend", F.round("blend", 9)), [], "blend", label).first()["auc"]


def pool(models: Sequence[str], patterns: Sequence[str] = ()) -> list[str]:
    """The models whose names hold none of ``patterns``."""
    return [m for m in models if not any(p in m for p in patterns)]


def drop_one(ranks: DataFrame, entity: str, label: str) -> DataFrame:
    """``model, loss``: AUC of the mean of all ranks less that of the mean without the model, which is
    (sum - r) / (k - 1), to 9 digits, so that equal sums tie; one pass makes all of them."""
    sums = ranks.groupBy(F.col(entity).alias("__e")).agg(F.sum("r").alias("__s"), F.count("*").alias("__k"))
    rows = ranks.join(sums, F.col(entity) == F.col("__e")).where("__k > 1")
    without = auc(rows.withColumn("score", F.round((F.col("__s") - F.col("r")) / (F.col("__k") - 1), 9)), ["model"], "score", label)
    whole = auc(sums.join(ranks.select(F.col(entity).alias("__e2"), label).distinct(), F.col("__e") == F.col("__e2")).withColumn("score", F.round(F.col("__s") / F.col("__k"), 9)), [], "score", label)
    return without.crossJoin(F.broadcast(whole.select(F.col("auc").alias("all_auc")))).select("model", (F.col("all_auc") - F.col("auc")).alias("loss"))


def shrink(weights: dict[str, float], share: float = 0.75) -> dict[str, float]:
    """Weights drawn towards equal ones: ``share`` of each and the rest in equal parts."""
    return {m: share * w + (1 - share) / len(weights) for m, w in weights.items()}


def reproduces(a: DataFrame, b: DataFrame, entity: str, score: str = "score", least: float = 0.9999) -> tuple[bool, float]:
    """Whether two score sets of the same entities rank them alike: their ranks' correlation."""
    x = rank_normalise(a.select(entity, score), [], score, "ra").select(entity, "ra")
    y = rank_normalise(b.select(entity, score), [], score, "rb").select(entity, "rb")
    r = x.join(y, entity).agg(F.corr("ra", "rb")).first()[0]
    return r is not None and r >= least, float(r) if r is not None else float("nan")


def logloss_weights(table: DataFrame, models: Sequence[str], label: str, steps: int = 15, rate: float = 0.5) -> dict[str, float]:
    """Nonnegative weights of sum 1 that lower the log-loss of the weighted mean score: exponentiated
    gradient, whose gradient over all rows is one aggregate a step. Scores are kept within [1e-6, 1 - 1e-6]."""
    table = cut(table.select(*models, label))
    w = [1 / len(models)] * len(models)
    for _ in range(steps):
        p = F.aggregate(F.array(*[F.col(m) * F.lit(float(x)) for m, x in zip(models, w, strict=True)]), F.lit(0.0), lambda a, x: a + x)
        p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
        slope = (p - F.col(label)) / (p * (1 - p))
        g = table.agg(*[F.avg(slope * F.col(m)).alias(m) for m in models]).first()
        top = max(abs(g[m] or 0.0) for m in models) or 1.0
        w = [x * math.exp(-rate * (g[m] or 0.0) / top) for m, x in zip(models, w, strict=True)]
        w = [x / sum(w) for x in w]
    return dict(zip(models, w, strict=True))
