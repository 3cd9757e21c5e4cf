"""Out-of-fold training around pyspark.ml estimators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blend import auc
from tidemark.operators.clean import finite
from tidemark.session import cut
from tidemark.sources.predictions import FoldStore


def assemble(df: DataFrame, columns: Sequence[str], keep: Sequence[str], to: str = "features") -> DataFrame:
    """``keep`` and a vector of ``columns``, nulls, NaN and infinities as 0."""
    filled = df.select(*keep, *[finite(F.col(f"`{c}`")).alias(c) for c in columns])
    return VectorAssembler(inputCols=list(columns), outputCol=to).transform(filled).select(*keep, to)


def learner(kind: str, features: str = "features", label: str = "label", weight: str | None = None, seed: int = 42, **args) -> Estimator:
    """A pipeline by name: 'logistic', 'gbt', 'forest', 'mlp' (``layers``), 'ridge'."""
    w = {"weightCol": weight} if weight and kind != "mlp" else {}
    if kind == "logistic":
        last = LogisticRegression(featuresCol="scaled", labelCol=label, maxIter=args.pop("maxIter", 50), **w, **args)
        return Pipeline(stages=[StandardScaler(inputCol=features, outputCol="scaled", withMean=True), last])
    if kind == "gbt":
        return GBTClassifier(featuresCol=features, labelCol=label, maxIter=args.pop("maxIter", 20), maxDepth=args.pop("maxDepth", 4), seed=seed, **w, **args)
    if kind == "forest":
        return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=args.pop("numTrees", 40), maxDepth=args.pop("maxDepth", 7), seed=seed, **w, **args)
    if kind == "mlp":
        last = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol=label, maxIter=args.pop("maxIter", 40), seed=seed, **args)
        return Pipeline(stages=[StandardScaler(inputCol=features, outputCol="scaled", withMean=True), last])
    if kind == "ridge":
        last = LinearRegression(featuresCol="scaled", labelCol=label, elasticNetParam=0.0, regParam=args.pop("regParam", 0.01), **w, **args)
        return Pipeline(stages=[StandardScaler(inputCol=features, outputCol="scaled", withMean=True), last])
    raise ValueError(f"no learner {kind}")


def _scores(model, df: DataFrame, keep: list[str]) -> DataFrame:
    out = model.transform(df)
    return out.select(*keep, (vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")).alias("score"))


def oof_predict(
    make: Callable[[], Estimator],
    train: DataFrame,
    test: DataFrame | None = None,
    entity: str = "custid",
    fold: str = "fold",
    folds: int = 5,
    extra: DataFrame | None = None,
    store: FoldStore | None = None,
    fit_where: Column | None = None,
    at_once: int = 1,
) -> DataFrame:
    """``entity, split, score``: each train row scored by the model of the other folds, each test row by the
    mean of all. ``fit_where`` says which train rows are fitted on; all are scored. ``extra`` rows (pseudo-labels) join every fit and no validation. With ``store`` a fold
    that is written already is read and not fitted again. ``at_once`` folds are fitted side by side: most
    jobs of a small fit are too small for all cores."""
    train = cut(train)

    def scored(k: int) -> DataFrame:
        done = store.read(k) if store else None
        if done is None:
            fit = train.where(F.col(fold) != k)
            fit = fit if fit_where is None else fit.where(fit_where)
            if extra is not None:
                fit = fit.unionByName(extra.select(*[c for c in fit.columns if c in extra.columns]), allowMissingColumns=True)
            model = make().fit(fit)
            done = _scores(model, train.where(F.col(fold) == k), [entity]).withColumn("split", F.lit("train"))
            if test is not None:
                done = done.unionByName(_scores(model, test, [entity]).withColumn("split", F.lit("test")))
            done = store.write(k, done) if store else cut(done)
        return done

    with ThreadPoolExecutor(at_once) as pool:
        parts = list(pool.map(scored, range(folds)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(entity, "split").agg(F.avg("score").alias("score"))


def mean_over(runs: Sequence[DataFrame], entity: str = "custid") -> DataFrame:
    """The mean score over runs of other seeds or columns."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.groupBy(entity, "split").agg(F.avg("score").alias("score"))


def oof_auc(scores: DataFrame, labels: DataFrame, entity: str = "custid") -> float:
    rows = scores.where("split = 'train'").join(labels.select(entity, "label"), entity)
    return float(auc(rows, []).first()["auc"])


def search(makers: dict[str, Callable[[], Estimator]], train: DataFrame, entity: str = "custid") -> list[tuple[str, float]]:
    """Names of parameter settings with their out-of-fold AUC, best first."""
    found = [(name, oof_auc(oof_predict(make, train, entity=entity), train, entity)) for name, make in makers.items()]
    return sorted(found, key=lambda x: -x[1])


def group_gain(df: DataFrame, base: Sequence[str], groups: dict[str, Sequence[str]], make: Callable[[], Estimator], entity: str = "custid") -> list[tuple[str, float, float]]:
    """What each group of columns adds to the base: (group, out-of-fold AUC with it, difference)."""
    keep = [entity, "label", "fold"]
    start = oof_auc(oof_predict(make, assemble(df, base, keep), entity=entity), df, entity)
    out = []
    for name, cols in groups.items():
        a = oof_auc(oof_predict(make, assemble(df, [*base, *cols], keep), entity=entity), df, entity)
        out.append((name, a, a - start))
    return out


def importances(df: DataFrame, columns: Sequence[str], seed: int = 42) -> dict[str, float]:
    """Gain importances of a forest."""
    model = learner("forest", seed=seed).fit(df)
    return dict(zip(columns, [float(x) for x in model.featureImportances.toArray()], strict=True))


def null_importance(df: DataFrame, columns: Sequence[str], entity: str, repeats: int = 3) -> list[str]:
    """Columns whose importance exceeds that under ``repeats`` shuffles of the labels. A shuffle gives each
    row the label of the row at another place of a hashed order."""
    from tidemark.operators.rank import spread_rank

    real = importances(df, columns)
    most = dict.fromkeys(columns, 0.0)
    n = df.count()
    placed = cut(spread_rank(df, [], [entity], name="__at"))
    for k in range(repeats):
        other = placed.select(F.pmod(F.col("__at") * 1 + F.lit((k + 1) * (n // (repeats + 1)) + 1), F.lit(n)).alias("__at"), F.col("label").alias("__y"))
        shuffled = placed.drop("label").join(other, "__at").withColumnRenamed("__y", "label")
        for c, x in importances(shuffled, columns, 42 + k).items():
            most[c] = max(most[c], x)
    return [c for c in columns if real[c] > most[c]]


def rank_aggregate(rankings: Sequence[dict[str, float]], weights: Sequence[float]) -> dict[str, float]:
    """Columns with the weighted sum of their ranks (average on ties, the greatest importance highest) over
    several learners' importances."""
    out = dict.fromkeys(rankings[0], 0.0)
    for imp, w in zip(rankings, weights, strict=True):
        for c, x in imp.items():
            below, same = sum(y < x for y in imp.values()), sum(y == x for y in imp.values())
            out[c] += w * (below + (same + 1) / 2)
    return out


def fold_gain(df: DataFrame, columns: Sequence[str], make: Callable[[], Estimator], k: int, fold: str = "fold", folds: int = 5) -> list[str]:
    """The ``k`` columns of greatest importance, summed over the models of the folds' complements."""
    total = dict.fromkeys(columns, 0.0)
    df = cut(df)
    for f in range(folds):
        model = make().fit(df.where(F.col(fold) != f))
        for c, x in zip(columns, model.featureImportances.toArray(), strict=True):
            total[c] += float(x)
    return sorted(columns, key=lambda c: (-total[c], c))[:k]


def row_bags(make: Callable[[], Estimator], train: DataFrame, test: DataFrame | None, bags: int, share: float, entity: str = "custid", seed: int = 42, **args) -> DataFrame:
    """``entity, split, score``: the mean over ``bags`` runs, each fitted on a hashed ``share`` of the train
    rows; every row is scored in every run."""
    train, runs = cut(train), []
    for b in range(bags):
        chosen = F.pmod(F.xxhash64(F.lit(seed + b), entity), F.lit(1_000_000)) < share * 1_000_000
        runs.append(oof_predict(make, train, test, entity, fit_where=chosen, **args))
    return mean_over(runs, entity)


def prune_correlated(df: DataFrame, columns: Sequence[str], importance: dict[str, float], share: float = 0.6, limit: float = 0.95) -> list[str]:
    """The ``share`` most important columns, of pairs correlated beyond ``limit`` only the more important."""
    kept = sorted(columns, key=lambda c: -importance[c])[: max(1, int(len(columns) * share))]
    m = Correlation.corr(assemble(df, kept, []), "features").first()[0].toArray()
    out: list[int] = []
    for i in range(len(kept)):
        if all(not abs(m[i, j]) > limit for j in out):
            out.append(i)
    return [kept[i] for i in out]


class LeafLogistic:
    """Gradient-boosted trees whose leaves, one-hot, feed a logistic regression."""

    def __init__(self, iterations: int = 8, depth: int = 3, seed: int = 42):
        self.iterations, self.depth, self.seed = iterations, depth, seed

    def fit(self, df: DataFrame) -> LeafLogistic:
        self.trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=self.iterations, maxDepth=self.depth, seed=self.seed, leafCol="leaves").fit(df)
        names = [f"leaf{i}" for i in range(self.iterations)]
        hot = OneHotEncoder(inputCols=names, outputCols=[f"{n}_hot" for n in names], handleInvalid="keep")
        together = VectorAssembler(inputCols=[f"{n}_hot" for n in names], outputCol="leaf_vector")
        last = LogisticRegression(featuresCol="leaf_vector", labelCol="label", regParam=0.01)
        self.model = Pipeline(stages=[hot, together, last]).fit(self._leaves(df))
        return self

    def _leaves(self, df: DataFrame) -> DataFrame:
        leaves = vector_to_array("leaves")
        return self.trees.transform(df).select(*df.columns, *[leaves[i].alias(f"leaf{i}") for i in range(self.iterations)])

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._leaves(df))


def _nearest(q: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and labels of the ``k`` rows of ``x`` nearest to each row of ``q``, the nearest first, equal
    ones by label. Rows come in so many groups that the k-th smallest of the groups' minima is a bound;
    only what is within it is measured exactly and sorted."""
    n = len(x)
    k = min(k, n)
    width = max(1, n // (8 * k))
    groups = -(-n // width)
    side = np.full((groups * width, x.shape[1] + 1), 0, dtype=np.float32)
    side[:n, :-1], side[:n, -1], side[n:, -1] = -2 * x, (x * x).sum(1), np.float32(1e30)
    ds, ys = [np.empty((0, k))], [np.empty((0, k), dtype=y.dtype)]
    step = max(1, 8_000_000 // len(side))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        own = (part * part).sum(1)
        near = np.hstack([part, np.ones((len(part), 1))]).astype(np.float32) @ side.T  # squared, less the own square
        most = np.partition(near.reshape(len(part), width, groups).min(1), k - 1, axis=1)[:, k - 1].astype(float)
        most += 1e-5 * (own + np.maximum(most + own, 0)) + 1e-6
        row, at = np.nonzero(near <= most[:, None].astype(np.float32))
        row, at = row[at < n], at[at < n]
        # in pieces: where many rows are equal, all of them are within the bound
        d = np.concatenate([np.sqrt(((part[row[j : j + 200_000]] - x[at[j : j + 200_000]].astype(float)) ** 2).sum(1)) for j in range(0, len(row), 200_000)])
        order = np.lexsort((y[at], d, row))
        row, at, d = row[order], at[order], d[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        ds.append(d[kept].reshape(-1, k))
        ys.append(y[at[kept]].reshape(-1, k))
    return np.concatenate(ds), np.concatenate(ys)


def knn_scores(train: DataFrame, query: DataFrame, entity: str, k: int = 50, components: int = 8, block: int = 200_000, keep: Sequence[str] = ()) -> DataFrame:
    """``entity, score`` and the columns ``keep`` of ``query``, each row once: the distance-weighted share of
    positives among the ``k`` nearest train rows by the leading principal components. The train side goes
    to the tasks in blocks of a bounded number of rows, and each query row keeps its ``k`` nearest over
    the blocks."""
    pipe = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), PCA(inputCol="scaled", outputCol="pc", k=components)]).fit(train)
    base = cut(pipe.transform(train).select("label", vector_to_array("pc").alias("v"), F.pmod(F.xxhash64(entity), F.lit(1 << 30)).alias("h")))
    n = base.count()
    blocks = max(1, -(-n // block))
    keys = [entity, *keep]
    rows = cut(pipe.transform(query).select(*keys, vector_to_array("pc").alias("v")).repartition(query.sparkSession.sparkContext.defaultParallelism))
    kinds = ", ".join(f"{c} {query.schema[c].dataType.simpleString()}" for c in keys)
    found = None
    for i in range(blocks):
        part = base.where(F.pmod("h", F.lit(blocks)) == i).select("label", "v").toArrow()
        if not part.num_rows:
            continue
        x = part["v"].combine_chunks().flatten().to_numpy().astype(np.float32).reshape(part.num_rows, -1)
        y = part["label"].to_numpy().astype(np.int32)
        del part

        def near(batches, x=x, y=y):
            for pdf in batches:
                d, at = _nearest(np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), -1), x, y, k)
                yield pdf[keys].assign(d=list(d), y=list(at))

        hits = rows.mapInPandas(near, f"{kinds}, d array<double>, y array<int>").select(*keys, F.arrays_zip("d", "y").alias("x"))
        found = hits if found is None else found.unionByName(hits)
    if blocks > 1:
        found = found.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, k).alias("x"))
    w = lambda s: 1.0 / (s["d"] + 1e-6)
    return found.select(*keys, (F.aggregate("x", F.lit(0.0), lambda a, s: a + w(s) * s["y"]) / F.aggregate("x", F.lit(0.0), lambda a, s: a + w(s))).alias("score"))


def knn_predict(train: DataFrame, test: DataFrame, entity: str = "custid", fold: str = "fold", folds: int = 5, **args) -> DataFrame:
    """``entity, split, score`` as ``oof_predict``: each train row scored by the rows of the other folds, each
    test row by the mean over all. ``args`` go to ``knn_scores``."""
    train, test = cut(train), cut(test.select(entity, "features", F.lit("test").alias("split")))
    out = None
    for k in range(folds):
        query = train.where(F.col(fold) == k).select(entity, "features", F.lit("train").alias("split")).unionByName(test)
        one = cut(knn_scores(train.where(F.col(fold) != k), query, entity, keep=["split"], **args))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(entity, "split").agg(F.avg("score").alias("score"))


def class_direction(df: DataFrame, columns: Sequence[str], entity: str, label: str = "label", fold: str = "fold", folds: int = 5) -> DataFrame:
    """``entity, projection, to_pos, to_neg, gap``: a row's place between the class centroids of the other
    folds, which are totals less the own fold's sums."""
    sums = df.groupBy(fold, label).agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in columns]).collect()
    rows = []
    for k in range(folds):
        c = {}
        for y in (0, 1):
            part = [r for r in sums if r[fold] != k and r[label] == y]
            m = sum(r["n"] for r in part)
            c[y] = [sum((r[x] or 0.0) for r in part) / m if m else 0.0 for x in columns]
        rows.append((k, c[1], c[0]))
    side = df.sparkSession.createDataFrame(rows, "__f int, pos array<double>, neg array<double>")
    v = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    x = df.select(entity, fold, v.alias("v")).join(F.broadcast(side), F.col(fold) == F.col("__f"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, z: s + z))
    diff = F.zip_with("pos", "neg", lambda p, q: p - q)
    x = x.withColumns({"projection": dot(F.col("v"), diff) / (F.sqrt(dot(diff, diff)) + 1e-12), "to_pos": far(F.col("v"), F.col("pos")), "to_neg": far(F.col("v"), F.col("neg"))})
    return x.select(entity, "projection", "to_pos", "to_neg", (F.col("to_neg") - F.col("to_pos")).alias("gap"))
