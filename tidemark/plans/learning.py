"""Queries of out-of-fold learners; results depend on the learner and so are checked by rows and properties."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import blend, diagnose, learn, pseudo
from tidemark.operators.rank import digest_rank
from tidemark.plans import blending
from tidemark.plans.blocks import BLOCKS
from tidemark.plans.encoders import folds_of
from tidemark.session import cut, shared_folder
from tidemark.sources.predictions import TrialLog, list_models, load_predictions, save_predictions

COLUMNS = ["n_lines", "n_brands", "visit_days", "net_mean", "net_std", "refund_share", "import_share", "weekend_share", "evening_share", "hour_mean", "discount_rate"]


def _base(spark: SparkSession, folder: str) -> DataFrame:
    return cut(BLOCKS["base_agg"].spark(spark, folder).select("custid", *COLUMNS))


def _oof(kind: str, **args):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        train, test = _train_and_test(spark, folder)
        return learn.oof_predict(lambda: learn.learner(kind, **args), train, cut(test))

    return run


def leaf_logistic(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _train_and_test(spark, folder)
    return learn.oof_predict(learn.LeafLogistic, train, cut(test))


def seed_bagging(spark: SparkSession, folder: str) -> DataFrame:
    """Five seeds on hashed subsets of 60 % of the columns."""
    train, test, columns = _both(spark, folder)
    runs = []
    for seed in range(5):
        some = sorted(columns, key=lambda c: hashlib.md5(f"{seed}-{c}".encode()).hexdigest())[: int(len(columns) * 0.6)]
        a, b = learn.assemble(train, some, ["custid", "label", "fold"]), learn.assemble(test, some, ["custid"])
        runs.append(learn.oof_predict(lambda seed=seed: learn.learner("forest", seed=seed, numTrees=10, maxDepth=5), a, b))
    return learn.mean_over(runs)


def _both(spark: SparkSession, folder: str, name: str = "base_agg") -> tuple[DataFrame, DataFrame, list[str]]:
    """A block's rows of the labelled customers with folds, those of test_transactions, and its columns."""
    block = BLOCKS[name]
    test = cut(type(block)(block.steps, ["test_transactions"]).spark(spark, folder))
    rows = cut(type(block)(block.steps, ["train_transactions"]).spark(spark, folder).join(folds_of(spark, folder), "custid"))
    return rows, test, [c for c in test.columns if c != "custid"]


def _train_and_test(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All columns of the base block as features: labelled customers with folds, those of test_transactions."""
    train, test, columns = _both(spark, folder)
    return learn.assemble(train, columns, ["custid", "label", "fold"]), learn.assemble(test, columns, ["custid"])


def knn(spark: SparkSession, folder: str) -> DataFrame:
    """The 200 nearest by 30 components of the whole base block: labelled customers out of fold, those of
    test_transactions by the mean over the folds."""
    return learn.knn_predict(*_train_and_test(spark, folder), k=200, components=30)


def gbt_oof(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled customers out of fold, those of test_transactions by the mean over the folds."""
    train, test = _train_and_test(spark, folder)
    return learn.oof_predict(lambda: learn.learner("gbt", maxIter=8, maxDepth=3), train, cut(test))


def adversarial(spark: SparkSession, folder: str) -> DataFrame:
    """Can lines tell the tables apart? Customers of both, labelled by table, scored out of fold."""
    test = BLOCKS["base_agg"]
    test = type(test)(test.steps, ["test_transactions"]).spark(spark, folder)
    both = _base(spark, folder).withColumn("label", F.lit(0)).unionByName(test.select("custid", *COLUMNS).withColumn("label", F.lit(1)))
    rows = digest_rank(cut(both), ["label"], "custid", 42).withColumn("fold", (F.col("rank") % 3).cast("int"))
    scores = learn.oof_predict(lambda: learn.learner("forest", numTrees=15, maxDepth=5), learn.assemble(rows, COLUMNS, ["custid", "label", "fold"]), folds=3)
    return blend.auc(scores.join(both.select("custid", "label"), "custid"), []).select("auc", "n_pos", "n_neg")


def _stack_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The models' ranks of made predictions as features, stratified folds for the train rows."""
    ranks = blending.ranks(spark, folder)
    wide = cut(blend.wide(ranks, blending.MODELS, ["custid", "split", "label"]))
    train = digest_rank(wide.where("split = 'train'"), ["label"], "custid", 42).withColumn("fold", (F.col("rank") % 5).cast("int"))
    return learn.assemble(train, blending.MODELS, ["custid", "label", "fold"]), learn.assemble(wide.where("split = 'test'"), blending.MODELS, ["custid", "label"])


def logistic_stack(spark: SparkSession, folder: str) -> DataFrame:
    """Two levels: logistic, tree and forest learners over ranks, ranked again, then a logistic combiner."""
    train, test = _stack_rows(spark, folder)
    first = {"logit": lambda: learn.learner("logistic", regParam=0.01), "trees": lambda: learn.learner("gbt", maxIter=5, maxDepth=3), "forest": lambda: learn.learner("forest", numTrees=10, maxDepth=5)}
    out = None
    for name, make in first.items():
        one = learn.oof_predict(make, train, test).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    wide = cut(blend.wide(blend.rank_normalise(out, ["model", "split"]), list(first), ["custid", "split"]))
    second = learn.assemble(wide.where("split = 'train'").join(train.select("custid", "label", "fold"), "custid"), list(first), ["custid", "label", "fold"])
    return learn.oof_predict(lambda: learn.learner("logistic", regParam=0.02), second, learn.assemble(wide.where("split = 'test'"), list(first), ["custid"]))


def pseudo_augmented(spark: SparkSession, folder: str) -> DataFrame:
    """A student that also learns the test rows its teachers are sure of, with weights."""
    train, test = _stack_rows(spark, folder)
    teachers = pseudo.teacher(blending.ranks(spark, folder).where("split = 'test'"), "custid", ["m4", "m5", "m6"])
    sure = pseudo.select_rows(teachers, "custid", "hard", 0.75, 0.25)
    extra = test.drop("label").join(sure, "custid").withColumnsRenamed({"target": "label"}).withColumn("fold", F.lit(-1))
    return learn.oof_predict(lambda: learn.learner("logistic", weight="weight", regParam=0.01), train.withColumn("weight", F.lit(1.0)).withColumn("label", F.col("label").cast("double")), test, extra=extra)


def cotrain(spark: SparkSession, folder: str) -> DataFrame:
    """Two learners take turns: each learns the test rows that the other is sure of."""
    train, test = _stack_rows(spark, folder)
    train = train.withColumn("label", F.col("label").cast("double"))
    makers = [lambda: learn.learner("logistic", regParam=0.01), lambda: learn.learner("forest", numTrees=10, maxDepth=5)]
    extra = scores = None
    for make in (makers[0], makers[1], makers[0]):
        scores = cut(learn.oof_predict(make, train, test, extra=extra))
        sure = scores.where("split = 'test' and (score >= 0.8 or score <= 0.2)").select("custid", F.round("score").alias("label"))
        extra = test.drop("label").join(sure, "custid").withColumn("fold", F.lit(-1))
    return scores


def parameter_search(spark: SparkSession, folder: str) -> DataFrame:
    """Strengths of a logistic learner; each trial is kept under the study's name before the next begins."""
    train, _ = _stack_rows(spark, folder)
    log, n = TrialLog(spark, shared_folder(spark, "study")), train.count()
    for c in (0.02, 0.05, 0.1, 0.3, 1.0, 3.0):
        found = learn.search({f"C={c}": lambda c=c: learn.learner("logistic", regParam=1 / (c * n), maxIter=25)}, train)
        log.add("logistic", {"C": c}, found[0][1])
    return spark.createDataFrame([(f"C={p['C']}", v) for p, v in log.tried("logistic")], "setting string, auc double")


def feature_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Columns that beat three shuffles of the labels, those left after pruning correlated ones, those of
    the ten greatest summed fold gains, and each one's rank over three learners' importances."""
    rows, _, columns = _both(spark, folder)
    data = cut(learn.assemble(rows, columns, ["custid", "label", "fold"]))
    kept = learn.null_importance(data, columns, "custid", 3)
    forest = learn.importances(data, columns)
    pruned = learn.prune_correlated(rows, columns, forest)
    boosted = dict(zip(columns, [float(x) for x in learn.learner("gbt", maxIter=8, maxDepth=3).fit(data).featureImportances.toArray()], strict=True))
    linear = dict(zip(columns, [abs(float(x)) for x in learn.learner("logistic", regParam=0.01).fit(data).stages[-1].coefficients.toArray()], strict=True))
    place = learn.rank_aggregate([forest, boosted, linear], [0.4, 0.3, 0.3])
    top = learn.fold_gain(data, columns, lambda: learn.learner("forest", numTrees=10, maxDepth=5), 10)
    return spark.createDataFrame([(c, c in kept, c in pruned, c in top, place[c]) for c in columns], "column_name string, beats_chance boolean, pruned_set boolean, top_gain boolean, rank double")


def bagged_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of the twelve greatest fold gains, and ten bags of half the rows."""
    train, test, columns = _both(spark, folder)
    make = lambda: learn.learner("forest", numTrees=5, maxDepth=4)
    some = learn.fold_gain(learn.assemble(train, columns, ["custid", "label", "fold"]), columns, make, 12)
    return learn.row_bags(lambda: learn.learner("logistic", regParam=0.01, maxIter=15), learn.assemble(train, some, ["custid", "label", "fold"]), learn.assemble(test, some, ["custid"]), 10, 0.5)


def axis_models(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees over the base block and one more block each: ``model, custid, split, score``."""
    base_train, base_test, columns = _both(spark, folder)
    out = None
    for name in ("visit_multiagg", "periodicity", "household_share"):
        train, test, own = _both(spark, folder, name)
        a = base_train.join(train.select("custid", *[F.col(c).alias(f"x_{c}") for c in own]), "custid", "left")
        b = base_test.join(test.select("custid", *[F.col(c).alias(f"x_{c}") for c in own]), "custid", "left")
        names = [*columns, *[f"x_{c}" for c in own]]
        one = learn.oof_predict(lambda: learn.learner("gbt", maxIter=6, maxDepth=3), learn.assemble(a, names, ["custid", "label", "fold"]), learn.assemble(b, names, ["custid"])).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def augmentation(spark: SparkSession, folder: str) -> DataFrame:
    """What the household block adds to three learners and to their mean, over all and over the customers
    that the learner gets wrong without it."""
    train, _, columns = _both(spark, folder)
    more, _, own = _both(spark, folder, "household_share")
    wide = cut(train.join(more.select("custid", *[F.col(c).alias(f"x_{c}") for c in own]), "custid"))
    makers = {"logit": lambda: learn.learner("logistic", regParam=0.01, maxIter=20), "forest": lambda: learn.learner("forest", numTrees=10, maxDepth=5), "trees": lambda: learn.learner("gbt", maxIter=5, maxDepth=3)}
    rows, before, after = [], [], []
    for name, make in makers.items():
        b = cut(learn.oof_predict(make, learn.assemble(wide, columns, ["custid", "label", "fold"])))
        a = cut(learn.oof_predict(make, learn.assemble(wide, [*columns, *[f"x_{c}" for c in own]], ["custid", "label", "fold"])))
        before.append(b)
        after.append(a)
        rows.append((name, diagnose.augmentation(b.join(train.select("custid", "label"), "custid"), a)))
    rows.append(("mean", diagnose.augmentation(learn.mean_over(before).join(train.select("custid", "label"), "custid"), learn.mean_over(after))))
    return spark.createDataFrame([(n, *[float(v) if v is not None else None for v in r.values()]) for n, r in rows], "model string, " + ", ".join(f"{k} double" for k in rows[0][1]))


def saved_stack(spark: SparkSession, folder: str) -> DataFrame:
    """From lines to a stack: learners over the base block save their scores, the stack reads all whole ones,
    a first level of learners over their ranks is ranked again, and of its mean, its hill climb and a
    logistic combiner the one of greatest out-of-fold AUC is kept: ``combiner, custid, split, score``."""
    train, test, columns = _both(spark, folder)
    a, b = cut(learn.assemble(train, columns, ["custid", "label", "fold"])), cut(learn.assemble(test, columns, ["custid"]))
    root = shared_folder(spark, "models")
    bases = {"logit": lambda: learn.learner("logistic", regParam=0.01, maxIter=20), "forest": lambda: learn.learner("forest", numTrees=10, maxDepth=5), "trees": lambda: learn.learner("gbt", maxIter=5, maxDepth=3)}
    for name, make in bases.items():
        save_predictions(learn.oof_predict(make, a, b), root, name, {"columns": len(columns), "seed": 42})
    models = list_models(spark, root, train.count())
    labels = cut(train.select("custid", "label", "fold"))
    ranks = cut(blend.wide(blend.rank_normalise(load_predictions(spark, root, models), ["model", "split"]), models, ["custid", "split"]))
    fit, rest = ranks.where("split = 'train'").join(labels, "custid"), ranks.where("split = 'test'")
    x, y = cut(learn.assemble(fit, models, ["custid", "label", "fold"])), cut(learn.assemble(rest, models, ["custid"]))
    first = {
        **{f"logit{k}": lambda c=c: learn.learner("logistic", regParam=c, maxIter=15) for k, c in enumerate((0.05, 0.01, 0.003))}, "ridge": lambda: learn.learner("ridge", regParam=0.1),
        "forest": lambda: learn.learner("forest", numTrees=10, maxDepth=4), "trees": lambda: learn.learner("gbt", maxIter=4, maxDepth=2),
    }
    level = learn.knn_predict(x, y, k=100, components=len(models)).withColumn("model", F.lit("near"))
    for name, make in first.items():
        level = level.unionByName(learn.oof_predict(make, x, y).withColumn("model", F.lit(name)))
    climbed = blend.hill_climb(fit, models, "label", 20)
    level = level.unionByName(ranks.select("custid", "split", sum((F.col(m) * w for m, w in climbed.items()), F.lit(0.0)).alias("score"), F.lit("climb").alias("model")))
    names = ["near", *first, "climb"]
    wide = cut(blend.wide(blend.rank_normalise(level, ["model", "split"]), names, ["custid", "split"]))
    top = wide.where("split = 'train'").join(labels, "custid")
    weights = blend.hill_climb(top, names, "label", 20)
    mixed = lambda ws: wide.select("custid", "split", sum((F.col(m) * w for m, w in ws.items()), F.lit(0.0)).alias("score"))
    last = {
        "mean": mixed({m: 1 / len(names) for m in names}), "climb": mixed(weights),
        "logit": learn.oof_predict(lambda: learn.learner("logistic", regParam=0.02, maxIter=15), learn.assemble(top, names, ["custid", "label", "fold"]), learn.assemble(wide.where("split = 'test'"), names, ["custid"])),
    }
    aucs = {n: learn.oof_auc(df, labels) for n, df in last.items()}
    best = max(sorted(aucs), key=lambda n: aucs[n])
    for n, df in last.items():
        save_predictions(df, f"{root}/level2", n, {"auc": aucs[n]})
    return load_predictions(spark, f"{root}/level2", [best]).select(F.col("model").alias("combiner"), "custid", "split", F.col("score").cast("double").alias("score"))


def class_direction(spark: SparkSession, folder: str) -> DataFrame:
    rows = _base(spark, folder).join(folds_of(spark, folder), "custid")
    cols = ["n_lines", "visit_days", "weekend_share", "evening_share"]
    return learn.class_direction(rows, cols, "custid").select("custid", *[F.round(F.col(c) + 1e-10, 4).alias(c) for c in ("projection", "to_pos", "to_neg", "gap")])


def line_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """A model over lines, out of fold by customer; a customer's score is the mean of its lines'."""
    lines = BLOCKS["line_features"].spark(spark, folder).join(folds_of(spark, folder), "custid")
    data = learn.assemble(lines, ["hour", "dow", "month", "weekend", "dis_ratio", "signed_log"], ["line_id", "custid", "label", "fold"])
    scores = learn.oof_predict(lambda: learn.learner("logistic", regParam=0.01, maxIter=15), data, entity="line_id", folds=5)
    return scores.join(lines.select("line_id", "custid"), "line_id").groupBy("custid").agg(F.avg("score").alias("score"), F.count("*").alias("n_lines"))


def ridge_stack(spark: SparkSession, folder: str) -> DataFrame:
    """Ridge regressions over subsets of the models' ranks, ranked and averaged."""
    ranks = blending.ranks(spark, folder)
    wide = cut(blend.wide(ranks.where("split = 'train'"), blending.MODELS, ["custid", "label"]))
    rows = digest_rank(wide, ["label"], "custid", 42).withColumn("fold", (F.col("rank") % 5).cast("int"))
    runs = []
    # ten subsets of four models
    for k in range(10):
        some = sorted(sorted(blending.MODELS, key=lambda m: hashlib.md5(f"{k}-{m}".encode()).hexdigest())[:4])
        scores = learn.oof_predict(lambda: learn.learner("ridge", regParam=0.1), learn.assemble(rows, some, ["custid", "label", "fold"]))
        runs.append(blend.rank_normalise(scores, ["split"], "score").select("custid", "split", F.col("r").alias("score")))
    return learn.mean_over(runs)


def group_gain(spark: SparkSession, folder: str) -> DataFrame:
    """What groups of columns add to counts, by out-of-fold AUC."""
    rows = cut(_base(spark, folder).join(folds_of(spark, folder), "custid"))
    groups = {"time": ["weekend_share", "evening_share", "hour_mean"], "amount": ["net_mean", "net_std", "discount_rate"]}
    found = learn.group_gain(rows, ["n_lines", "n_brands", "visit_days"], groups, lambda: learn.learner("logistic", regParam=0.01, maxIter=20))
    return spark.createDataFrame(found, "column_group string, auc double, gain double")


QUERIES = {
    "forest_oof": _oof("forest", numTrees=15, maxDepth=5),
    "logistic_oof": _oof("logistic", regParam=0.01),
    "mlp_oof": _oof("mlp", layers=[len(BLOCKS["base_agg"].steps[-1][1]) - 1, 8, 2], maxIter=20),
    **{f.__name__: f for f in (gbt_oof, leaf_logistic, seed_bagging, knn, adversarial, bagged_rows, axis_models, augmentation, saved_stack, logistic_stack, pseudo_augmented, cotrain, parameter_search, feature_selection, class_direction, line_rollup, ridge_stack, group_gain)},
}

SQL: dict[str, str] = {}
