import random

from pyspark.sql import functions as F

from tidemark.operators.encode import category_counts, entity_folds, leave_out, line_scores, target_encode, weighted_std


def world(spark, n=60, seed=3):
    rng = random.Random(seed)
    labels = spark.createDataFrame([(i, rng.randint(0, 1)) for i in range(n)] + [(0, 1), (0, 0), (1, None), (None, 1)], "custid long, gender int")
    lines = spark.createDataFrame([(rng.randint(0, n - 1), rng.choice(["a", "b", "c", "rare" if rng.random() < 0.05 else "a", None])) for _ in range(800)], "custid long, cat string")
    return labels, lines


def test_folds_are_stratified_and_leave_conflicts_out(spark):
    labels, _ = world(spark)
    folds = entity_folds(labels, "custid", "gender")
    assert folds.where("custid = 0").count() == 0
    sizes = folds.groupBy("label", "fold").count().collect()
    for y in (0, 1):
        own = [r["count"] for r in sizes if r.label == y]
        assert max(own) - min(own) <= 1


def test_own_fold_labels_never_change_own_encodings(spark):
    labels, lines = world(spark)
    folds = entity_folds(labels, "custid", "gender")
    counts = category_counts(lines, "custid", ["cat"]).join(folds, "custid")
    test = category_counts(lines.where("custid < 5"), "custid", ["cat"])
    before = {r.custid: r.wmean for r in target_encode(counts, test, "custid", "cat", 0.4).collect()}
    flipped = counts.withColumn("label", F.when(F.col("fold") == 2, 1 - F.col("label")).otherwise(F.col("label")))
    after = {r.custid: r.wmean for r in target_encode(flipped, test, "custid", "cat", 0.4).collect()}
    own = {r.custid for r in folds.where("fold = 2").collect()} - set(range(5))
    assert own and all(abs(before[c] - after[c]) < 1e-12 for c in own if c in before)
    assert any(abs(before[c] - after[c]) > 1e-9 for c in before if c not in own)


def test_leave_out_equals_the_loop(spark):
    labels, lines = world(spark)
    counts = category_counts(lines, "custid", ["cat"]).join(entity_folds(labels, "custid", "gender"), "custid")
    rows = counts.collect()
    for r in leave_out(counts, ["cat"]).collect():
        rest = [x for x in rows if x.cat == r["cat"] and x.fold != r.fold]
        assert (r.s, r.m) == (sum(x.n * x.label for x in rest), sum(x.n for x in rest))


def test_unseen_and_thin_categories_get_the_mean(spark):
    rows = [(1, "only", 1, 0, 3), (2, "x", 0, 1, 20), (3, "x", 1, 2, 20)]
    counts = spark.createDataFrame(rows, "custid long, cat string, label int, fold int, n long")
    got = {(r["cat"], r.fold): r for r in line_scores(counts, "cat", least=10, folds=3).collect()}
    assert got["only", 0].r == got["only", 0].prior
    assert got["only", 1].r == got["only", 1].prior
    assert got["x", 0].r == 0.5


def test_weighted_std_is_that_of_the_repeated_rows(spark):
    df = spark.createDataFrame([(1.0, 2), (4.0, 1), (7.0, 3)], "x double, n long")
    long = df.select(F.explode(F.array_repeat("x", F.col("n").cast("int"))).alias("x"))
    assert abs(df.agg(weighted_std(F.col("x"), F.col("n"))).first()[0] - long.agg(F.stddev_samp("x")).first()[0]) < 1e-9
