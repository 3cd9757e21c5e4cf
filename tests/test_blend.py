import math
import random

from pyspark.sql import functions as F

from tidemark.operators import blend, diagnose, pseudo


def preds(spark, n=300, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.randint(0, 1)
        for m, s in (("a", 0.1), ("b", 0.5), ("flat", 0.0)):
            rows.append((m, i, y, round(rng.random() + s * y, 2) if m != "flat" else 0.5))
    return spark.createDataFrame(rows, "model string, custid long, label int, score double"), rows


def pairs_auc(rows, m):
    p, q = [r[3] for r in rows if r[0] == m and r[2] == 1], [r[3] for r in rows if r[0] == m and r[2] == 0]
    return sum((x > y) + 0.5 * (x == y) for x in p for y in q) / (len(p) * len(q))


def test_auc_is_the_share_of_pairs(spark):
    df, rows = preds(spark)
    got = {r.model: r.auc for r in blend.auc(df, ["model"]).collect()}
    for m in ("a", "b", "flat"):
        assert abs(got[m] - pairs_auc(rows, m)) < 1e-9
    assert got["flat"] == 0.5
    turned = {r.model: r.auc for r in blend.auc(df.withColumn("score", -F.col("score")), ["model"]).collect()}
    assert all(abs(turned[m] - (1 - got[m])) < 1e-9 for m in got)


def test_one_class_has_no_auc(spark):
    df, _ = preds(spark)
    assert blend.auc(df.where("label = 1"), ["model"]).where("auc is not null").count() == 0


def test_mean_rank(spark):
    df, _ = preds(spark)
    r = blend.rank_normalise(df, ["model"]).groupBy("model").agg(F.avg("r").alias("r"), F.count("*").alias("n")).collect()
    assert all(abs(x.r - (x.n + 1) / (2 * x.n)) < 1e-9 for x in r)


def test_incomplete_entities_have_no_blend(spark):
    df, _ = preds(spark)
    ranks = blend.rank_normalise(df, ["model"]).where("not (model = 'a' and custid = 3)")
    assert blend.weighted_blend(ranks, {"a": 0.5, "b": 0.5}, ["custid"]).where("custid = 3").count() == 0


def test_hill_climb_prefers_the_better_model(spark):
    df, rows = preds(spark)
    w = blend.wide(blend.rank_normalise(df, ["model"]), ["a", "b", "flat"], ["custid", "label"])
    weights = blend.hill_climb(w, ["a", "b", "flat"], "label", 4, 1)
    assert weights["b"] >= 0.5 and abs(sum(weights.values()) - 1) < 1e-9
    got = blend.blend_aucs(w, ["a", "b", "flat"], "label", [[0, 1, 0]])[0]
    assert abs(got - pairs_auc(rows, "b")) < 2e-3


def test_blend_aucs_of_bags(spark):
    """Each sum over its own rows, scores beyond [-1, 1] too; rows reach Python once, not once for each sum."""
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 1), rng.randrange(-300, 300) / 100, rng.randrange(101) / 100) for i in range(500)] + [(500, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "e long, y int, a double, b double").repartition(3)
    weights, of, keeps = [[1, 0], [0, 1], [0.5, 0.25], [0, 1]], [0, 1, 1, 2], [lambda e: True, lambda e: e % 2 == 0, lambda e: e < 0]
    got = blend.blend_aucs(df, ["a", "b"], "y", weights, keep=[F.lit(True), F.col("e") % 2 == 0, F.col("e") < 0], of=of)
    for (w, v), k, x in zip(weights[:3], of, got, strict=False):
        bin_ = lambda r: math.floor(((w * r[2] + v * r[3]) / (w + v) + 1) / 2 * 4095)  # noqa: B023, E731
        p, n = ([bin_(r) for r in rows if r[1] == y and keeps[k](r[0])] for y in (1, 0))
        assert abs(x - sum((s > t) + 0.5 * (s == t) for s in p for t in n) / (len(p) * len(n))) < 1e-12
    assert math.isnan(got[3])


def test_steps_explode_no_row(spark, monkeypatch):
    df, _ = preds(spark)
    w = blend.wide(blend.rank_normalise(df, ["model"]), ["a", "b", "flat"], ["custid", "label"])
    monkeypatch.setattr(blend.F, "explode", lambda *_: (_ for _ in ()).throw(AssertionError("a row for every sum")))
    assert blend.stable_members(w, ["a", "b", "flat"], "label", "custid", bags=3, steps=2)


def test_psi_of_itself_is_zero(spark):
    df, _ = preds(spark)
    a = df.where("model = 'a'")
    assert abs(diagnose.psi(a, a).first().psi) < 1e-12


def test_selection_modes(spark):
    scores = spark.createDataFrame([(i, i / 100, (i - 5) / 100, (i + 5) / 100) for i in range(101)], "custid long, p double, lo double, hi double")
    n = lambda mode, **a: pseudo.select_rows(scores, "custid", mode, **a).count()
    assert n("hard", high=0.9, low=0.1) == 22
    assert n("consensus", high=0.9, low=0.1) == 12
    assert n("quota", share=0.1) == 20
    assert n("soft", share=0.4) == 22


def test_logloss_weights_prefer_the_better_model(spark):
    df, _ = preds(spark)
    w = blend.wide(blend.rank_normalise(df, ["model"]), ["a", "b", "flat"], ["custid", "label"])
    got = blend.logloss_weights(w, ["a", "b", "flat"], "label")
    assert got["b"] == max(got.values()) and abs(sum(got.values()) - 1) < 1e-9 and min(got.values()) >= 0
    assert blend.shrink({"a": 1.0, "b": 0.0}) == {"a": 0.875, "b": 0.125}


def test_the_same_ranks_reproduce(spark):
    df, _ = preds(spark)
    a = df.where("model = 'b'")
    assert blend.reproduces(a, a.withColumn("score", F.exp("score")), "custid")[0]
    assert not blend.reproduces(a, a.withColumn("score", -F.col("score")), "custid")[0]


def test_gap_correlation(spark):
    df = spark.createDataFrame([("x", 0.8, 0.7, 0.7), ("x", 0.9, 0.7, 0.6), ("x", 0.7, 0.7, 0.8)], "who string, cv double, lb double, public double")
    r = diagnose.gap_correlation(df, ["who"], "cv", "lb", "public").first()
    assert r.n == 3 and abs(r["corr"] + 1) < 1e-9
