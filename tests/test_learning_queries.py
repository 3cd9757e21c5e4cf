"""Every learner's query on the smallest tables: who is scored, and that scores are numbers."""

import math

import pytest

from tidemark.plans import learning

SCORED = ["forest_oof", "logistic_oof", "mlp_oof", "gbt_oof", "leaf_logistic", "seed_bagging", "bagged_rows", "saved_stack", "knn"]
OTHERS = sorted(set(learning.QUERIES) - set(SCORED))


@pytest.mark.parametrize("name", SCORED)
def test_all_customers_are_scored_once(name, spark, data, duck):
    rows = learning.QUERIES[name](spark, data).toPandas()
    labelled = {r.custid for r in learning.folds_of(spark, data).select("custid").collect()}
    for split, t in (("train", "train_transactions"), ("test", "test_transactions")):
        buyers = {x for (x,) in duck.execute(f"SELECT DISTINCT custid FROM {t} WHERE custid IS NOT NULL AND sales_datetime IS NOT NULL").fetchall()}
        own = rows[rows.split == split]
        assert own.custid.is_unique and set(own.custid) == (buyers & labelled if split == "train" else buyers)
    assert rows.score.map(math.isfinite).all()


@pytest.mark.parametrize("name", OTHERS)
def test_rows(name, spark, data):
    rows = learning.QUERIES[name](spark, data).collect()
    assert rows and not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)


def test_folds_side_by_side_give_the_same_scores(spark):
    import threading

    from tidemark.operators import learn

    rows = learn.assemble(spark.range(200).selectExpr("id as custid", "cast(id % 3 = 0 as int) as label", "cast(id % 5 as int) as fold", "(id * 37) % 11 as a", "(id * 13) % 7 + id % 3 as b"), ["a", "b"], ["custid", "label", "fold"])
    both = threading.Barrier(2)

    def make():
        both.wait(60)  # ends only if another fold is being fitted
        return learn.learner("gbt", maxIter=2, maxDepth=2)

    def scores(df):
        return {(r.custid, r.split): r.score for r in df.collect()}

    got = scores(learn.oof_predict(make, rows.where("fold < 4"), rows.where("fold = 4"), folds=4, at_once=2))
    want = scores(learn.oof_predict(lambda: learn.learner("gbt", maxIter=2, maxDepth=2), rows.where("fold < 4"), rows.where("fold = 4"), folds=4))
    assert got.keys() == want.keys() and len(got) == 200 and all(abs(got[k] - want[k]) < 1e-12 for k in got)
