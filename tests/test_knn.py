"""Nearest neighbours against brute force; every labelled customer and every test customer is scored."""

import numpy as np
import pytest

from tidemark.operators.learn import _nearest, assemble, knn_scores
from tidemark.plans import learning


@pytest.mark.parametrize("n, k", [(3, 5), (50, 7), (4000, 20), (5001, 200)])
def test_the_nearest_are_found(n, k):
    rng = np.random.default_rng(n)
    x, q, y = rng.normal(size=(n, 6)) * [1, 1, 1, 1, 1, 40], rng.normal(size=(37, 6)) * 2, rng.integers(0, 2, n)
    x[: n // 3] = x[0]
    d, at = _nearest(q, x, y, k)
    far = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(q)):
        order = np.lexsort((y, far[i]))[:k]
        assert np.allclose(d[i], far[i][order]) and (at[i] == y[order]).all()


def test_blocks_change_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 2)), *map(float, rng.normal(size=3))) for i in range(300)]
    data = assemble(spark.createDataFrame(rows, "custid long, label int, a double, b double, c double"), ["a", "b", "c"], ["custid", "label"])
    train, query = data.where("custid < 200"), data.where("custid >= 200")
    one, many = ({r.custid: r.score for r in knn_scores(train, query, "custid", 9, 2, block).collect()} for block in (1000, 45))
    assert one.keys() == many.keys() == set(range(200, 300))
    assert all(abs(one[c] - many[c]) < 1e-9 for c in one)


def test_every_customer_is_scored(spark, data, duck):
    rows = learning.knn(spark, data).toPandas()
    buyers = lambda t: {r[0] for r in duck.execute(f"SELECT DISTINCT custid FROM {t} WHERE custid IS NOT NULL").fetchall()}
    labelled = {r.custid for r in learning.folds_of(spark, data).select("custid").collect()}
    assert set(rows.custid[rows.split == "train"]) == labelled & buyers("train_transactions")
    assert set(rows.custid[rows.split == "test"]) == buyers("test_transactions")
    assert not rows.duplicated(["custid", "split"]).any() and rows.score.between(0, 1).all()
