import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean, represent
from tidemark.operators.gram import gram_sums


def test_names_and_spine(spark):
    assert clean.safe_names(["a b", "a-b", "가/나"]) == ["a_b", "a_b__1", "가_나"]
    spine = spark.createDataFrame([(1,), (2,)], "custid long")
    b = spark.createDataFrame([(1, 5.0)], "custid long, x double")
    rows = {r.custid: (r.x, r.x__1) for r in clean.on_spine(spine, [b, b], "custid").collect()}
    assert rows == {1: (5.0, 5.0), 2: (0.0, 0.0)}
    assert clean.align(b.drop("x"), b).columns == ["custid", "x"]


def test_interactions_refuse_unknown_names(spark):
    df = spark.createDataFrame([(2.0, 4.0)], "a double, b double")
    assert clean.interactions(df, [("a", "b", "mul")]).first()["a_mul_b"] == 8.0
    with pytest.raises(ValueError):
        clean.interactions(df, [("a", "c", "mul")])


def test_informative_columns(spark):
    df = spark.createDataFrame([(float(i), 1.0, 0.0) for i in range(100)], "a double, b double, c double")
    assert clean.informative(df, ["a", "b", "c"]) == ["a"]


def test_gauss_rank_is_symmetric(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)], "x double")
    z = [r.z for r in clean.gauss_rank(df, "x", "z").orderBy("x").collect()]
    assert abs(z[4]) < 1e-9 and all(abs(z[i] + z[8 - i]) < 1e-9 for i in range(9))


def test_gram_counts_pairs(spark):
    import random

    rng = random.Random(5)
    sets = [sorted(rng.sample(range(12), rng.randint(0, 8))) for _ in range(50)]
    df = spark.createDataFrame([(s, bool(s)) for s in sets], "x array<int>, any_x boolean")
    got = {(r.a, r.b): r.n for r in gram_sums(df, {"x": 12}).collect()}
    assert got.pop((-1, -1)) == sum(bool(s) for s in sets)
    for a in range(12):
        for b in range(a, 12):
            assert got.get((a, b), 0) == sum(a in s and b in s for s in sets)


def test_svd_keeps_the_products(spark):
    import numpy as np

    rows = [(i, f"t{j}", float((i * j) % 4)) for i in range(6) for j in range(4) if (i * j) % 4]
    df = spark.createDataFrame(rows, "custid long, tok string, n double")
    got = {r.custid: np.array(r.factors) for r in represent.count_svd(df, "custid", "tok", 3).collect()}
    m = np.zeros((6, 4))
    for i, t, v in rows:
        m[i, int(t[1])] = v
    want = np.linalg.svd(m)[1][:2]  # one less than the three tokens there are
    assert np.allclose(np.sort(np.linalg.norm(np.array([got[k] for k in sorted(got)]), axis=0))[::-1], want, atol=1e-6)


def test_walks_follow_edges(spark):
    e = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y")], "c string, b string")
    w = represent.random_walks(e, "c", "b", walks=2, length=4)
    steps = {(r.start, r.walk, r.step): r.node for r in w.collect()}
    edges = {("a", "x"), ("a", "y"), ("b", "y")}
    for (s, k, i), node in steps.items():
        if i:
            assert (steps[s, k, i - 1], node) in edges or (node, steps[s, k, i - 1]) in edges
    assert len(steps) == 4 * 2 * 5


def test_label_propagation_finds_two_groups(spark):
    e = spark.createDataFrame([("a", "b", 5), ("b", "c", 5), ("a", "c", 5), ("x", "y", 5), ("y", "z", 5), ("x", "z", 5), ("c", "x", 1)], "u string, v string, w int")
    got = {r.node: r.community for r in represent.label_propagation(e, "u", "v", "w").collect()}
    assert len({got[n] for n in "abc"}) == 1 and len({got[n] for n in "xyz"}) == 1 and got["a"] != got["x"]


def test_tfidf_rows_have_length_one(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "a", 1)], "custid long, tok string, n long")
    s = represent.tfidf(df, "custid", "tok").groupBy("custid").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in s)


def test_subspace_iteration_equals_the_whole_decomposition(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, f"t{j:02d}", float(v)) for i in range(60) for j in range(30) if (v := rng.integers(0, 4) * (1 + 5 * (j < 4))) > 0]
    df = spark.createDataFrame(rows, "custid long, tok string, n double")
    a, b = ({r.custid: np.array(r.factors) for r in represent.count_svd(df, "custid", "tok", 3, held=h).collect()} for h in (4000, 5))
    assert a.keys() == b.keys() and max(np.abs(a[k] - b[k]).max() for k in a) < 0.05


def test_subword_vectors_share_parts(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([("abcde", Vectors.dense([1.0, 0.0])), ("abcdf", Vectors.dense([0.0, 1.0])), ("xyz", Vectors.dense([5.0, 5.0]))], ["word", "vector"])
    got = {r.word: r.vector.toArray() for r in represent.subword_vectors(df).collect()}
    assert np.allclose(got["xyz"], [5, 5]) and got["abcde"][1] > 0 and got["abcde"][0] > got["abcdf"][0]


def test_columns_by_name_and_guards(spark):
    df = spark.createDataFrame([(1, 2.0, float("inf"), None), (2, 4.0, float("nan"), 3.0)], "custid long, net_a double, x double, y_share double")
    assert clean.columns_like(df, ["net_"], ["share"], ["custid"]).columns == ["custid", "net_a", "y_share"]
    assert [tuple(r) for r in df.select(clean.finite(F.col("x")), clean.finite(F.col("y_share"))).collect()] == [(0.0, 0.0), (0.0, 3.0)]
    z = clean.z_scores(df, ["net_a", "x"], df.select("net_a", F.lit(1.0).alias("x"))).collect()
    assert [r.net_a for r in z] == [-1.0, 1.0] and [r.x for r in z] == [0.0, 0.0]
    assert [r.b for r in clean.quantile_bins(df, "y_share", df, 4, "b").collect()] == [None, 0]


def test_communities_that_swing_settle(spark):
    e = spark.createDataFrame([("a", "b", 1), ("c", "d", 1)], "u string, v string, w int")
    got = {r.node: r.community for r in represent.label_propagation(e, "u", "v", "w").collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_ppmi_vectors_by_either_way(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(int(e), f"t{j:02d}") for e in range(80) for j in range(30) if rng.random() < (0.5 if j % 3 == e % 3 else 0.1)]
    df = spark.createDataFrame(rows, "custid long, tok string")
    a, b = ({r.word: np.array(r.vector) for r in represent.ppmi_vectors(df, "custid", "tok", 2, 1, held=h).collect()} for h in (4000, 3))
    assert a.keys() == b.keys() and max(np.abs(a[w] - b[w]).max() for w in a) < 0.05


def test_products_are_summed_in_a_task(monkeypatch):
    """A batch's product goes into one sum as large as the basis, whatever the rows, in pieces of any size."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(40, size=n, replace=False).tolist()) for n in rng.integers(0, 9, size=60)]
    values = [rng.normal(size=len(r)).tolist() for r in rows]
    x = np.zeros((60, 40))
    for k, (i, v) in enumerate(zip(rows, values, strict=True)):
        x[k, i] = v
    q = rng.normal(size=(40, 3))
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))], names=["i", "v"])
    for piece in (100_000, 10, 1):
        monkeypatch.setattr(represent, "_AT_ONCE", piece)
        own = np.zeros_like(q)
        represent._gram_times(batch.slice(0, 25), q, own)
        represent._gram_times(batch.slice(25), q, own)
        assert np.allclose(own, x.T @ (x @ q))
