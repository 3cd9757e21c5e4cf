"""Random walks by both ways, and vectors over them."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import represent, walks

EDGES = [(f"c{i}", f"b{j}") for i in range(40) for j in range(12) if (i * 7 + j * 3) % 5 < 2]


def test_held_and_joined_walks_are_the_walks_of_the_hash(spark):
    e = spark.createDataFrame([*EDGES, ("c1", None), EDGES[0]], "c string, b string")
    by = {}
    for held in (20_000_000, 0):
        names, lists = walks.walk_lists(e, "c", "b", 3, 6, held=held)
        name = {r.no: r.node for r in names.collect()}
        by[held] = {(name[r.no], r.walk): [name[x] for x in r.nodes] for r in lists.collect()}
    assert by[0] == by[20_000_000] and len(by[0]) == 3 * len({x for kv in EDGES for x in kv})
    # every step draws the neighbour at xxhash64(seed, start, walk, step) modulo their number
    rows = represent.random_walks(e, "c", "b", 3, 6).withColumn("h", F.xxhash64(F.lit(42), "start", "walk", F.col("step") + 1)).collect()
    ways = {(r.start, r.walk, r.step): r for r in rows}
    near = {n: sorted({b for a, b in EDGES if a == n} | {a for a, b in EDGES if b == n}) for n in {x for kv in EDGES for x in kv}}
    drawn = {}
    for (start, walk, step), r in ways.items():
        if step < 6:
            drawn.setdefault((r.node, r.h % len(near[r.node])), set()).add(ways[start, walk, step + 1].node)
    assert all(len(v) == 1 for v in drawn.values()) and all(v <= set(near[n]) for (n, _), v in drawn.items())


def test_rows_that_come_again():
    rng = np.random.default_rng(0)
    at, y = rng.integers(0, 5, 300), rng.normal(size=(300, 4))
    want = np.zeros((5, 4))
    np.add.at(want, at, y)
    got = np.zeros((5, 4))
    walks._add_rows(got, at, y.copy(), np.inf)
    assert np.allclose(got, want)
    walks._add_rows(got := np.zeros((5, 4)), at, y.copy())
    assert np.allclose(got, want * np.minimum(1, 0.5 / np.linalg.norm(want, axis=1))[:, None])


def test_node_vectors_tell_communities_in_one_partition_and_in_three(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{i}", f"b{i % 2}_{j}") for i in range(120) for j in rng.choice(15, 6, replace=False)] + [(f"c{i}", f"b{(i + 1) % 2}_0") for i in range(0, 120, 10)]
    # one brand of all
    e = spark.createDataFrame(rows + [(f"c{i}", "hot") for i in range(120)], "c string, b string")
    names, lists = walks.walk_lists(e, "c", "b")
    for partitions in (1, 3):
        got = {r.word: np.array(r.vector) for r in walks.node_vectors(names, lists, 64, partitions=partitions).collect()}
        assert len(got) == 120 + 31 and all(v.shape == (64,) and np.isfinite(v).all() and np.linalg.norm(v) < 10 for v in got.values())
        x = np.array([got[f"c{i}"] for i in range(120)])
        x = x - x.mean(0)
        x /= np.linalg.norm(x, axis=1)[:, None]
        cos, same = x @ x.T, (np.arange(120)[:, None] - np.arange(120)) % 2 == 0
        assert cos[same & ~np.eye(120, dtype=bool)].mean() > 0.2 > -0.1 > cos[~same].mean()


def test_vectors_of_no_walks(spark):
    names, lists = walks.walk_lists(spark.createDataFrame([], "c string, b string"), "c", "b")
    assert walks.node_vectors(names, lists).collect() == []
