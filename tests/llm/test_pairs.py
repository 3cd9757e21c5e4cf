import math
import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from tidemark.llm.pairs import pairs_together


def brute(rows, least, lift):
    baskets = {}
    for b, x in rows:
        if b is not None and x:
            baskets.setdefault(b, set()).add(x)
    one, two = Counter(), Counter()
    for s in baskets.values():
        one.update(s)
        two.update(combinations(sorted(s), 2))
    n = len(baskets)
    return {(a, b): (c, one[a], one[b], n) for (a, b), c in two.items() if c >= least and c * n >= lift * one[a] * one[b]}


def run(spark, rows, least=3, lift=0.0):
    df = spark.createDataFrame([(b, x, "z", 1, 2) for b, x in rows], "basket long, item string, level string, no int, n int")
    out = pairs_together(df, {"b": F.col("basket")}, {"item": F.col("item")}, least, lift).collect()
    return {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_baskets) for r in out}, out


def world(seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 60) if rng.random() > 0.02 else None, rng.choice(["a", "b", "c", "가", "Z", "rare", "", None])) for _ in range(600)]
    return rows + [(1, x) for x in "abc"] * 40  # one basket delivered over and over


def test_counts_against_brute_force(spark):
    for seed in (1, 2):
        for lift in (0.0, 1.05):
            rows = world(seed)
            assert run(spark, rows, 3, lift)[0] == brute(rows, 3, lift)


def test_measures(spark):
    _, out = run(spark, world(3))
    for r in out:
        want = r.n_ab * r.n_baskets / (r.n_a * r.n_b)
        assert abs(r.lift - want) < 1e-9
        assert r.n_ab == r.n_baskets or abs(r.npmi - math.log(want) / -math.log(r.n_ab / r.n_baskets)) < 1e-9


def test_one_huge_basket_and_two_levels(spark):
    rows = [(i % 3, f"i{j}") for i in range(3) for j in range(300)]
    got, _ = run(spark, rows, 3)
    assert len(got) == 300 * 299 // 2
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", "y"), (2, "b", None)], "basket long, p string, q string")
    out = pairs_together(df, {"b": F.col("basket")}, {"p": F.col("p"), "q": F.col("q")}, 1).collect()
    assert [(r.item_level, r.item_a, r.item_b, r.n_baskets) for r in out] == [("p", "a", "b", 2)]


def test_nothing(spark):
    assert run(spark, [])[0] == {} and run(spark, [(None, "a"), (1, None), (1, "")])[0] == {}


def test_exact_threshold(spark):
    # n_ab * N == 5 * n_a * n_b counts
    rows = [(i, "a") for i in range(2)] + [(i, "b") for i in range(2)] + [(i, "z") for i in range(10)]
    assert ("a", "b") in run(spark, rows, 2, 5.0)[0]
    assert ("a", "b") not in run(spark, rows, 2, 5.1)[0]
