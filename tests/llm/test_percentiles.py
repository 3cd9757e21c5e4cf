import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import percentiles as P
from tidemark.llm.percentiles import from_histogram, histogram, merge, ordered, percentiles, value_of

QS = [0.0, 0.25, 0.5, 0.9, 1.0]


def world(spark, seed=1, n=3000):
    rng = random.Random(seed)
    rows = [(1, rng.lognormvariate(8, 3) * rng.choice([1, 1, -1])) for _ in range(n // 2)] + [(rng.randint(2, 60), float(rng.randint(-5, 5))) for _ in range(n // 2)]
    rows += [(None, 4.0), (99, None), (98, float("nan")), (97, 1e300), (97, -1e-300), (97, float("inf"))]
    return rows, spark.createDataFrame([(g, v, "x") for g, v in rows], "g long, v double, k string")


def exact(vals, q):
    vals = sorted(vals)
    n = len(vals)
    return vals[max(1, n - math.floor(n - n * q)) - 1]


def groups(rows):
    out = {}
    for g, v in rows:
        if g is not None and v is not None and not math.isnan(v):
            out.setdefault(g, []).append(v)
    return out


def test_exact_against_sorting(spark):
    rows, df = world(spark)
    got = {(r.g, r.q): r.value for r in percentiles(df, "g", "v", QS).collect()}
    want = {(g, q): exact(vals, q) for g, vals in groups(rows).items() for q in QS}
    assert got == want


def test_two_levels_bound_the_value(spark):
    rows, df = world(spark, 2)
    vals = groups(rows)
    for r in percentiles(df, "g", "v", QS, levels=(48, 32)).collect():
        x = exact(vals[r.g], r.q)
        assert r.low <= x <= r.high and (r.low == r.high or abs(r.high - r.low) <= 2**-20 * max(abs(r.low), abs(r.high)))


def test_parts_merge_to_the_whole(spark):
    rows, df = world(spark, 3)
    parts = df.withColumn("day", F.pmod(F.hash("v"), F.lit(5)))
    merged = merge(histogram(parts, ["g", "day"], "v"), ["g"])
    whole = histogram(df, ["g"], "v")
    assert merged.exceptAll(whole.select(merged.columns)).where("g is not null").count() == 0
    vals = groups(rows)
    for r in from_histogram(merged.where("g is not null"), ["g"], QS).collect():
        x = exact(vals[r.g], r.q)
        assert r.low <= x <= r.high
        assert x == r.value or abs(r.value - x) <= 2**-12 * abs(x)


def test_order_is_kept_and_turned_back(spark):
    xs = [float("-inf"), -1e308, -2.5, -5e-324, 0.0, 5e-324, 0.1, 1.0, 2.0**60, float("inf")]
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("k", ordered(F.col("x")))
    rows = df.withColumn("y", value_of(F.col("k"))).collect()
    assert [r.k for r in rows] == sorted(r.k for r in rows) and [r.y for r in rows] == xs
    assert spark.createDataFrame([(-0.0,)], "x double").select(ordered(F.col("x"))).first()[0] == 0


def test_equal_values_whole_numbers_and_empty(spark):
    df = spark.createDataFrame([(1, 7)] * 50 + [(2, -3)], "g long, v long")
    assert {(r.g, r.value) for r in percentiles(df, "g", "v", QS).collect()} == {(1, 7.0), (2, -3.0)}
    assert percentiles(df.where("false"), "g", "v", QS).count() == 0


def test_the_bits_are_those_of_the_double(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [2.0**k for k in range(-1074, 1024, 7)], [np.nextafter(2.0**k, 0) for k in range(-1000, 1024, 9)], [np.nextafter(2.0**k, np.inf) for k in range(-1000, 1023, 9)], [0.0, -0.0, np.inf, -np.inf, 5e-324, 2.0**-1022, np.finfo(float).max, 1e15 + 0.5]])
    x = np.concatenate([x, -x])
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").select("i", P.ordered(F.col("x")).alias("k")).orderBy("i").toPandas()["k"].to_numpy()
    bits = np.abs(x).view(np.int64)
    assert (got == np.where(x < 0, -bits, bits)).all()


@pytest.mark.parametrize("kind", ["long", "int", "double"])
def test_whole_numbers_and_doubles_are_alike(spark, kind, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [(g, rng.choice([0, -1, 3, 70_000, -70_001, rng.randint(-(2**30), 2**30)])) for g in range(5) for _ in range(rng.choice([1, 2, 50, 400]))]
    df = spark.createDataFrame([(g, float(v) if kind == "double" else v) for g, v in rows], f"g int, v {kind}")
    monkeypatch.setattr(P, "FOLLOWED", rng.choice([0, 20_000]))
    for r in P.percentiles(df, "g", "v", [0.0, 0.1, 0.5, 0.99, 1.0]).collect():
        own = sorted(v for g, v in rows if g == r.g)
        want = next(v for i, v in enumerate(own) if (i + 1) / len(own) >= r.q)
        assert r.value == want and r.low == r.high == want and r.n == len(own)
