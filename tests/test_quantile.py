"""Quantiles of columns and groups of any size against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.quantile import group_quantiles, quantiles
from tidemark.operators.rank import running_counts


def linear(vals, q):
    vals = sorted(vals)
    at = q * (len(vals) - 1)
    a, b = vals[math.floor(at)], vals[math.ceil(at)]
    return a + (b - a) * (at - math.floor(at))


def world(spark):
    rng = random.Random(2)
    rows = [(g, d, rng.choice([rng.randint(-5, 5), rng.randint(-(10**9), 10**9), 0])) for g in (1, 2, 3) for d in range(9) for _ in range(rng.choice([0, 1, 30]))]
    rows += [(1, 3, 77)] * 500 + [(4, 0, 5), (5, 0, None), (None, 0, 9)]
    return rows, spark.createDataFrame(rows, "g long, d int, v long")


@pytest.mark.parametrize("near", [[], ["g", "d"]])
def test_groups(spark, near):
    rows, df = world(spark)
    wanted = {"a": ("v", 0.5), "b": ("v", 0.9), "c": ("v", 0.0), "e": ("d", 0.25)}
    got = {r.g: r for r in group_quantiles(df.repartition("g", "d"), ["g"], wanted, near).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for g, r in got.items():
        vals, days = [v for k, _, v in rows if k == g and v is not None], [d for k, d, _ in rows if k == g]
        for name, (c, q) in wanted.items():
            own = vals if c == "v" else days
            assert r[name] == (pytest.approx(linear(own, q)) if own else None)
    assert group_quantiles(df.where("false"), ["g"], wanted, near).count() == 0


def test_running_counts_of_nan_and_no_key(spark):
    df = spark.createDataFrame([(1, 2.0), (1, float("nan")), (1, float("-inf")), (1, 2.0), (1, -0.5)], "g long, v double")
    got = [(str(r.v), r.n, r.upto, r.total) for r in running_counts(df, ["g"], "v").orderBy("upto").collect()]
    assert got == [("-inf", 1, 1, 5), ("-0.5", 1, 2, 5), ("2.0", 2, 4, 5), ("nan", 1, 5, 5)]
    assert {r.total for r in running_counts(df, [], "v").collect()} == {5}


@pytest.mark.parametrize("held", [1, 3, 2_000_000])
def test_whole_columns(spark, held):
    rows, df = world(spark)
    vals = [v for _, _, v in rows if v is not None]
    qs = [0.0, 0.1, 0.5, 0.999, 1.0]
    assert quantiles(df, "v", qs, held) == pytest.approx([linear(vals, q) for q in qs])
    near = spark.createDataFrame([(x,) for x in (1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0), 1.0)], "v double")
    assert quantiles(near, "v", [0.5], held) == [1.0]
    assert quantiles(df.select(F.lit(None).cast("double").alias("v")), "v", [0.5], held) == [None]


def test_bits_of_whole_numbers(spark):
    import numpy as np

    from tidemark.functions.bits import ordered_whole

    rng = random.Random(8)
    xs = [0, 1, 2, 3, 2**53 - 1, 2**53, 2**53 + 1, 2**62 + 12345, 2**63 - 1, *[2**k for k in range(63)], *[2**k - 1 for k in range(1, 63)], *[rng.randrange(2 ** rng.randrange(1, 63)) for _ in range(500)]]
    xs += [-x for x in xs]
    got = [r.k for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x long").select("i", ordered_whole(F.col("x")).alias("k")).orderBy("i").collect()]
    bits = np.abs(np.array(xs, dtype=float)).view(np.int64)
    assert got == [-int(b) if x < 0 else int(b) for x, b in zip(xs, bits, strict=True)]


@pytest.mark.parametrize("group", [0, 40, 200_000])
def test_groups_of_any_size(spark, group):
    """Keys that are sorted and keys that are counted in ranges have the same quantiles."""
    rows, df = world(spark)
    got = {r.g: r.q for r in group_quantiles(df, ["g"], {"q": ("v", 0.9)}, group=group).collect()}
    want = {g: [v for k, _, v in rows if k == g and v is not None] for g in (1, 2, 3, 4)}
    assert got == pytest.approx({g: linear(v, 0.9) for g, v in want.items()})
