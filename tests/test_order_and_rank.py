import random
from datetime import datetime, timedelta

from tidemark.operators.ordered import with_position, with_previous
from tidemark.operators.quantile import quantiles
from tidemark.operators.rank import average_rank, digest_rank, spread_rank

T0 = datetime(2025, 1, 1)


def lines(spark, n=200):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 3]), T0 + timedelta(hours=rng.randint(0, 300)), i, rng.choice(["a", "b", None])) for i in range(n)]
    df = spark.createDataFrame(rows, "custid long, ts timestamp_ntz, line_id long, c string")
    return df.selectExpr("*", "cast(ts as date) as d"), rows


def test_previous_and_position_follow_the_whole_order(spark):
    df, rows = lines(spark)
    prev = {r.line_id: (r.prev_c, r.has_prev) for r in with_previous(df, "custid", "d", ["ts", "line_id"], ["c"]).collect()}
    pos = {r.line_id: (r.pos, r.pos_back, r.n_rows) for r in with_position(df, "custid", "d", ["ts", "line_id"]).collect()}
    for c in (1, 2, 3):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(own):
            assert pos[r[2]] == (i, len(own) - 1 - i, len(own))
            assert prev[r[2]] == ((own[i - 1][3], True) if i else (None, False))


def test_spread_rank_has_no_gap(spark):
    df = spark.createDataFrame([(k % 3 if k % 7 else None, k, k % 5) for k in range(500)], "g int, id int, w int")
    rows = spread_rank(df, ["g"], ["id"], salts=8).collect()
    for g in (0, 1, 2, None):
        ranks = sorted(r["rank"] for r in rows if r.g == g)
        assert ranks == list(range(len(ranks)))
    sums = spread_rank(df, ["g"], ["id"], weight="w", name="before", salts=8).collect()
    for g in (0, 1, 2, None):
        own = sorted(((r.before, r.w) for r in sums if r.g == g))
        at = 0
        for before, w in own:
            assert before <= at
            at = max(at, before + w)
        assert at == sum(w for _, w in own)


def test_digest_rank_is_the_order_of_the_digests(spark):
    import hashlib

    df = spark.createDataFrame([(k % 2, k) for k in range(300)], "g int, id int")
    got = {r.id: r["rank"] for r in digest_rank(df, ["g"], "id", 42).collect()}
    for g in (0, 1):
        ids = sorted((k for k in range(300) if k % 2 == g), key=lambda k: (hashlib.md5(f"42-{k}".encode()).hexdigest(), k))
        assert [got[k] for k in ids] == list(range(len(ids)))


def test_average_rank_with_ties(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, *range(20)]), i) for i in range(400)]
    got = {r.id: (r["rank"], r.rank_n) for r in average_rank(spark.createDataFrame(rows, "g string, v int, id int"), ["g"], "v", pieces=5).collect()}
    for g in "ab":
        vals = [r[1] for r in rows if r[0] == g and r[1] is not None]
        for r in rows:
            if r[0] == g and r[1] is not None:
                below, same = sum(v < r[1] for v in vals), sum(v == r[1] for v in vals)
                assert got[r[2]] == (below + (same + 1) / 2, len(vals))
    assert len(got) == sum(r[1] is not None for r in rows)
    assert average_rank(spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "v double"), [], "v").agg({"rank": "max"}).first()[0] == 3.0


def test_quantiles_of_either_way(spark):
    import numpy as np

    rng = random.Random(7)
    xs = [rng.lognormvariate(3, 2) for _ in range(3000)] + [5.0] * 400
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "v double")
    qs = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    for held in (10_000, 20):
        assert np.allclose(quantiles(df, "v", qs, held), np.quantile(xs, qs), rtol=1e-12)
    assert quantiles(df.where("false"), "v", [0.5]) == [None]
