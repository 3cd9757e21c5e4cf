import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions.times import DAY_US
from tidemark.operators.entity_table import as_of, cumulative_table, entity_table

T0 = datetime(2025, 3, 1, 10, 0, 0)
DAY0 = (T0 - datetime(1970, 1, 1)).days
SHAPE = "e long, k int, t timestamp_ntz, v long, line long"


def make(spark, rows):
    return cumulative_table(spark.createDataFrame(rows, SHAPE), "e", "k", "t", "v", "line")


def test_windows_by_subtraction(spark):
    rows = [(1, 2, T0 + timedelta(days=d), 10 * (d + 1), d) for d in range(10)]
    got = as_of(make(spark, rows), DAY0 + 6, (3, 30)).first()
    assert (got.n, got.total, got.n_3, got.total_3, got.n_30) == (7, 280, 3, 50 + 60 + 70, 7)


def test_repeats_nulls_and_recency(spark):
    rows = [(1, 1, T0, 5, 1), (1, 1, T0, 5, 1), (1, 1, None, 7, 2), (1, None, T0, None, 3), (None, 1, T0, 9, 4), (1, 1, T0, 4, None), (1, 1, T0, 4, None)]
    now = (DAY0 + 2) * DAY_US
    r = entity_table(make(spark, rows), DAY0 + 1, now, [1, 2], (1,)).first()
    assert (r.entity, r.n, r.total) == (1, 5, 5 + 7 + 4 + 4)
    assert (r.n_k1, r.total_k1, r.n_k2, r.total_k2, r.days_since_k2) == (4, 20, 0, 0, None)
    assert abs(r.days_since_k1 - (1 + 14 / 24)) < 1e-9
    assert r.n_1 == 0


def test_empty(spark):
    assert entity_table(make(spark, []), DAY0, DAY0 * DAY_US, [1], (7,)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 1, T0, 5, 1, "a", "b")], SHAPE + ", day string, n string")
    assert cumulative_table(df, "e", "k", "t", "v", "line").first().cum_n == 1


def test_extended_equals_rebuilt(spark, tmp_path):
    """Batches with late events, lines delivered again, null times, kinds and lines, and a batch without rows."""
    from tidemark.operators.entity_table import EntityStore

    rng = random.Random(9)
    rows = []
    for i in range(400):
        t = None if rng.random() < 0.05 else datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 40))
        rows.append((rng.choice([1, 1, 2, 3, None]), rng.choice([1, 2, None]), t, rng.choice([None, 5, -7]), rng.choice([i, i, None])))
    rows += rng.sample([r for r in rows if r[4] is not None], 40)
    df = spark.createDataFrame(rows, "e long, k int, t timestamp_ntz, v long, l long")
    whole = df.withColumn("b", F.pmod(F.xxhash64("e", "t", "l"), F.lit(3)))
    store = EntityStore(spark, str(tmp_path / "a"))
    parts = [whole.where(f"b = {b}") for b in range(3)] + [whole.where("b = 0 and l is not null"), whole.where("false")]
    for b, part in enumerate(parts):
        store.append(b, part, "e", "k", "t", "v", "l")
    small = EntityStore(spark, str(tmp_path / "b"))
    store.compact(0, small)
    day = (datetime(2024, 1, 30) - datetime(1970, 1, 1)).days
    want = sorted(map(str, entity_table(cumulative_table(df, "e", "k", "t", "v", "l"), day, day * DAY_US, [1, 2], [7]).collect()))
    for s in (store, small):
        assert want == sorted(map(str, entity_table(s.cumulative(), day, day * DAY_US, [1, 2], [7]).collect()))
