import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.gram import gram_sums


@pytest.mark.parametrize("block", [4096, 7, 3, 1])
def test_blocks_of_items_change_nothing(spark, block):
    rng = random.Random(3)
    rows = [([rng.randrange(20) for _ in range(rng.choice([0, 1, 4, 12]))], sorted(rng.sample(range(5), rng.randrange(5)))) for _ in range(300)]
    rows = [(sorted(set(a)), b, bool(a), bool(b)) for a, b in rows] + [([0, 19], [], True, False)] * 200
    df = spark.createDataFrame(rows, "x array<int>, y array<int>, any_x boolean, any_y boolean")
    got = {(r.level, r.a, r.b): r.n for r in gram_sums(df, {"x": 20, "y": 5}, block=block, salts=3).where("n > 0").collect()}
    want = {(0, -1, -1): sum(r[2] for r in rows), (1, -1, -1): sum(r[3] for r in rows)}
    for level in (0, 1):
        for r in rows:
            for i, a in enumerate(r[level]):
                for b in r[level][i:]:
                    want[level, a, b] = want.get((level, a, b), 0) + 1
    assert got == want
    assert gram_sums(df.where("false"), {"x": 20, "y": 5}, block=block).where("a >= 0").count() == 0
    assert gram_sums(df.select(F.shuffle("x").alias("x"), "y", "any_x", "any_y"), {"x": 20, "y": 5}, block=block).where("level = 0 and a >= 0").count() == len([k for k in want if k[0] == 0 and k[1] >= 0])
