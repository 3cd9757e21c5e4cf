import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.splits import components, linked_groups, number_written, plan_splits, split_groups, split_rows

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


@pytest.mark.parametrize(
    "text, number",
    [("1234567", 1234567), ("123-4567", 1234567), ("C-1234567", 1234567), ("1,234,567", 1234567), ("1234567.0", 1234567), ("000001234567", 1234567), ("１２３４５６７", 1234567), (" 1 234 567 ", 1234567), ("1.234.567", 1234567), ("회원 아님", None), ("?", None), ("", None), (None, None), ("9" * 30, None)],
)
def test_number_written(spark, text, number):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(number_written(F.col("x"))).first()[0] == number


def union_find(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(1, 30)] + [(7, 7), (5, 6), (6, 5)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.root for r in components(df, "a", "b").collect()}
    assert got == union_find({x for e in edges for x in e}, edges)


def test_groups_pass_over_absent_ids_and_name_present_ones(spark):
    sales = spark.createDataFrame([(5,), (5,), (9,), (3,), (None,)], "custid long")
    links = spark.createDataFrame([(9, 1), (1, 5), (3, 3), (2, 4)], "a long, b long")
    got = {r.custid: (r.group_id, r.n_entities) for r in linked_groups(sales, "custid", links, "a", "b").collect()}
    assert got == {5: (5, 2), 9: (5, 2), 3: (3, 1)}
    none = spark.createDataFrame([], "a long, b long")
    assert linked_groups(sales, "custid", none, "a", "b").count() == 3
    assert linked_groups(spark.createDataFrame([], "custid long"), "custid", links, "a", "b").count() == 0


def test_plan_places_whole_items_and_parts_the_rest():
    items = [(False, 100, 0, 100, 0), (True, 700, 500, 150, 50), (True, 200, 150, 0, 50)]
    plan = plan_splits(items, SHARES)
    assert plan[0] == {"train": 1.0}
    for s, share in SHARES.items():
        assert abs(sum(x[1] * p.get(s, 0) for x, p in zip(items, plan, strict=True)) - share * 1000) < 60


def world(spark, n=3000, seed=5):
    rng = random.Random(seed)
    custids = [1] * (n // 3) + [rng.randint(2, 400) for _ in range(n)] + [None] * 60
    rows = spark.createDataFrame([(i, c, "x") for i, c in enumerate(custids)], "line_id long, custid long, split string")
    links = spark.createDataFrame([(1, 2), (2, 3), *[(rng.randint(2, 400), rng.randint(2, 400)) for _ in range(60)]], "a long, b long")
    labels = spark.createDataFrame([(c, rng.choice([0, 0, 1, None])) for c in range(1, 380)] + [(5, 0), (5, 1)], "custid long, gender int")
    return rows, links, labels


def test_shares_labels_and_groups(spark):
    rows, links, labels = world(spark)
    splits = split_groups(rows, "custid", links, "a", "b", labels, "gender", SHARES)
    assert splits.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    all_ = split_rows(rows.drop("split"), "custid", splits, SHARES, ["line_id"])
    got = {r.split: r["count"] for r in all_.groupBy("split").count().collect()}
    assert sum(got.values()) == rows.count() and None not in got
    for s, p in SHARES.items():
        assert abs(got[s] / rows.count() - p) < 0.03
    y = labels.dropDuplicates(["custid"]).where("gender is not null")
    rates = {r.split: r.g for r in all_.join(y, "custid").groupBy("split").agg(F.avg("gender").alias("g")).collect()}
    assert max(rates.values()) - min(rates.values()) < 0.15


def test_no_rows(spark):
    rows, links, labels = world(spark, 30)
    assert split_groups(rows.where("false"), "custid", links, "a", "b", labels, "gender", SHARES).count() == 0


def test_no_labels_and_no_links(spark):
    rows, links, labels = world(spark, 300)
    out = split_groups(rows, "custid", links.where("false"), "a", "b", labels.where("false"), "gender", SHARES)
    assert out.where("split is null").count() == 0
    assert out.select("custid").distinct().count() == out.count()
