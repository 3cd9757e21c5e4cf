"""Matrices of many blocks: one shuffle for all of them, and the same rows as joins give."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean
from tidemark.operators.quantile import quantiles, quantiles_of
from tidemark.operators.ordered import with_position, with_previous
from tidemark.plans import encoders, matrix
from tidemark.plans.blocks import BLOCKS
from tidemark.session import cut
from tidemark.sources import sales as source

FEW = matrix.Config("few", ("base_agg", "freq_brand", "recent_3"), encodings=("oof_te_part",))


def _rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_gathered_is_on_spine(spark):
    spine = spark.createDataFrame([(i, "train" if i % 3 else "test") for i in range(40)], "custid long, split string")
    blocks = [spark.range(k, 50, k + 1).select(F.col("id").alias("custid"), (F.col("id") * k + 0.5).alias(f"a{k}"), F.when(F.col("id") % 2 == 0, F.col("id")).alias(f"b{k}")) for k in range(30)]
    got = clean.gathered(spine, blocks, "custid")
    assert got.columns == clean.on_spine(spine, blocks, "custid").columns
    assert _rows(got) == _rows(clean.on_spine(spine, blocks[:15], "custid").join(clean.on_spine(spine, blocks[15:], "custid"), ["custid", "split"]))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("config", [matrix.GENERAL, matrix.CODES])
def test_blocks_are_not_joined_in_one_plan(spark, data, config):
    few = matrix.Config("few", config.blocks[:4], products=config.products[:0], logs=config.logs)
    assert "Join" not in matrix.build(spark, data, few)._jdf.queryExecution().optimizedPlan().toString()


def test_customers_of_both_tables(spark, data, tmp_path):
    """Their rows are those of the joins: every row of a block for every row of the spine."""
    for t in ("train_transactions", "test_transactions", "y_train"):
        rows = spark.read.parquet(f"{data}/{t}.parquet")
        if t == "test_transactions":
            some = spark.read.parquet(f"{data}/train_transactions.parquet").where("custid is not null").agg(F.min("custid")).first()[0]
            rows = rows.unionByName(spark.read.parquet(f"{data}/train_transactions.parquet").where(F.col("custid") == some).limit(5))
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    got = matrix.build(spark, str(tmp_path), FEW)
    lines = {s: source.sales(spark, str(tmp_path), t) for s, t in matrix.TABLES.items()}
    spine = lines["train"].select("custid").distinct().withColumn("split", F.lit("train")).unionByName(lines["test"].select("custid").distinct().withColumn("split", F.lit("test")))
    want = clean.on_spine(spine, [matrix._rows(spark, str(tmp_path), n, lines) for n in FEW.names()], "custid")
    assert got.groupBy("custid").count().where("count > 1").count() == 1
    shown = lambda df: df.select("custid", "split", *[F.round(clean.finite(F.col(c)), 5).alias(c) for c in df.columns if c not in ("custid", "split")])
    assert _rows(shown(got)) == _rows(shown(want))
    assert not source._HELD


@pytest.mark.parametrize("held", [2_000_000, 30, 3])
def test_quantiles_of_columns(spark, held):
    df = spark.range(200).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 1.5).alias("b"), F.when(F.col("id") > 3, F.col("id") % 11).alias("c"), F.lit(None).cast("double").alias("d"), F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("id")).alias("e"))
    got = quantiles_of(df, df.columns, [0.01, 0.5, 0.99], held)
    assert set(got) == set(df.columns) and got["d"] == [None] * 3
    for c in "abce":
        assert got[c] == pytest.approx(quantiles(df, c, [0.01, 0.5, 0.99]))


def test_encoders_together(spark, data):
    """The encoders of both matrices by one plan: the columns of the single queries, in few jobs."""
    names = [n for n in (*matrix.GENERAL.names(), *matrix.CODES.names()) if encoders.kinds([n])]
    assert len(names) == 18
    lines = {t: source.placed(source.sales(spark, data, t)) for t in matrix.TABLES.values()}
    spark.sparkContext.setJobGroup("together", "")
    try:
        with source.held_lines(spark, data, lines):
            got = cut(encoders.together(spark, data, names))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("together")) < 100
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for n in ("oof_te_brand", "oof_te_transition", "hier_te_good_pc", "minsupport_te", "bayes_te", "rate_deviation"):
        want = cut(encoders.QUERIES[n](spark, data))
        both = want.join(got, "custid")
        assert both.count() == want.count() > 0
        assert both.where(" or ".join(f"not coalesce(abs({c} - {n}_{c}) < 2e-6, false)" for c in encoders.COLUMNS[n])).count() == 0


def test_places_of_kept_lines(spark, data):
    lines = source.sales(spark, data)
    key = ["custid", "d", "ts", "line_id"]
    got = source.placed(lines).where("line_id is not null")
    want = with_previous(with_position(lines, *key[:2], key[2:]), *key[:2], key[2:], source.PREVIOUS).where("line_id is not null")
    assert _rows(got.select(*key, *source.PLACES).fillna("-").fillna(-1)) == _rows(want.select(*key, *source.PLACES).fillna("-").fillna(-1))


def _placed_block(spark, data, name):
    """A block over lines kept with their places computes none, and has the rows of plain lines."""
    block = BLOCKS[name]
    plain, kept = (None, None)
    for t in block.tables:
        one = source.sales(spark, data, t)
        plain = one if plain is None else plain.unionByName(one)
        one = cut(source.placed(one))
        kept = one if kept is None else kept.unionByName(one)
    got = block.over(kept)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert _rows(got) == _rows(block.over(plain))


@pytest.mark.parametrize("name", ["group_switch", "velocity"])
def test_blocks_of_codes_over_kept_places(spark, data, name):
    _placed_block(spark, data, name)


@pytest.mark.parametrize("name", ["recent_3", "amount_slope", "switch_rate"])
def test_blocks_of_trees_over_kept_places(spark, data, name):
    _placed_block(spark, data, name)
