from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import learn
from tidemark.operators.blend import auc
from tidemark.sources import predictions as p
from tidemark.streaming.windows import gaps, run_now, sessions, window_counts

T0 = datetime(2025, 1, 1, 9, 0, 0)


def test_prediction_sets(spark, tmp_path):
    root = str(tmp_path / "p")
    df = spark.createDataFrame([(1, "train", 0.5), (2, "train", 0.25), (9, "test", 0.75)], "custid long, split string, score double")
    p.save_predictions(df, root, "b", {"cv_auc": 0.7})
    p.save_predictions(df.where("custid <> 2"), root, "a", {"cv_auc": 0.6})
    assert p.list_models(spark, root) == ["a", "b"]
    assert p.list_models(spark, root, 2) == ["b"]
    assert p.load_predictions(spark, root, ["b"]).count() == 3
    p.write_submission(p.load_predictions(spark, root), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).collect()[0].asDict() == {"custid": "9", "gender": "0.75"}


def test_import_audit(spark):
    spine = spark.createDataFrame([(1,), (2,), (3,)], "custid long")
    foreign = spark.createDataFrame([(1, 0.5), (1, 0.7), (2, None), (8, 0.1)], "custid long, score double")
    got, audit = p.import_predictions(foreign, spine)
    assert audit == {"missing": 1, "nulls": 1, "repeated": 1, "unknown": 1}
    assert got.count() == 3


def test_log_in_another_encoding(spark, tmp_path):
    f = tmp_path / "log.csv"
    f.write_bytes("custid,brd_nm,net_amt\n1,가온,5\n2,,-3\n".encode("cp949"))
    rows = p.read_log(spark, str(f), "custid long, brd_nm string, net_amt long").collect()
    assert [(r.custid, r.brd_nm, r.net_amt) for r in rows] == [(1, "가온", 5), (2, None, -3)]


def test_report_begins_with_a_mark(spark, tmp_path):
    p.write_report(spark.createDataFrame([(1, "가")], "a int, b string"), str(tmp_path / "r"))
    text = next((tmp_path / "r").glob("part-*")).read_bytes()
    assert text.startswith("﻿a,b".encode())


def test_cache_and_tags(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert p.cached(spark, str(tmp_path), {"te": 1, "r": 12}, build).count() == 3
    assert len(calls) == 1
    both = p.union_tagged({"x": spark.range(1).withColumn("a", F.lit(1)), "y": spark.range(1)})
    assert {(r.dataset, r.a) for r in both.collect()} == {("x", 1), ("y", None)}
    assert p.optional_table(spark, str(tmp_path / "none")) is None


def test_training_goes_on_after_a_stop(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, i % 3, float(i % 2) + (i % 7) / 20) for i in range(90)], "custid long, label int, fold int, x double")
    data = learn.assemble(rows, ["x"], ["custid", "label", "fold"])
    store, fits = p.FoldStore(spark, str(tmp_path / "f")), []

    def make():
        fits.append(1)
        return learn.learner("logistic", regParam=0.01)

    first = learn.oof_predict(make, data, folds=3, store=store)
    assert len(fits) == 3 and auc(first.join(rows, "custid"), []).first()["auc"] > 0.95
    learn.oof_predict(make, data, folds=3, store=store)
    assert len(fits) == 3
    store.clear()
    assert store.read(0) is None


def _stream(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "custid long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_stream_windows_sessions_and_gaps(spark, tmp_path):
    rows = [(1, T0), (1, T0 + timedelta(minutes=30)), (1, T0 + timedelta(minutes=61)), (2, T0 + timedelta(days=1))]
    s = _stream(spark, tmp_path, rows)
    days = run_now(window_counts(s, "ts", ["custid"]), "complete").collect()
    assert sorted((r.custid, r.n) for r in days) == [(1, 3), (2, 1)]
    got = run_now(sessions(s, "ts", "custid"), "complete").collect()
    assert sorted((r.custid, r.n) for r in got) == [(1, 1), (1, 2), (2, 1)]
    g = run_now(gaps(s, "ts", "custid")).collect()
    assert sorted((r.gap_s for r in g if r.gap_s is not None)) == [1800.0, 1860.0]


def test_trials_are_kept(spark, tmp_path):
    log = p.TrialLog(spark, str(tmp_path / "t"))
    assert log.tried("a") == []
    for c, v in ((0.1, 0.7), (1.0, 0.72)):
        log.add("a", {"C": c}, v)
    log.add("b", {"C": 5}, 0.9)
    assert log.tried("a") == [({"C": 1.0}, 0.72), ({"C": 0.1}, 0.7)]
