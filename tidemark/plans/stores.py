"""Queries of sources and sinks: what is written to the shared folder comes back as it was."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import blend
from tidemark.operators.clean import columns_like, finite, logistic, per_visit, quantile_bins, z_scores
from tidemark.plans import blending
from tidemark.plans.blocks import BLOCKS
from tidemark.plans.encoders import folds_of
from tidemark.session import shared_folder
from tidemark.sources import predictions as store
from tidemark.sources.sales import sales, sales_sql
from tidemark.sources.tables import table

#: The models that the stores hold.
KEPT = ["m2", "m4", "m6"]
LOG = "line_id bigint, custid bigint, str_nm string, team_nm string, net_amt bigint"


def _r(c: str, digits: int = 6):
    return F.round(F.col(c).cast("double") + 1e-10, digits).alias(c)


def log_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Lines written as CSV in cp949 and read with a stated schema."""
    rows = table(spark, folder, "train_transactions").selectExpr(*[f"{c.split()[0]}" for c in LOG.split(", ")])

    @F.pandas_udf("string")
    def coded(s):
        return s.map(lambda x: x.encode("cp949", "replace").decode("latin-1") if x is not None else None)

    at = shared_folder(spark, "log")
    rows.select("line_id", "custid", coded("str_nm").alias("str_nm"), coded("team_nm").alias("team_nm"), "net_amt").write.option("header", True).option("encoding", "iso-8859-1").csv(at)
    return store.read_log(spark, at, LOG)


def tagged_union(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables under one another with their tag, the labels only where there are any."""
    labels = folds_of(spark, folder).select("custid", "label")
    train, test = (sales(spark, folder, t, "net_amt").select("line_id", "custid", "net_amt") for t in ("train_transactions", "test_transactions"))
    rows = store.union_tagged({"train": train.join(labels, "custid", "left"), "test": test})
    return rows.groupBy("dataset", "label").agg(F.count("*").alias("n"), F.sum("net_amt").alias("net"))


def _kept(spark: SparkSession, folder: str) -> str:
    """A prediction store with three models, one of them broken: a score is missing."""
    at, rows = shared_folder(spark, "scores"), blending.predictions(spark, folder)
    for m in KEPT:
        own = rows.where(F.col("model") == m)
        store.save_predictions(own, at, m, {"seed": 42, "features": m})
    store.save_predictions(rows.where("model = 'm1'").withColumn("score", F.when(F.col("custid") % 100 != 0, F.col("score"))), at, "broken", {"seed": 1})
    return at


def prediction_store(spark: SparkSession, folder: str) -> DataFrame:
    """Saved, discovered if whole, loaded."""
    at = _kept(spark, folder)
    whole = table(spark, folder, "customer").where("c_custkey % 5 < 3").count()
    return store.load_predictions(spark, at, store.list_models(spark, at, whole)).select("model", "custid", "split", _r("score", 5))


def model_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The facts saved beside the scores, taken out of their JSON."""
    meta = spark.read.parquet(f"{_kept(spark, folder)}/models")
    return meta.select(F.col("model").cast("string").alias("model"), F.get_json_object("meta", "$.seed").cast("int").alias("seed"), F.get_json_object("meta", "$.features").alias("features"))


def submission(spark: SparkSession, folder: str) -> DataFrame:
    """One sorted CSV of test scores, read back with its line's place."""
    at = shared_folder(spark, "submission")
    store.write_submission(blending.predictions(spark, folder).where("model = 'm4'"), at)
    rows = spark.read.schema("custid bigint, gender double").option("header", True).csv(at)
    # one file, so the ids that grow with the line say whether it is sorted
    rows = rows.withColumn("line", F.monotonically_increasing_id())
    return rows.select("custid", _r("gender"), "line")


def report_bom(spark: SparkSession, folder: str) -> DataFrame:
    """A report whose header begins with a byte-order mark: its columns and rows."""
    at = shared_folder(spark, "report")
    store.write_report(BLOCKS["base_agg"].spark(spark, folder).select("custid", "n_lines"), at)
    # a report is small: its file is one row here
    head = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(at).select(F.hex(F.substring("content", 1, 3)).alias("mark"))
    rows = spark.read.option("header", True).csv(at)
    return rows.select(F.col(rows.columns[0]).cast("long").alias("custid"), F.col("n_lines").cast("double").alias("n_lines")).crossJoin(F.broadcast(head))


def _external(spark: SparkSession, folder: str) -> DataFrame:
    """A foreign CSV of test scores: some customers twice, some missing, some unknown."""
    at = shared_folder(spark, "foreign")
    rows = blending.predictions(spark, folder).where("model = 'm5' and split = 'test'").select("custid", "score")
    foreign = rows.where("custid % 7 <> 0").unionByName(rows.where("custid % 11 = 0")).unionByName(rows.select((F.col("custid") + 10_000_000).alias("custid"), "score").where("custid % 50 = 0"))
    foreign.orderBy(F.xxhash64("custid")).write.option("header", True).csv(at)
    return spark.read.schema("custid bigint, score double").option("header", True).csv(at)


def external_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Foreign scores on the own customers, ranked; missing ones are null."""
    spine = table(spark, folder, "customer").where("c_custkey % 5 >= 3").select(F.col("c_custkey").alias("custid"))
    got, _ = store.import_predictions(_external(spark, folder), spine)
    ranked = blend.rank_normalise(got.where("score is not null"), [], "score")
    return spine.join(ranked, "custid", "left").select("custid", _r("score"), _r("r"))


def external_audit(spark: SparkSession, folder: str) -> DataFrame:
    spine = table(spark, folder, "customer").where("c_custkey % 5 >= 3").select(F.col("c_custkey").alias("custid"))
    _, audit = store.import_predictions(_external(spark, folder), spine)
    return spark.createDataFrame([(k, int(v)) for k, v in audit.items()], "what string, n long")


def blend_export(spark: SparkSession, folder: str) -> DataFrame:
    """Two variants of a blend, over all models and without the late ones, saved as models of their own."""
    at, ranks = shared_folder(spark, "export"), blending.ranks(spark, folder)
    for name, members in {"all": blending.MODELS, "early": blend.pool(blending.MODELS, ["m5", "m6"])}.items():
        rows = ranks.where(F.col("model").isin(members)).groupBy("custid", "split").agg(F.round(F.avg("r"), 9).alias("score"))
        store.save_predictions(rows, at, name, {"members": members})
    return store.load_predictions(spark, at).select("model", "custid", "split", _r("score", 5))


def blend_reproduction(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a saved blend ranks as one made anew, and as another one."""
    ranks = blending.ranks(spark, folder).where("split = 'test'")
    one = lambda ms: ranks.where(F.col("model").isin(ms)).groupBy("custid").agg(F.round(F.avg("r"), 9).alias("score"))
    rows = [(name, *blend.reproduces(one(blending.MODELS), one(ms), "custid")) for name, ms in (("same", blending.MODELS), ("fewer", blending.MODELS[:3]))]
    return spark.createDataFrame(rows, "variant string, reproduces boolean, corr double").withColumn("corr", F.round("corr", 6))


def feature_list(spark: SparkSession, folder: str) -> DataFrame:
    """The names of a block's columns as JSON, written and read."""
    at = shared_folder(spark, "columns")
    names = columns_like(BLOCKS["base_agg"].spark(spark, folder), ["net_"], ["share"]).columns
    spark.createDataFrame([(json.dumps(names),)], "value string").coalesce(1).write.text(at)
    read = spark.read.text(at).select(F.posexplode(F.from_json("value", "array<string>")).alias("place", "name"))
    return read.select("name")


def fold_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Results by fold, broken off after two folds and taken up again: done folds are read."""
    folds, keep = folds_of(spark, folder), store.FoldStore(spark, shared_folder(spark, "folds"))
    out = None
    for run in ((0, 1), range(5)):
        for k in run:
            done = keep.read(k)
            if done is None:
                done = keep.write(k, folds.where(F.col("fold") == k).groupBy("fold", "label").agg(F.count("*").alias("n")).withColumn("run", F.lit(len(run))))
            out = done if k == 0 else out.unionByName(done)
    return out


def cached_block(spark: SparkSession, folder: str) -> DataFrame:
    """A block from its cache: the second call reads what the first has written."""
    at, builds = shared_folder(spark, "cache"), []

    def build() -> DataFrame:
        builds.append(1)
        return BLOCKS["behavior"].spark(spark, folder)

    for _ in range(2):
        rows = store.cached(spark, at, {"block": "behavior", "version": 1}, build)
    return rows.withColumn("builds", F.lit(len(builds)))


def optional_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """Dimensions that may be missing, with their rows."""
    got = {n: store.optional_table(spark, f"{folder}/{n}.parquet") for n in ("brand_meta", "no_such_table")}
    return spark.createDataFrame([(n, df is not None, df.count() if df is not None else 0) for n, df in got.items()], "name string, there boolean, n long")


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """A study of blends that goes on where it stood: each trial is kept, the best comes first."""
    log = store.TrialLog(spark, shared_folder(spark, "trials"))
    ranks = blending.ranks(spark, folder).where("split = 'train'")
    for w in (0.2, 0.5, 0.8):
        if {"w": w} not in [p for p, _ in log.tried("pair")]:
            log.add("pair", {"w": w}, blend.recipe_auc(ranks, {"m3": w, "m6": 1 - w}))
    return spark.createDataFrame([(i, p["w"], v) for i, (p, v) in enumerate(log.tried("pair"))], "place int, w double, auc double").withColumn("auc", F.round("auc", 6))


def scalars(spark: SparkSession, folder: str) -> DataFrame:
    """Functions of single values: times from text and back, absolute windows, patterns taken by the letter,
    JSON, logistic and logit, guarded numbers."""
    rows = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"), "ts", "value", "props")
    text = F.date_format("ts", "yyyyMMdd HHmm")
    hm = F.hour("ts") * 100 + F.minute("ts")
    x = F.col("value") / 100
    return rows.select(
        "event_id",
        F.date_format(F.try_to_timestamp(text, F.lit("yyyyMMdd HHmm")), "yyyy-MM-dd HH:mm").alias("parsed"),
        F.try_to_timestamp(F.concat(text, F.lit("x")), F.lit("yyyyMMdd HHmm")).isNull().alias("unparsed"),
        hm.alias("hhmm"),
        (F.floor(hm / 100) * 60 + hm % 100).cast("long").alias("minutes"),
        F.date_format(F.expr("make_timestamp(year(ts), month(ts), day(ts), cast(floor((hour(ts) * 100 + minute(ts)) / 100) as int), minute(ts), 0)"), "yyyy-MM-dd HH:mm").alias("from_parts"),
        F.expr("ts between timestamp_ntz'2024-01-10 00:00:00' and timestamp_ntz'2024-01-20 00:00:00'").alias("in_window"),
        F.col("props").contains('{"k"').alias("by_letter"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        _named(logistic(x), "logistic"),
        _named(F.log(logistic(x) / (1 - logistic(x))), "logit"),
        _named(finite(F.when(F.col("event_id") % 3 == 0, F.lit(float("inf"))).when(F.col("event_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("value"))), "guarded"),
    )


def _named(c, name: str, digits: int = 6):
    return F.round(c + 1e-10, digits).alias(name)


def fitted_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of the test customers by what the train customers say: z-scores, quantile bins, per-visit counts."""
    block = BLOCKS["base_agg"]
    train, test = (type(block)(block.steps, [t]).spark(spark, folder).select("custid", "n_lines", "n_brands", "visit_days", "net_mean") for t in ("train_transactions", "test_transactions"))
    out = quantile_bins(z_scores(test, ["net_mean"], train), "n_lines", train, 10, "bin")
    out = per_visit(out, ["n_lines", "n_brands"], "visit_days")
    return out.select("custid", _r("net_mean", 5), F.col("bin").cast("long").alias("bin"), _r("n_lines_per_visit"), _r("n_brands_per_visit"))


QUERIES = {
    f.__name__: f
    for f in (log_csv, tagged_union, prediction_store, model_facts, submission, report_bom, external_scores, external_audit, blend_export, blend_reproduction, feature_list, fold_resume, cached_block, optional_dimension, trials, scalars, fitted_columns)
}


def _q(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-10, {digits}) AS {name}"


_FOREIGN = "f AS (SELECT custid, score FROM p WHERE model = 'm5' AND split = 'test'), x AS (SELECT * FROM f WHERE custid % 7 <> 0 UNION ALL SELECT * FROM f WHERE custid % 11 = 0 UNION ALL SELECT custid + 10000000, score FROM f WHERE (custid + 10000000) % 50 = 0), c AS (SELECT c_custkey AS custid FROM customer WHERE c_custkey % 5 >= 3)"
_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0) / count(*) OVER ()"
_LIST = [c for c in BLOCKS["base_agg"].steps[-1][1] if c != "custid" and (c.startswith("net_") or "share" in c)]
_PAIR = "SELECT {0}::DOUBLE AS w, custid, label, round(sum(CASE model WHEN 'm3' THEN {0} ELSE 1 - {0} END * r), 9) AS s FROM r WHERE split = 'train' AND model IN ('m3', 'm6') GROUP BY custid, label"
SQL = {
    "log_csv": "SELECT line_id, custid, str_nm, team_nm, net_amt FROM train_transactions",
    "tagged_union": f"""WITH {sales_sql()}, {sales_sql("test_transactions", "st")}, e AS (SELECT custid, min(gender) AS label FROM y_train WHERE custid IS NOT NULL AND gender IS NOT NULL GROUP BY custid HAVING min(gender) = max(gender))
SELECT 'train' AS dataset, label, count(*) AS n, sum(net_amt)::BIGINT AS net FROM s LEFT JOIN e USING (custid) GROUP BY label UNION ALL SELECT 'test', NULL, count(*), sum(net_amt)::BIGINT FROM st HAVING count(*) > 0""",
    "prediction_store": f"WITH {blending.PRED} SELECT model, custid, split, {_q('score::FLOAT', 'score', 5)} FROM p WHERE model IN ('m2', 'm4', 'm6')",
    "model_facts": "SELECT * FROM (VALUES ('m2', 42, 'm2'), ('m4', 42, 'm4'), ('m6', 42, 'm6'), ('broken', 1, NULL)) t(model, seed, features)",
    "submission": f"WITH {blending.PRED} SELECT custid, {_q('score', 'gender')}, row_number() OVER (ORDER BY custid) - 1 AS line FROM p WHERE model = 'm4' AND split = 'test'",
    "report_bom": f"WITH {sales_sql()} SELECT custid, count(*)::DOUBLE AS n_lines, 'EFBBBF' AS mark FROM s GROUP BY custid",
    "external_scores": f"WITH {blending.PRED}, {_FOREIGN}, y AS (SELECT custid, avg(score) AS score FROM x JOIN c USING (custid) GROUP BY custid), z AS (SELECT *, {_RANK.format('score')} AS k FROM y) SELECT custid, {_q('score', 'score')}, {_q('k', 'r')} FROM c LEFT JOIN z USING (custid)",
    "external_audit": f"""WITH {blending.PRED}, {_FOREIGN} SELECT 'missing' AS what, count(*) AS n FROM c WHERE custid NOT IN (SELECT custid FROM x) UNION ALL SELECT 'nulls', 0 UNION ALL
SELECT 'repeated', count(*) FROM (SELECT custid FROM x JOIN c USING (custid) GROUP BY custid HAVING count(*) > 1) UNION ALL SELECT 'unknown', count(DISTINCT custid) FROM x WHERE custid NOT IN (SELECT custid FROM c)""",
    "blend_export": f"WITH {blending.PRED} SELECT v.v AS model, custid, split, {_q('round(avg(r.r), 9)::FLOAT', 'score', 5)} FROM r, (VALUES ('all'), ('early')) v(v) WHERE v.v = 'all' OR model NOT IN ('m5', 'm6') GROUP BY ALL",
    "blend_reproduction": f"WITH {blending.PRED}, a AS (SELECT custid, round(avg(r), 9) AS s FROM r WHERE split = 'test' GROUP BY custid), b AS (SELECT custid, round(avg(r), 9) AS s FROM r WHERE split = 'test' AND model IN ('m1', 'm2', 'm3') GROUP BY custid), "
    f"x AS (SELECT custid, {_RANK.format('s')} AS k FROM a), y AS (SELECT custid, {_RANK.format('s')} AS k FROM b), z AS (SELECT corr(x.k, y.k) AS c FROM x JOIN y USING (custid)) SELECT 'same' AS variant, true AS reproduces, 1.0::DOUBLE AS corr UNION ALL SELECT 'fewer', c >= 0.9999, round(c, 6) FROM z",
    "feature_list": "SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in _LIST) + ") t(name)",
    "fold_resume": "WITH e AS (SELECT custid, min(gender) AS label FROM y_train WHERE custid IS NOT NULL AND gender IS NOT NULL GROUP BY custid HAVING min(gender) = max(gender)), "
    "f AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY md5('42-' || custid), custid) - 1) % 5 AS fold FROM e) SELECT fold::INTEGER AS fold, label, count(*) AS n, CASE WHEN fold < 2 THEN 2 ELSE 5 END AS run FROM f GROUP BY ALL",
    "cached_block": f"SELECT *, 1 AS builds FROM ({BLOCKS['behavior'].sql()})",
    "optional_dimension": "SELECT 'brand_meta' AS name, true AS there, count(*) AS n FROM brand_meta UNION ALL SELECT 'no_such_table', false, 0",
    "trials": f"WITH {blending.PRED}, s AS ({' UNION ALL '.join(_PAIR.format(w) for w in (0.2, 0.5, 0.8))}), a AS (SELECT a.w, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS auc FROM s a JOIN s b ON a.w = b.w WHERE a.label = 1 AND b.label = 0 GROUP BY a.w) "
    "SELECT CAST(row_number() OVER (ORDER BY auc DESC, w) - 1 AS INTEGER) AS place, w, round(auc, 6) AS auc FROM a",
    "scalars": f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS parsed, true AS unparsed, hour(ts) * 100 + minute(ts) AS hhmm, hour(ts) * 60 + minute(ts) AS minutes, strftime(ts, '%Y-%m-%d %H:%M') AS from_parts,
ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' AS in_window, contains(props, '{{"k"') AS by_letter, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
{_q("1 / (1 + exp(-value / 100))", "logistic")}, {_q("value / 100", "logit")}, {_q("CASE WHEN event_id % 3 = 2 THEN coalesce(value, 0) ELSE 0 END", "guarded")} FROM events""",
    "fitted_columns": f"""WITH {sales_sql()}, {sales_sql("test_transactions", "st")}, a AS (SELECT custid, count(*) AS n, round(avg(net_amt) + 1e-10, 6) AS m FROM s GROUP BY custid), b AS (SELECT custid, count(*) AS n, count(DISTINCT brand) AS k, count(DISTINCT d) AS v, round(avg(net_amt) + 1e-10, 6) AS m FROM st GROUP BY custid),
f AS (SELECT avg(m) AS mu, stddev_pop(m) AS sd, list_distinct(quantile_cont(n, [{", ".join(str(i / 10) for i in range(1, 10))}])) AS q FROM a)
SELECT custid, {_q("(m - mu) / sd", "net_mean", 5)}, len([x FOR x IN q IF x < n]) AS bin, {_q("n / (v + 1e-5)", "n_lines_per_visit")}, {_q("k / (v + 1e-5)", "n_brands_per_visit")} FROM b, f""",
}
