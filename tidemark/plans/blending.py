"""Queries of rank algebra, blending, pseudo-labels and diagnostics, over made prediction sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import blend, diagnose, pseudo
from tidemark.sources.tables import table

#: Six models' scores of every customer, made of its key and balance and, in growing part, the label.
MODELS = [f"m{k}" for k in range(1, 7)]
RECIPES = {"base": {"m1": 0.2, "m2": 0.3, "m3": 0.5}, "late": {"m4": 0.7, "m6": 0.3}, "all": {m: 1 / 6 for m in MODELS}}
_KEY = "(cast(abs(round(c_acctbal * 100)) as bigint) * {a} + c_custkey * {b}) % 1009"
_SCORE = {f"m{k}": f"cast({_KEY.format(a=7 + 2 * k, b=31 * k)} as double) / 1009 * {1 - k / 20} + {k / 20} * label" for k in range(1, 7)}


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """``model, custid, split, label, score``."""
    rows = table(spark, folder, "customer").selectExpr("c_custkey", "c_acctbal", "c_custkey as custid", "case when c_nationkey % 3 = 0 then 1 else 0 end as label", "case when c_custkey % 5 < 3 then 'train' else 'test' end as split")
    rows = rows.selectExpr("custid", "split", "label", *[f"{e} as {m}" for m, e in _SCORE.items()])
    return rows.unpivot(["custid", "split", "label"], MODELS, "model", "score")


PRED = (
    "c0 AS (SELECT c_custkey, c_acctbal, c_custkey AS custid, CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 0 END AS label, CASE WHEN c_custkey % 5 < 3 THEN 'train' ELSE 'test' END AS split FROM customer),\n"
    "p AS (" + " UNION ALL ".join(f"SELECT custid, split, label, '{m}' AS model, {e} AS score FROM c0" for m, e in _SCORE.items()) + "),\n"
    "r AS (SELECT *, (rank() OVER w + (count(*) OVER (PARTITION BY model, split, score) - 1) / 2.0) / count(*) OVER (PARTITION BY model, split) AS r FROM p WINDOW w AS (PARTITION BY model, split ORDER BY score))"
)


def ranks(spark: SparkSession, folder: str) -> DataFrame:
    return blend.rank_normalise(predictions(spark, folder), ["model", "split"])


def _r(c: str, digits: int = 6):
    return F.round(F.col(c) + 1e-10, digits).alias(c)


def rank_norm(spark: SparkSession, folder: str) -> DataFrame:
    return ranks(spark, folder).select("model", "custid", "split", _r("r"))


def auc(spark: SparkSession, folder: str) -> DataFrame:
    return blend.auc(predictions(spark, folder).where("split = 'train'"), ["model"]).select("model", _r("auc"), "n_pos", "n_neg")


def weighted_recipe(spark: SparkSession, folder: str) -> DataFrame:
    rows, out = ranks(spark, folder).where("split = 'test'"), None
    for name, weights in RECIPES.items():
        one = blend.weighted_blend(rows, weights, ["custid"]).withColumns({"recipe": F.lit(name), "blend": F.round("blend", 9)})
        out = one if out is None else out.unionByName(one)
    return blend.rank_normalise(out, ["recipe"], "blend").select("recipe", "custid", _r("r"))


def power_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranks(spark, folder).where("split = 'test'").groupBy("custid").agg(*[blend.power_mean(F.col("r"), k).alias(f"p{k}") for k in (2, 3, 8)])
    return rows.select("custid", *[_r(f"p{k}") for k in (2, 3, 8)])


def rank_corr(spark: SparkSession, folder: str) -> DataFrame:
    w = blend.wide(ranks(spark, folder).where("split = 'train'"), MODELS, ["custid"])
    return blend.rank_correlations(w, MODELS).select("model_a", "model_b", _r("corr"))


def uncertainty_stats(spark: SparkSession, folder: str) -> DataFrame:
    s = F.greatest(F.least(F.col("r"), F.lit(1 - 1e-6)), F.lit(1e-6))
    rows = ranks(spark, folder).groupBy("custid").agg(
        F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.avg(-(s * F.ln(s) + (1 - s) * F.ln(1 - s))).alias("entropy"), F.min("r").alias("min"), F.max("r").alias("max"), F.sum(F.when(F.col("r") >= 0.5, 1).otherwise(0)).alias("n_high")
    )
    return rows.withColumn("spread", F.col("max") - F.col("min")).select("custid", *[_r(c) for c in ("mean", "std", "entropy", "min", "max", "spread")], "n_high")


def drop_one(spark: SparkSession, folder: str) -> DataFrame:
    return blend.drop_one(ranks(spark, folder).where("split = 'train'"), "custid", "label").select("model", _r("loss"))


def _teacher(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo.teacher(ranks(spark, folder).where("split = 'test'"), "custid", ["m2", "m4", "m6"]).withColumn("p", F.round("p", 9))


def pseudo_select(spark: SparkSession, folder: str) -> DataFrame:
    scores, out = _teacher(spark, folder), None
    for mode, args in {"hard": {"high": 0.7, "low": 0.3}, "consensus": {"high": 0.55, "low": 0.45}, "quota": {"share": 0.1}, "quantile": {"share": 0.25}, "soft": {"share": 0.2}}.items():
        one = pseudo.select_rows(scores, "custid", mode, **args).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out.select("mode", "custid", _r("target"), _r("weight"))


def disagreement(spark: SparkSession, folder: str) -> DataFrame:
    p = predictions(spark, folder).where("split = 'train'").withColumn("r", F.col("score"))
    return diagnose.disagreement(blend.wide(p, MODELS[:3], ["custid", "label"]), MODELS[:3], "label").select("pattern", "n", _r("positive_rate"))


def ks_gini_lift(spark: SparkSession, folder: str) -> DataFrame:
    return diagnose.ks_gini_lift(predictions(spark, folder).where("split = 'train'"), ["model"]).select("model", *[_r(c) for c in ("gini", "ks", "lift", "top_share")])


def psi(spark: SparkSession, folder: str) -> DataFrame:
    p = predictions(spark, folder)
    return diagnose.psi(p.where("split = 'train'"), p.where("split = 'test'"), keys=["model"]).select("model", _r("psi"))


def hill_climb(spark: SparkSession, folder: str) -> DataFrame:
    w = blend.wide(ranks(spark, folder).where("split = 'train'"), MODELS, ["custid", "label"])
    return spark.createDataFrame(list(blend.hill_climb(w, MODELS, "label", 100).items()), "model string, weight double")


def stability_selection(spark: SparkSession, folder: str) -> DataFrame:
    w = blend.wide(ranks(spark, folder).where("split = 'train'"), MODELS, ["custid", "label"])
    return spark.createDataFrame(list(blend.stable_members(w, MODELS, "label", "custid").items()), "model string, frequency double")


def weight_search(spark: SparkSession, folder: str) -> DataFrame:
    w = blend.wide(ranks(spark, folder).where("split = 'train'"), MODELS, ["custid", "label"])
    return spark.createDataFrame(list(blend.search_weights(w, MODELS, "label", rounds=80).items()), "model string, weight double")


def logloss_weights(spark: SparkSession, folder: str) -> DataFrame:
    w = blend.wide(ranks(spark, folder).where("split = 'train'"), MODELS, ["custid", "label"])
    return spark.createDataFrame(list(blend.logloss_weights(w, MODELS, "label").items()), "model string, weight double")


def recipe_aucs(spark: SparkSession, folder: str) -> DataFrame:
    """The recipes' AUC over the train rows; a member without scores has a proxy, a recipe with neither none."""
    rows = ranks(spark, folder).where("split = 'train'")
    recipes = RECIPES | {"proxy": {"outside": 0.5, "m4": 0.5}, "lacking": {"nowhere": 0.5, "m4": 0.5}}
    found = [(n, blend.recipe_auc(rows, w, proxies={"outside": "m6"})) for n, w in recipes.items()]
    return spark.createDataFrame(found, "recipe string, auc double").withColumn("auc", F.round("auc", 6))


def error_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Customers by how many of three models are right, with mean balance and orders against all."""
    p = predictions(spark, folder).where("split = 'train'").withColumn("r", F.col("score"))
    side = table(spark, folder, "customer").select(F.col("c_custkey").alias("custid"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    wide = blend.wide(p, MODELS[3:], ["custid", "label"]).join(side, "custid")
    out = diagnose.error_groups(wide, MODELS[3:], "label", ["balance", "nation"])
    return out.select("error_group", "n", *[_r(c, 4) for c in ("share", "positive_rate", "balance", "nation", "balance_ratio", "nation_ratio")])


def teacher_gate(spark: SparkSession, folder: str) -> DataFrame:
    w = blend.wide(ranks(spark, folder).where("split = 'train'"), MODELS, ["custid"])
    return diagnose.teacher_gate(w, "m1", MODELS[1:], 0.1).select("model", _r("corr"), "passes")


def shrunk_blend(spark: SparkSession, folder: str) -> DataFrame:
    """A recipe drawn towards equal weights."""
    rows = ranks(spark, folder).where("split = 'test'")
    return blend.weighted_blend(rows, blend.shrink(RECIPES["base"], 0.75), ["custid"]).select("custid", _r("blend"))


def gap_corr(spark: SparkSession, folder: str) -> DataFrame:
    """How the gap of two models' ranks goes along with the label, by split."""
    w = blend.wide(ranks(spark, folder), MODELS, ["custid", "split", "label"])
    return diagnose.gap_correlation(w, ["split"], "m6", "m2", "label").select("split", "n", _r("corr"))


QUERIES = {
    "recipe_aucs": recipe_aucs,
    "error_groups": error_groups,
    "teacher_gate": teacher_gate,
    "shrunk_blend": shrunk_blend,
    "gap_corr": gap_corr,
    "rank_norm": rank_norm,
    "auc": auc,
    "weighted_recipe": weighted_recipe,
    "blend_power_mean": power_mean,
    "rank_corr": rank_corr,
    "uncertainty_stats": uncertainty_stats,
    "drop_one": drop_one,
    "pseudo_select": pseudo_select,
    "disagreement": disagreement,
    "ks_gini_lift": ks_gini_lift,
    "psi": psi,
    "hill_climb": hill_climb,
    "stability_selection": stability_selection,
    "weight_search": weight_search,
    "logloss_weights": logloss_weights,
}


def _q(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-10, 6) AS {name}"


def _auc(src: str, score: str, key: str = "model") -> str:
    """By definition: pairs of a positive and a negative."""
    return f"SELECT {key}, avg(CASE WHEN a.{score} > b.{score} THEN 1.0 WHEN a.{score} = b.{score} THEN 0.5 ELSE 0 END) AS auc FROM {src} a JOIN {src} b USING ({key}) WHERE a.label = 1 AND b.label = 0 GROUP BY {key}"


_BLENDS = " UNION ALL ".join(
    f"SELECT '{n}' AS recipe, custid, round(sum(CASE model {' '.join(f'WHEN {chr(39)}{m}{chr(39)} THEN {w!r}' for m, w in ws.items())} END * r), 9) AS b FROM r WHERE split = 'test' AND model IN ({', '.join(repr(m) for m in ws)}) GROUP BY custid" for n, ws in RECIPES.items()
)
_TEACH = "t AS (SELECT custid, round(avg(r), 9) AS p, min(r) AS lo, max(r) AS hi FROM r WHERE split = 'test' AND model IN ('m2', 'm4', 'm6') GROUP BY custid)"
_SEL = f"SELECT '{{}}' AS mode, custid, {_q('CASE WHEN p >= 0.5 THEN 1 ELSE 0 END', 'target')}, {_q('2 * abs(p - 0.5)', 'weight')} FROM {{}} WHERE {{}}"

_MIX = {**RECIPES, "proxy": {"m6": 0.5, "m4": 0.5}}
_MIXED = " UNION ALL ".join(f"SELECT '{n}' AS recipe, custid, label, round(sum(CASE model {' '.join(f'WHEN {chr(39)}{m}{chr(39)} THEN {w!r}' for m, w in ws.items())} END * r), 9) AS s FROM r WHERE split = 'train' AND model IN ({', '.join(repr(m) for m in ws)}) GROUP BY custid, label" for n, ws in _MIX.items())
SQL = {
    "recipe_aucs": f"WITH {PRED}, b AS ({_MIXED}) SELECT recipe, round(auc, 6) AS auc FROM ({_auc('b', 's', 'recipe')}) UNION ALL SELECT 'lacking', NULL",
    "error_groups": f"""WITH {PRED}, x AS (SELECT custid, label, list(model) FILTER ((score >= 0.5) = (label = 1)) AS good FROM p WHERE split = 'train' AND model IN ('m4', 'm5', 'm6') GROUP BY custid, label),
y AS (SELECT CASE coalesce(len(good), 0) WHEN 3 THEN 'all right' WHEN 0 THEN 'all wrong' WHEN 1 THEN 'only ' || good[1] ELSE '2 right' END AS error_group, label, c_acctbal AS b, c_nationkey::DOUBLE AS k FROM x JOIN customer ON c_custkey = custid), z AS (SELECT count(*) AS n, avg(b) AS b, avg(k) AS k FROM y)
SELECT error_group, count(*) AS n, {", ".join(f"round(CAST({e} AS DOUBLE) + 1e-10, 4) AS {n}" for n, e in {"share": "count(*) / any_value(z.n)", "positive_rate": "avg(label)", "balance": "avg(y.b)", "nation": "avg(y.k)", "balance_ratio": "avg(y.b) / (any_value(z.b) + 1e-9)", "nation_ratio": "avg(y.k) / (any_value(z.k) + 1e-9)"}.items())} FROM y, z GROUP BY error_group""",
    "teacher_gate": f"WITH {PRED} SELECT b.model, {_q('corr(a.r, b.r)', 'corr')}, corr(a.r, b.r) < 0.1 AS passes FROM r a JOIN r b ON a.custid = b.custid AND a.model = 'm1' AND b.model <> 'm1' WHERE a.split = 'train' GROUP BY b.model",
    "shrunk_blend": f"WITH {PRED} SELECT custid, {_q('sum(r * CASE model WHEN ' + chr(39) + 'm1' + chr(39) + ' THEN 0.75 * 0.2 + 0.25 / 3 WHEN ' + chr(39) + 'm2' + chr(39) + ' THEN 0.75 * 0.3 + 0.25 / 3 ELSE 0.75 * 0.5 + 0.25 / 3 END)', 'blend')} FROM r WHERE split = 'test' AND model IN ('m1', 'm2', 'm3') GROUP BY custid",
    "gap_corr": f"WITH {PRED} SELECT a.split, count(*) AS n, {_q('corr(a.r - b.r, a.label)', 'corr')} FROM r a JOIN r b USING (custid) WHERE a.model = 'm6' AND b.model = 'm2' GROUP BY a.split",
    "rank_norm": f"WITH {PRED} SELECT model, custid, split, {_q('r', 'r')} FROM r",
    "auc": f"WITH {PRED}, t AS (SELECT * FROM p WHERE split = 'train') SELECT model, {_q('auc', 'auc')}, n_pos, n_neg FROM ({_auc('t', 'score')}) JOIN (SELECT model, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM t GROUP BY model) USING (model)",
    "weighted_recipe": f"WITH {PRED}, b AS ({_BLENDS}) SELECT recipe, custid, {_q('(rank() OVER (PARTITION BY recipe ORDER BY b) + (count(*) OVER (PARTITION BY recipe, b) - 1) / 2.0) / count(*) OVER (PARTITION BY recipe)', 'r')} FROM b",
    "blend_power_mean": f"WITH {PRED} SELECT custid, {', '.join(_q(f'pow(avg(pow(greatest(least(r, 1), 1e-6), {k})), 1.0::DOUBLE / {k})', f'p{k}') for k in (2, 3, 8))} FROM r WHERE split = 'test' GROUP BY custid",
    "rank_corr": f"WITH {PRED} SELECT a.model AS model_a, b.model AS model_b, {_q('corr(a.r, b.r)', 'corr')} FROM r a JOIN r b ON a.custid = b.custid AND a.model < b.model WHERE a.split = 'train' GROUP BY ALL",
    "uncertainty_stats": f"WITH {PRED}, s AS (SELECT *, greatest(least(r, 1 - 1e-6), 1e-6) AS s FROM r) SELECT custid, {_q('avg(r)', 'mean')}, {_q('stddev_pop(r)', 'std')}, {_q('avg(-(s * ln(s) + (1 - s) * ln(1 - s)))', 'entropy')}, {_q('min(r)', 'min')}, {_q('max(r)', 'max')}, {_q('max(r) - min(r)', 'spread')}, count(*) FILTER (r >= 0.5) AS n_high FROM s GROUP BY custid",
    "drop_one": f"WITH {PRED}, t AS (SELECT * FROM r WHERE split = 'train'), w AS (SELECT a.model, b.custid, b.label, round(avg(b.r), 9) AS s FROM (SELECT DISTINCT model FROM t) a JOIN t b ON a.model <> b.model GROUP BY ALL), "
    f"f AS (SELECT 'all' AS model, custid, label, round(avg(r), 9) AS s FROM t GROUP BY custid, label) SELECT x.model, {_q('y.auc - x.auc', 'loss')} FROM ({_auc('w', 's')}) x, ({_auc('f', 's')}) y",
    "pseudo_select": f"WITH {PRED}, {_TEACH}, n AS (SELECT t.*, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k, floor(count(*) OVER () * 0.1) AS q, count(*) OVER () AS n FROM t), "
    "e AS (SELECT t.*, (SELECT quantile_cont(p, 0.25) FROM t) AS a, (SELECT quantile_cont(p, 0.75) FROM t) AS b FROM t) "
    + " UNION ALL ".join(_SEL.format(*x) for x in (("hard", "t", "p >= 0.7 OR p <= 0.3"), ("consensus", "t", "lo >= 0.55 OR hi <= 0.45"), ("quota", "n", "k <= q OR k > n - q"), ("quantile", "e", "p <= a OR p >= b")))
    + f" UNION ALL SELECT 'soft', custid, {_q('p', 'target')}, {_q('2 * abs(p - 0.5)', 'weight')} FROM t WHERE abs(p - 0.5) >= 0.2",
    "disagreement": f"WITH {PRED}, x AS (SELECT custid, label, string_agg(CASE WHEN (score >= 0.5) = (label = 1) THEN '1' ELSE '0' END, '' ORDER BY model) AS pattern FROM p WHERE split = 'train' AND model IN ('m1', 'm2', 'm3') GROUP BY custid, label) SELECT pattern, count(*) AS n, {_q('avg(label)', 'positive_rate')} FROM x GROUP BY pattern",
    "ks_gini_lift": f"""WITH {PRED}, t AS (SELECT * FROM r WHERE split = 'train'), n AS (SELECT model, sum(label) AS np, count(*) AS n FROM t GROUP BY model),
k AS (SELECT model, max(abs(cp / np - (cc - cp) / (n - np))) AS ks FROM (SELECT model, sum(label) OVER w AS cp, count(*) OVER w AS cc FROM t WINDOW w AS (PARTITION BY model ORDER BY score)) JOIN n USING (model) GROUP BY model),
l AS (SELECT model, avg(label) AS top, sum(label) AS tops FROM t WHERE r > 0.9 GROUP BY model)
SELECT model, {_q("2 * auc - 1", "gini")}, {_q("ks", "ks")}, {_q("top / (np / n)", "lift")}, {_q("tops / np", "top_share")} FROM k JOIN n USING (model) JOIN l USING (model) JOIN ({_auc("t", "score")}) USING (model)""",
    "psi": f"""WITH {PRED}, e AS (SELECT model, quantile_cont(score, [{", ".join(str(i / 10) for i in range(1, 10))}]) AS q FROM p WHERE split = 'train' GROUP BY model),
b AS (SELECT model, split, len([x FOR x IN q IF x < score]) AS bin FROM p JOIN e USING (model)),
c AS (SELECT model, bin, count(*) FILTER (split = 'train') / sum(count(*) FILTER (split = 'train')) OVER (PARTITION BY model) AS e, count(*) FILTER (split = 'test') / sum(count(*) FILTER (split = 'test')) OVER (PARTITION BY model) AS a FROM b GROUP BY model, bin)
SELECT model, {_q("sum((greatest(a, 1e-6) - greatest(e, 1e-6)) * ln(greatest(a, 1e-6) / greatest(e, 1e-6)))", "psi")} FROM c GROUP BY model""",
}
