"""Queries of the out-of-fold encoders over sales lines and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.encode import WHOLE, by_fold, category_counts, entity_folds, fold_means, hierarchical_encode, join_rate, leave_out, line_rates, line_scores, smoothed, target_encode, weighted_std
from tidemark.operators.ordered import with_position, with_previous
from tidemark.operators.quantile import quantiles
from tidemark.session import cut, if_small
from tidemark.sources.sales import sales, sales_sql
from tidemark.sources.tables import table

#: Categories as they are encoded: none is a category of its own.
ENCODED = {"brand": "coalesce(brand, 'nan')", "corner": "coalesce(corner_nm, 'nan')", "part": "coalesce(part_nm, 'nan')", "pc": "coalesce(pc_nm, 'nan')", "good": "code", "buyer": "coalesce(buyer_nm, 'nan')", "store": "coalesce(str_nm, 'nan')"}
#: Cross tokens: two categories in one, encoded as the others.
_ZONE = "case when h <= 11 then 'a' when h <= 14 then 'b' when h <= 17 then 'c' else 'd' end"
_SEASON = "case when mon between 3 and 5 then 'spring' when mon between 6 and 8 then 'summer' when mon between 9 and 11 then 'fall' else 'winter' end"
CROSSED = {"pc_zone": f"coalesce(pc_nm, 'nan') || '|' || {_ZONE}", "store_month": "coalesce(str_nm, 'nan') || '|' || cast(mon as string)", "part_zone": f"{ENCODED['part']} || '|' || {_ZONE}", "part_season": f"{ENCODED['part']} || '|' || {_SEASON}", "corner_brand": f"{ENCODED['corner']} || '|' || {ENCODED['brand']}", "store_part": f"{ENCODED['store']} || '_' || {ENCODED['part']}"}
#: Children and parents of the hierarchical encoders.
PAIRS = {"brand_pc": ("brand", "pc"), "good_brand": ("good", "brand"), "corner_part": ("corner", "part"), "good_pc": ("good", "pc"), "brand_part": ("brand", "part")}
TRAIN, TEST = "train_transactions", "test_transactions"
# Lines that name nothing.
JUNK = "(good = '2700000000000' or pc_nm = '미확인pc' or corner_nm = '용기보증')"


def tidy(c: str, digits: int = 6) -> Column:
    return F.round(F.col(c).cast("double") + 1e-10, digits).alias(c)


def folds_of(spark: SparkSession, folder: str) -> DataFrame:
    return entity_folds(table(spark, folder, "y_train"), "custid", "gender")


def labelled(spark: SparkSession, folder: str, uses: str | None = None) -> DataFrame:
    """Lines of labelled customers, with label and fold."""
    return sales(spark, folder, TRAIN, uses).join(if_small(folds_of(spark, folder)), "custid")


def both(spark: SparkSession, folder: str, uses: str) -> DataFrame:
    """Lines of labelled customers with label and fold, and of the test customers, whose fold is ``WHOLE``."""
    test = sales(spark, folder, TEST, uses).withColumns({"label": F.lit(None).cast("int"), "fold": F.lit(WHOLE)})
    return labelled(spark, folder, uses).unionByName(test)


def _prior(spark: SparkSession, folder: str) -> float:
    return float(folds_of(spark, folder).agg(F.coalesce(F.avg("label"), F.lit(0.5))).first()[0])


def _counts(spark: SparkSession, folder: str, where: str = "true", **keys: str) -> tuple[DataFrame, DataFrame]:
    """How often labelled customers (with label and fold) and test customers have each combination of the
    named categories."""
    uses = " ".join([where, *keys.values()])
    train, test = (category_counts(sales(spark, folder, t, uses).where(where).selectExpr("custid", *[f"{e} as {k}" for k, e in keys.items()]), "custid", list(keys)) for t in (TRAIN, TEST))
    return cut(train.join(folds_of(spark, folder), "custid")), cut(test)


def _with_test(counts: DataFrame, test: DataFrame) -> DataFrame:
    return counts.unionByName(test.withColumns({"label": F.lit(None).cast("int"), "fold": F.lit(WHOLE)}))


def label_fold(spark: SparkSession, folder: str) -> DataFrame:
    return folds_of(spark, folder)


def label_fold_10(spark: SparkSession, folder: str) -> DataFrame:
    """Ten folds of another seed."""
    return entity_folds(table(spark, folder, "y_train"), "custid", "gender", 10, 7)


def oof_te(column: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        counts, test = _counts(spark, folder, token=column)
        out = target_encode(counts, test, "custid", "token", _prior(spark, folder))
        return out.select("custid", *[tidy(c) for c in out.columns if c != "custid"])

    return run


def oof_transition(spark: SparkSession, folder: str) -> DataFrame:
    """The step from the customer's corner before to this one, encoded as a category."""
    made = []
    for t in (TRAIN, TEST):
        rows = sales(spark, folder, t, "corner_nm")
        if "prev_corner_nm" not in rows.columns:
            rows = with_previous(rows, "custid", "d", ["ts", "line_id"], ["corner_nm"])
        made.append(category_counts(rows.selectExpr("custid", "coalesce(prev_corner_nm, 'START') || '>' || coalesce(corner_nm, 'nan') as token"), "custid", ["token"]))
    out = target_encode(cut(made[0].join(folds_of(spark, folder), "custid")), made[1], "custid", "token", _prior(spark, folder))
    return out.select("custid", *[tidy(c) for c in out.columns if c != "custid"])


def hier_te(child: str, parent: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        counts, test = _counts(spark, folder, parent=ENCODED[parent], child=ENCODED[child])
        out = hierarchical_encode(counts, test, "custid", "child", "parent", _prior(spark, folder))
        return out.select("custid", *[tidy(c) for c in out.columns if c != "custid"])

    return run


#: The step from the corner before, where lines were kept with it.
_STEP_TOKEN = "coalesce(prev_corner_nm, 'START') || '>' || coalesce(corner_nm, 'nan')"
_NOT_JUNK = "case when coalesce(not {0}, true) then {1} end"
_BAYES = {"good": "code", "g9": "substring(code, 1, 9)", "g6": "substring(code, 1, 6)", "pc_nm": ENCODED["pc"], "buyer_nm": ENCODED["buyer"]}


def kinds(names: list[str]) -> list[tuple[str, str, str, str, str]]:
    """(how, query, column, token, parent) of every category that the queries ``names`` encode."""
    out = []
    for n in names:
        if n == "oof_te_transition":
            out.append(("oof", n, "", _STEP_TOKEN, "''"))
        elif n.startswith("oof_te_"):
            out.append(("oof", n, "", (ENCODED | CROSSED)[n[7:]], "''"))
        elif n.startswith("hier_te_"):
            child, parent = PAIRS[n[8:]]
            out.append(("hier", n, "", ENCODED[child], ENCODED[parent]))
        elif n == "minsupport_te":
            out += [("least", n, f"te_{c}", (ENCODED | CROSSED)[c], "''") for c in ("brand", "corner", "part", "store_part")]
        elif n == "bayes_te":
            out += [("bayes", n, f"te_{c}", _NOT_JUNK.format(JUNK, e), "''") for c, e in _BAYES.items()]
        elif n == "rate_deviation":
            out.append(("far", n, "skew", "substring(code, 1, 6)", "''"))
    return out


def together(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """``custid`` and the columns of the queries ``names`` (of ``kinds``) as <query>_<column>, by one plan for
    all. Lines are kept with their places, and no customer is in both tables. The lines'
    categories get numbers, and labels are added up by number and fold; then how often a customer has each
    number, and the means over them. Definitions are those of the single queries."""
    every = kinds(names)
    folds, prior = if_small(cut(folds_of(spark, folder))), _prior(spark, folder)
    train, test = (sales(spark, folder, t) for t in (TRAIN, TEST))
    tokens = F.expr("array(" + ", ".join(f"struct({k} as k, {e} as token, {p} as parent)" for k, (_, _, _, e, p) in enumerate(every)) + ")").alias("t")
    lines = train.join(folds, "custid").select("custid", "d", "fold", "label", tokens).unionByName(test.select("custid", "d", F.lit(WHOLE).alias("fold"), F.lit(None).cast("int").alias("label"), tokens))
    rows = lines.select("custid", "d", "fold", "label", F.explode("t").alias("t")).select("custid", "d", "fold", "label", "t.*").where("token is not null")

    # what the encoders see without each fold, and (the last) of all
    own = rows.groupBy("k", "parent", "token", "fold").agg(F.coalesce(F.sum("label"), F.lit(0)).alias("s"), F.count("label").alias("m"))
    sums = [F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in ("s", "m") for f in range(5)] + [F.sum(c).alias(f"{c}5") for c in ("s", "m")]
    per = cut(own.groupBy("k", "parent", "token").agg(*sums).withColumn("id", F.monotonically_increasing_id()))
    above = per.groupBy(F.col("k").alias("uk"), F.col("parent").alias("up")).agg(*[F.sum(f"{c}{i}").alias(f"u{c}{i}") for c in ("s", "m") for i in range(6)])
    how = {h: [k for k, x in enumerate(every) if x[0] == h] for h in ("oof", "hier", "least", "bayes", "far")}
    p = F.lit(prior)
    all_ = F.when(F.col("um5") > 0, F.col("us5") / F.col("um5")).otherwise(0.5)
    x, u = [], []
    for i in range(6):
        s, m, us, um = (F.col(f"{c}{i}") for c in ("s", "m", "us", "um"))
        top = smoothed(us, um, p, 20.0)
        seen = F.when(um > 0, us / um).otherwise(all_)
        ways = {"oof": smoothed(s, m, p, 20.0), "hier": smoothed(s, m, top, 10.0), "least": F.when(m < 10, seen).otherwise(s / m), "bayes": smoothed(s, m, all_, 20.0), "far": F.when(m > 0, F.abs(s / m - p)).otherwise(0.0)}
        one = F.lit(None).cast("double")
        for h, ks in how.items():
            if ks:
                one = F.when(F.col("k").isin(ks), ways[h]).otherwise(one)
        x.append(one)
        u.append(F.when(F.col("k").isin(how["hier"]), top) if how["hier"] else F.lit(None).cast("double"))
    rated = cut(per.join(if_small(cut(above)), (F.col("k") == F.col("uk")) & (F.col("parent") == F.col("up"))).select("id", "k", F.array(*x).alias("x"), F.array(*u).alias("u")))

    # how often a customer has a number: counted where its lines lie, by day, then added up
    keys = ["custid", "fold", "k", "id"]
    counts = rows.select("custid", "d", "fold", "k", "parent", "token").join(if_small(per.select("k", "parent", "token", "id")), ["k", "parent", "token"])
    counts = counts.groupBy(*keys, "d").agg(F.count("*").alias("n")).repartition("custid", "k").groupBy(*keys).agg(F.sum("n").alias("n"))
    five = F.col("k").isin(how["oof"] + how["hier"])
    at = F.when(F.col("fold") >= 0, F.array("fold")).when(five, F.array(*[F.lit(i) for i in range(5)])).otherwise(F.array(F.lit(5)))
    seen = counts.join(if_small(rated.drop("k")), "id").withColumn("at", F.explode(at)).select("custid", "k", "at", "n", F.get("x", F.col("at")).alias("x"), F.get("u", F.col("at")).alias("u"))
    n, x, u = F.col("n"), F.col("x"), F.col("u")
    res, total = x - u, F.sum(n)
    made = {
        "wmean": F.sum(n * x) / total, "max": F.max(x), "min": F.min(x), "std": F.coalesce(F.stddev_samp(x), F.lit(0.0)), "extreme_hi": F.sum(F.when(x > 0.8, n).otherwise(0)) / total, "extreme_lo": F.sum(F.when(x < 0.2, n).otherwise(0)) / total, "conf": F.sum(F.abs(x - 0.5) * n) / total,
        "up_mean": F.sum(n * u) / total, "shr_mean": F.sum(n * x) / total, "shr_std": weighted_std(x, n), "res_mean": F.sum(n * res) / total, "res_std": weighted_std(res, n),
    }
    means = seen.groupBy("custid", "k", "at").agg(*[e.alias(c) for c, e in made.items()])
    aggs = []
    for k, (h, name, column, _, _) in enumerate(every):
        for c in COLUMNS[name] if h in ("oof", "hier") else [column]:
            aggs.append(F.avg(F.when(F.col("k") == k, F.col(c if h in ("oof", "hier") else "wmean"))).alias(f"{name}_{c}"))
    out = means.groupBy("custid").agg(*aggs)
    return out.select("custid", *[tidy(c) for c in out.columns if c != "custid"])


def _line_mean(rows: DataFrame, rates: DataFrame, key: str, prior: Column | float, name: str) -> DataFrame:
    """The mean rate over an entity's lines; categories without one count with ``prior``."""
    prior = F.lit(prior) if isinstance(prior, float) else prior
    r = F.coalesce("r", prior)
    return join_rate(rows, rates, [key]).groupBy("custid").agg((F.sum(F.col("n") * r) / F.sum("n")).alias(name))


def minsupport_te(spark: SparkSession, folder: str) -> DataFrame:
    """Categories with under 10 lines have the mean of the lines that the encoder is fit on."""
    out = None
    for name in ("brand", "corner", "part", "store_part"):
        counts, test = _counts(spark, folder, token=ENCODED.get(name) or CROSSED[name])
        prior = by_fold(fold_means(counts))
        part = _line_mean(_with_test(counts, test), line_scores(counts, "token", least=10).drop("prior"), "token", prior, f"te_{name}").select("custid", tidy(f"te_{name}"))
        out = part if out is None else out.join(part, "custid", "full_outer")
    return out


def bayes_te(spark: SparkSession, folder: str) -> DataFrame:
    """Codes and their 9- and 6-digit groups, smoothed with strength 20 to the mean of all labelled lines,
    junk lines left out. A customer of junk alone has that mean."""
    out, prior = None, 0.5
    for key, e in {"good": "code", "g9": "substring(code, 1, 9)", "g6": "substring(code, 1, 6)", "pc_nm": ENCODED["pc"], "buyer_nm": ENCODED["buyer"]}.items():
        counts, test = _counts(spark, folder, f"coalesce(not {JUNK}, true)", token=e)
        prior = fold_means(counts)[WHOLE]
        part = _line_mean(_with_test(counts, test), line_rates(counts, ["token"], prior, strength=20), "token", prior, f"te_{key}").select("custid", tidy(f"te_{key}"))
        out = part if out is None else out.join(part, "custid", "full_outer")
    return out


def numeric_bin_te(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts in 20 bins between the quantiles of the labelled lines, and hours, as categories: mean and
    deviation over the lines; lines without an amount count with the mean label."""
    edges = sorted({x for x in quantiles(labelled(spark, folder, "net_amt"), "net_amt", [i / 20 for i in range(1, 20)]) if x is not None})
    prior = _prior(spark, folder)
    steps = "".join(f" when net_amt <= {e!r} then {i}" for i, e in enumerate(edges))
    bin_ = f"case when net_amt is null then -1{steps} else {len(edges)} end"
    out = None
    for e, name in ((bin_, "net"), ("h", "hour")):
        counts, test = _counts(spark, folder, token=e)
        # a missing amount has no bin: its label tells nothing
        rates = line_rates(counts.where("token >= 0"), ["token"], prior, strength=20)
        rows = join_rate(_with_test(counts, test), rates, ["token"]).withColumn("r", F.coalesce("r", F.lit(prior)))
        r, n = F.col("r"), F.col("n")
        part = rows.groupBy("custid").agg((F.sum(n * r) / F.sum(n)).alias(f"{name}_mean"), weighted_std(r, n).alias(f"{name}_std"))
        part = part.select("custid", tidy(f"{name}_mean"), tidy(f"{name}_std", 4))
        out = part if out is None else out.join(part, "custid", "full_outer")
    return out


def neighbor_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Label rate of the other folds' lines (for test customers, of all) with the same minute, store and
    code, and with the same minute, store and brand; ``diff`` is the mean of the two."""
    prior = _prior(spark, folder)
    out = None
    for name, e in (("good", "code"), ("brand", ENCODED["brand"])):
        counts, test = _counts(spark, folder, minute="date_trunc('minute', ts)", str_nm=ENCODED["store"], token=e)
        keys = ["minute", "str_nm", "token"]
        rates = leave_out(counts, keys).where("m > 0").select(*keys, "fold", (F.col("s") / F.col("m")).alias("r"))
        rows = _with_test(counts, test).join(rates, [*keys, "fold"], "left")
        n = F.when(F.col("r").isNotNull(), F.col("n"))
        part = rows.groupBy("custid").agg(F.coalesce(F.sum(n * F.col("r")) / F.sum(n), F.lit(prior)).alias(f"{name}_rate"), F.coalesce(F.sum(n), F.lit(0)).alias(f"{name}_lines"))
        out = part if out is None else out.join(part, "custid")
    out = out.withColumn("diff", (F.col("good_rate") + F.col("brand_rate")) / 2)
    return out.select("custid", *[tidy(c) for c in ("good_rate", "brand_rate", "diff")], "good_lines", "brand_lines")


def logit_dispersion(spark: SparkSession, folder: str) -> DataFrame:
    """Spread of the logits of an entity's lines' brand rates; brands that the encoder hasn't seen are left
    out, and an entity of such alone has 0."""
    counts, test = _counts(spark, folder, token=ENCODED["brand"])
    prior = _prior(spark, folder)
    rates = leave_out(counts, ["token"]).where("m > 0").select("token", "fold", smoothed("s", "m", prior, 20.0).alias("r"))
    rows = join_rate(_with_test(counts, test), rates, ["token"]).withColumn("x", F.ln(F.col("r") / (1 - F.col("r")))).withColumn("n", F.when(F.col("r").isNotNull(), F.col("n")).otherwise(0))
    x, n = F.col("x"), F.col("n")
    total = F.nullif(F.sum(n), F.lit(0))
    # sums of powers about the entity's mean need a second look at its categories, not at its lines
    mean = rows.groupBy(F.col("custid").alias("c")).agg((F.sum(n * x) / total).alias("mu"))
    dev = rows.join(mean, F.col("custid") == F.col("c")).withColumn("z", F.col("x") - F.col("mu"))
    z = F.col("z")
    agg = dev.groupBy("custid").agg(
        F.sum(n).alias("n"),
        F.coalesce(F.sum(n * z * z), F.lit(0.0)).alias("m2"),
        F.coalesce(F.sum(n * F.pow(z, 3)), F.lit(0.0)).alias("m3"),
        F.coalesce(F.sum(n * F.pow(z, 4)), F.lit(0.0)).alias("m4"),
        F.coalesce(F.max(x) - F.min(x), F.lit(0.0)).alias("range"),
        F.coalesce(F.sum(F.when(x > 0.85, n).otherwise(0)) / total, F.lit(0.0)).alias("strong_hi"),
        F.coalesce(F.sum(F.when(x < -0.85, n).otherwise(0)) / total, F.lit(0.0)).alias("strong_lo"),
    )
    flat = F.col("m2") < 1e-12 * F.col("n")
    agg = agg.withColumns(
        {
            "std": F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0),
            "skew": F.when((F.col("n") <= 2) | flat, 0.0).otherwise(F.col("m3") / F.col("n") / F.pow(F.col("m2") / F.col("n"), 1.5)),
            "kurt": F.when((F.col("n") <= 3) | flat, 0.0).otherwise(F.col("m4") / F.col("n") / F.pow(F.col("m2") / F.col("n"), 2.0) - 3),
            "bimodal": 4 * F.col("strong_hi") * F.col("strong_lo"),
        }
    )
    return agg.select("custid", *[tidy(c, 4) for c in ("std", "skew", "kurt", "range", "strong_hi", "strong_lo", "bimodal")])


def _scored(rows: DataFrame, spark: SparkSession, folder: str, column: str, prior: float) -> DataFrame:
    """Lines with ``te``: their category's label rate over the other folds, or for test lines over all,
    smoothed with strength 20 to the mean label."""
    counts, _ = _counts(spark, folder, token=f"coalesce({column}, 'UNKNOWN')")
    rates = line_rates(counts, ["token"], prior, strength=20)
    rows = join_rate(rows.withColumn("token", F.coalesce(column, F.lit("UNKNOWN"))), rates, ["token"])
    return rows.withColumn("te", F.coalesce("r", F.lit(prior))).drop("r", "token")


def score_conditional_agg(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the lines' scores by corner and by part: over all, by amount, high amounts (from the
    0.9 quantile of all lines on), weekends, the last five lines, and the shares of scores of at least .6
    and at most .4. What a customer lacks is the mean label."""
    prior = _prior(spark, folder)
    every = sales(spark, folder, TRAIN, "a").select("a").unionByName(sales(spark, folder, TEST, "a").select("a"))
    high = quantiles(every, "a", [0.9])[0] or 0.0
    lines = both(spark, folder, "a corner_nm part_nm")
    if "pos_back" not in lines.columns:
        lines = with_position(lines, "custid", "d", ["ts", "line_id"])
    lines = _scored(_scored(lines, spark, folder, "corner_nm", prior).withColumnRenamed("te", "te_corner"), spark, folder, "part_nm", prior).withColumnRenamed("te", "te_part")
    aggs, a = [], F.col("a")
    for n in ("corner", "part"):
        te = F.col(f"te_{n}")
        aggs += [
            F.avg(te).alias(f"{n}_mean"),
            F.stddev_samp(te).alias(f"{n}_std"),
            F.max(te).alias(f"{n}_max"),
            F.min(te).alias(f"{n}_min"),
            (F.sum(te * a) / (F.sum(a) + 1e-5)).alias(f"{n}_amount_weighted"),
            F.avg(F.when(a >= high, te)).alias(f"{n}_high_amount"),
            F.avg(F.when(F.col("dow") >= 5, te)).alias(f"{n}_weekend"),
            F.avg(F.when(F.col("pos_back") < 5, te)).alias(f"{n}_recent"),
            F.avg(F.when(te >= 0.6, 1.0).otherwise(0.0)).alias(f"{n}_share_hi"),
            F.avg(F.when(te <= 0.4, 1.0).otherwise(0.0)).alias(f"{n}_share_lo"),
        ]
    out = lines.groupBy("custid").agg(*aggs)
    return out.select("custid", *[F.round(F.coalesce(c, F.lit(prior)) + 1e-10, 5).alias(c) for c in out.columns if c != "custid"])


def time_decay_score(spark: SparkSession, folder: str) -> DataFrame:
    """Of the lines' scores by part: decayed mean, first line of the day, conflict within baskets, and
    buying for both sides (scores of at most .4 and at least .6)."""
    prior = _prior(spark, folder)
    now = max((x for x in (sales(spark, folder, t, "").agg(F.max("d")).first()[0] for t in (TRAIN, TEST)) if x), default=None)
    rows = _scored(both(spark, folder, "a hm part_nm"), spark, folder, "part_nm", prior)
    te, a = F.col("te"), F.col("a")
    weight = F.exp(-F.datediff(F.lit(now), "d") / 60.0)
    days = rows.groupBy("custid", "d").agg(
        F.sum(te * weight).alias("tw"), F.sum(weight).alias("sw"), F.sum("a").alias("a"), F.sum(F.when(te <= 0.4, a)).alias("lo"), F.sum(F.when(te >= 0.6, a)).alias("hi"), F.min_by("te", F.struct("ts", "line_id")).alias("first")
    )
    per = days.groupBy("custid").agg(
        (F.sum("tw") / (F.sum("sw") + 1e-5)).alias("decayed"),
        # a missing side is skipped
        F.coalesce(F.least(F.sum("lo") / (F.sum("a") + 1e-5), F.sum("hi") / (F.sum("a") + 1e-5)), F.lit(0.0)).alias("both_sides"),
        F.avg("first").alias("first_of_day"),
    )
    baskets = rows.groupBy("custid", "d", "hm").agg((F.max(te) - F.min(te)).alias("x")).groupBy("custid").agg(F.avg("x").alias("conflict"))
    return per.join(baskets, "custid").select("custid", *[tidy(c, 5) for c in ("decayed", "both_sides", "conflict", "first_of_day")])


def rate_deviation(spark: SparkSession, folder: str) -> DataFrame:
    """Mean distance of the 6-digit group's raw rate from the mean label, unseen groups 0."""
    counts, test = _counts(spark, folder, token="substring(code, 1, 6)")
    prior = _prior(spark, folder)
    rates = leave_out(counts, ["token"]).select("token", "fold", F.when(F.col("m") > 0, F.abs(F.col("s") / F.col("m") - prior)).otherwise(0.0).alias("r"))
    return _line_mean(_with_test(counts, test), rates, "token", 0.0, "skew").select("custid", tidy("skew"))


def category_rate(spark: SparkSession, folder: str) -> DataFrame:
    """The label rate, lines and customers of every category with at least 200 lines of labelled customers."""
    out = None
    for name, e in ENCODED.items():
        counts, _ = _counts(spark, folder, token=e)
        one = counts.groupBy("token").agg((F.sum(F.col("n") * F.col("label")) / F.sum("n")).alias("rate"), F.sum("n").alias("n_lines"), F.count("*").alias("n_customers")).where("n_lines >= 200")
        one = one.select(F.lit(name).alias("level"), "token", tidy("rate", 4), "n_lines", "n_customers")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "label_fold": label_fold,
    "label_fold_10": label_fold_10,
    **{f"oof_te_{n}": oof_te(c) for n, c in ENCODED.items()},
    **{f"oof_te_{n}": oof_te(e) for n, e in CROSSED.items()},
    "oof_te_transition": oof_transition,
    **{f"hier_te_{n}": hier_te(*p) for n, p in PAIRS.items()},
    "minsupport_te": minsupport_te,
    "bayes_te": bayes_te,
    "numeric_bin_te": numeric_bin_te,
    "neighbor_rate": neighbor_rate,
    "logit_dispersion": logit_dispersion,
    "score_conditional_agg": score_conditional_agg,
    "time_decay_score": time_decay_score,
    "rate_deviation": rate_deviation,
    "category_rate": category_rate,
}

_LINE_KEYS = ("mean", "std", "max", "min", "amount_weighted", "high_amount", "weekend", "recent", "share_hi", "share_lo")
#: The columns of the encoders with a row for every customer.
COLUMNS = {
    **{f"oof_te_{n}": ["wmean", "max", "min", "std", "extreme_hi", "extreme_lo", "conf"] for n in (*ENCODED, *CROSSED, "transition")},
    **{f"hier_te_{n}": ["up_mean", "shr_mean", "shr_std", "res_mean", "res_std"] for n in PAIRS},
    "minsupport_te": [f"te_{n}" for n in ("brand", "corner", "part", "store_part")],
    "bayes_te": [f"te_{n}" for n in ("good", "g9", "g6", "pc_nm", "buyer_nm")],
    "score_conditional_agg": [f"{n}_{k}" for n in ("corner", "part") for k in _LINE_KEYS],
    "time_decay_score": ["decayed", "both_sides", "conflict", "first_of_day"],
    "rate_deviation": ["skew"],
}

# The oracles fit each fold's encoder on the rows of all other folds, as the definition says.
FOLDS = """e AS (SELECT custid, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42-' || custid), custid) - 1) % 5 AS INTEGER) AS fold
  FROM (SELECT custid, min(gender) AS label FROM y_train WHERE custid IS NOT NULL AND gender IS NOT NULL GROUP BY custid HAVING min(gender) = max(gender))),
f AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold), g AS (SELECT avg(label) AS g FROM e)"""
HEAD = f"""WITH {sales_sql()}, {sales_sql(TEST, "st")}, {FOLDS},
l AS (SELECT s.*, label, fold FROM s JOIN e USING (custid)), a AS (SELECT * FROM l UNION ALL SELECT st.*, NULL, -1 FROM st)"""
_CODE = "coalesce(good, '0000000000nan')"
#: The categories again, in the oracles' words.
_CATEGORY = {"brand": "coalesce(brand, 'nan')", "corner": "coalesce(corner_nm, 'nan')", "part": "coalesce(part_nm, 'nan')", "pc": "coalesce(pc_nm, 'nan')", "good": _CODE, "buyer": "coalesce(buyer_nm, 'nan')", "store": "coalesce(str_nm, 'nan')"}
_CROSS = {
    "pc_zone": "concat(coalesce(pc_nm, 'nan'), '|', CASE WHEN hour(ts) > 17 THEN 'd' WHEN hour(ts) > 14 THEN 'c' WHEN hour(ts) > 11 THEN 'b' ELSE 'a' END)",
    "part_zone": "concat(coalesce(part_nm, 'nan'), '|', CASE WHEN hour(ts) > 17 THEN 'd' WHEN hour(ts) > 14 THEN 'c' WHEN hour(ts) > 11 THEN 'b' ELSE 'a' END)",
    "part_season": "concat(coalesce(part_nm, 'nan'), '|', CASE (month(ts) % 12) // 3 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'fall' END)",
    "store_month": "concat(coalesce(str_nm, 'nan'), '|', month(ts))",
    "corner_brand": "concat(coalesce(corner_nm, 'nan'), '|', coalesce(brand, 'nan'))",
    "store_part": "concat(coalesce(str_nm, 'nan'), '_', coalesce(part_nm, 'nan'))",
}
_STEP = "concat(coalesce(lag(corner_nm) OVER (PARTITION BY custid ORDER BY ts, line_id), 'START'), '>', coalesce(corner_nm, 'nan'))"


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-10, {digits}) AS {name}"


#: Every fold with the labelled lines that its encoder sees; fold -1 sees all.
_SEEN = "(SELECT f.fold, l.* EXCLUDE (fold) FROM l JOIN (SELECT fold FROM f UNION ALL SELECT -1) f ON l.fold <> f.fold)"
_AGGS = ["sum(n * r) / sum(n)", "max(r)", "min(r)", "coalesce(stddev_samp(r), 0)", "sum(CASE WHEN r > 0.8 THEN n ELSE 0 END) / sum(n)", "sum(CASE WHEN r < 0.2 THEN n ELSE 0 END) / sum(n)", "sum(abs(r - 0.5) * n) / sum(n)"]
_NAMES = ["wmean", "max", "min", "std", "extreme_hi", "extreme_lo", "conf"]


def _oof_sql(token: str) -> str:
    head = HEAD.replace("l AS (SELECT s.*,", f"l AS (SELECT s.*, {token} AS token,").replace("SELECT st.*,", f"SELECT st.*, {token} AS token,")
    if "lag(" in token:  # windows run over all lines of a customer before they meet the labels
        head = HEAD.replace("l AS (SELECT s.*, label, fold FROM s JOIN", f"w AS (SELECT *, {token} AS token FROM s), l AS (SELECT w.*, label, fold FROM w JOIN").replace("SELECT st.*, NULL", f"SELECT st.*, {token} AS token, NULL")
    return f"""{head},
r AS (SELECT v.fold, token, (sum(label) + 20 * g.g) / (count(*) + 20) AS r FROM {_SEEN} v, g GROUP BY v.fold, token, g.g),
c AS (SELECT custid, fold, token, count(*) AS n FROM a WHERE fold >= 0 GROUP BY ALL UNION ALL SELECT custid, f.fold, token, count(*) FROM a, f WHERE a.fold < 0 GROUP BY ALL),
x AS (SELECT c.custid, c.fold, n, coalesce(r, g.g) AS r FROM c LEFT JOIN r USING (fold, token), g),
y AS (SELECT custid, fold, {", ".join(f"{a} AS {n}_" for a, n in zip(_AGGS, _NAMES, strict=True))} FROM x GROUP BY custid, fold)
SELECT custid, {", ".join(_r(f"avg({n}_)", n) for n in _NAMES)} FROM y GROUP BY custid"""


def _hier_sql(child: str, parent: str) -> str:
    return f"""{HEAD.replace("l AS (SELECT s.*,", f"l AS (SELECT s.*, {_CATEGORY[child]} AS c, {_CATEGORY[parent]} AS p,").replace("SELECT st.*,", f"SELECT st.*, {_CATEGORY[child]} AS c, {_CATEGORY[parent]} AS p,")},
u AS (SELECT v.fold, p, (sum(label) + 20 * g.g) / (count(*) + 20) AS up FROM {_SEEN} v, g GROUP BY v.fold, p, g.g),
lo AS (SELECT v.fold, p, c, sum(label) AS s, count(*) AS m FROM {_SEEN} v GROUP BY ALL),
k AS (SELECT custid, fold, p, c FROM a WHERE fold >= 0 UNION ALL SELECT custid, f.fold, p, c FROM a, f WHERE a.fold < 0),
x AS (SELECT k.custid, k.fold, coalesce(up, g.g) AS up, (coalesce(s, 0) + 10 * coalesce(up, g.g)) / (coalesce(m, 0) + 10) AS shr FROM k LEFT JOIN u USING (fold, p) LEFT JOIN lo USING (fold, p, c), g),
y AS (SELECT custid, fold, avg(up) AS a1, avg(shr) AS a2, coalesce(stddev_samp(shr), 0) AS a3, avg(shr - up) AS a4, coalesce(stddev_samp(shr - up), 0) AS a5 FROM x GROUP BY ALL)
SELECT custid, {_r("avg(a1)", "up_mean")}, {_r("avg(a2)", "shr_mean")}, {_r("avg(a3)", "shr_std")}, {_r("avg(a4)", "res_mean")}, {_r("avg(a5)", "res_std")} FROM y GROUP BY custid"""


def _mean_sql(name: str, token: str, rate: str, prior: str, where: str = "true") -> str:
    """One encoder's mean over the lines: ``s`` and ``m`` are what the row's fold sees, ``g`` the mean label."""
    return f"""t_{name} AS (SELECT b.custid, {_r(f"avg(coalesce({rate}, {prior}))", f"te_{name}")} FROM (SELECT *, {token} AS token FROM a WHERE {where}) b
  LEFT JOIN (SELECT fold, {token} AS token, sum(label) AS s, count(*) AS m FROM {_SEEN} v WHERE {where} GROUP BY ALL) r USING (fold, token)
  JOIN (SELECT fold, avg(label) AS p FROM {_SEEN} v WHERE {where} GROUP BY fold) p USING (fold), g, (SELECT avg(label) AS every FROM l WHERE {where}) GROUP BY b.custid)"""


def _means_sql(parts: dict[str, str]) -> str:
    names = list(parts)
    return f"{HEAD}, {', '.join(parts.values())} SELECT * FROM t_{names[0]} " + " ".join(f"FULL JOIN t_{n} USING (custid)" for n in names[1:])


def _neighbours(name: str, token: str) -> str:
    return f"""n_{name} AS (SELECT a.custid, coalesce(avg(r), any_value(g.g)) AS r, count(r) AS n FROM (SELECT *, row_number() OVER () AS i FROM a) a LEFT JOIN
  (SELECT x.i, avg(y.label) AS r FROM (SELECT *, row_number() OVER () AS i FROM a) x JOIN l y ON date_trunc('minute', x.ts) = date_trunc('minute', y.ts) AND coalesce(x.str_nm, 'nan') = coalesce(y.str_nm, 'nan') AND {token.format("x")} = {token.format("y")} AND x.fold <> y.fold GROUP BY x.i) z ON a.i = z.i, g GROUP BY a.custid)"""


_CONDITIONS = {"mean": "avg(te)", "std": "stddev_samp(te)", "max": "max(te)", "min": "min(te)", "amount_weighted": "sum(te * a) / (sum(a) + 1e-5)", "high_amount": "avg(te) FILTER (a >= q)", "weekend": "avg(te) FILTER (isodow(ts) > 5)", "recent": "avg(te) FILTER (back <= 5)", "share_hi": "count(*) FILTER (te >= 0.6::DOUBLE) / count(*)", "share_lo": "count(*) FILTER (te <= 0.4::DOUBLE) / count(*)"}


def _score_sql(column: str) -> str:
    """Lines with their score by ``column``."""
    return f"""(SELECT b.*, coalesce(r, g.g) AS te FROM a b LEFT JOIN (SELECT v.fold, coalesce({column}, 'UNKNOWN') AS token, (sum(label) + 20 * g.g) / (count(*) + 20) AS r FROM {_SEEN} v, g GROUP BY v.fold, 2, g.g) r ON r.fold = b.fold AND r.token = coalesce(b.{column}, 'UNKNOWN'), g)"""


SQL = {
    "label_fold": f"WITH {FOLDS} SELECT custid, label, fold FROM e",
    "label_fold_10": "SELECT custid, min(gender) AS label, CAST((row_number() OVER (PARTITION BY min(gender) ORDER BY md5('7-' || custid), custid) - 1) % 10 AS INTEGER) AS fold FROM y_train WHERE custid IS NOT NULL AND gender IS NOT NULL GROUP BY custid HAVING min(gender) = max(gender)",
    **{f"oof_te_{n}": _oof_sql(c) for n, c in (_CATEGORY | _CROSS).items()},
    "oof_te_transition": _oof_sql(_STEP),
    **{f"hier_te_{n}": _hier_sql(*p) for n, p in PAIRS.items()},
    "minsupport_te": _means_sql({n: _mean_sql(n, (_CATEGORY | _CROSS)[n], "CASE WHEN m < 10 THEN p.p ELSE s / m END", "p.p") for n in ("brand", "corner", "part", "store_part")}),
    "bayes_te": _means_sql(
        {n: _mean_sql(n, t, "(s + 20 * every) / (m + 20)", "every", f"coalesce(NOT {JUNK}, true)") for n, t in {"good": _CODE, "g9": f"left({_CODE}, 9)", "g6": f"left({_CODE}, 6)", "pc_nm": _CATEGORY["pc"], "buyer_nm": _CATEGORY["buyer"]}.items()}
    ),
    "numeric_bin_te": f"""{HEAD}, q AS (SELECT list_distinct(quantile_cont(net_amt, [{", ".join(str(i / 20) for i in range(1, 20))}])) AS q FROM l),
b AS (SELECT a.*, CASE WHEN net_amt IS NOT NULL THEN len([x FOR x IN q IF x < net_amt]) END AS bin FROM a, q),
v AS (SELECT f.fold, b.bin, h, label FROM b JOIN (SELECT fold FROM f UNION ALL SELECT -1) f ON b.fold <> f.fold WHERE b.fold >= 0),
rb AS (SELECT fold, bin, (sum(label) + 20 * g.g) / (count(*) + 20) AS r FROM v, g WHERE bin IS NOT NULL GROUP BY fold, bin, g.g),
rh AS (SELECT fold, h, (sum(label) + 20 * g.g) / (count(*) + 20) AS r FROM v, g GROUP BY fold, h, g.g)
SELECT custid, {_r("avg(coalesce(rb.r, g.g))", "net_mean")}, {_r("coalesce(stddev_samp(coalesce(rb.r, g.g)), 0)", "net_std", 4)}, {_r("avg(coalesce(rh.r, g.g))", "hour_mean")}, {_r("coalesce(stddev_samp(coalesce(rh.r, g.g)), 0)", "hour_std", 4)}
FROM b LEFT JOIN rb USING (fold, bin) LEFT JOIN rh USING (fold, h), g GROUP BY custid""",
    "neighbor_rate": f"""{HEAD}, {_neighbours("good", "coalesce({0}.good, '0000000000nan')")}, {_neighbours("brand", "coalesce({0}.brand, 'nan')")}
SELECT custid, {_r("x.r", "good_rate")}, {_r("y.r", "brand_rate")}, {_r("(x.r + y.r) / 2", "diff")}, x.n AS good_lines, y.n AS brand_lines FROM n_good x JOIN n_brand y USING (custid)""",
    "logit_dispersion": f"""{HEAD}, r AS (SELECT v.fold, coalesce(brand, 'nan') AS b, (sum(label) + 20 * g.g) / (count(*) + 20) AS r FROM {_SEEN} v, g GROUP BY v.fold, 2, g.g),
x AS (SELECT a.custid, ln(r / (1 - r)) AS x FROM a JOIN r ON r.fold = a.fold AND r.b = coalesce(a.brand, 'nan')),
y AS (SELECT custid, count(*) AS n, stddev_samp(x) AS sd, var_pop(x) AS v, avg(x) AS mu, max(x) - min(x) AS rg, avg(CASE WHEN x > 0.85 THEN 1.0 ELSE 0 END) AS hi, avg(CASE WHEN x < -0.85 THEN 1.0 ELSE 0 END) AS lo FROM x GROUP BY custid),
z AS (SELECT custid, avg(pow(x - mu, 3)) AS m3, avg(pow(x - mu, 4)) AS m4 FROM x JOIN y USING (custid) GROUP BY custid)
SELECT custid, {_r("coalesce(sd, 0)", "std", 4)}, {_r("CASE WHEN n IS NULL OR n <= 2 OR v < 1e-12 THEN 0 ELSE m3 / pow(v, 1.5) END", "skew", 4)}, {_r("CASE WHEN n IS NULL OR n <= 3 OR v < 1e-12 THEN 0 ELSE m4 / (v * v) - 3 END", "kurt", 4)},
{_r("coalesce(rg, 0)", "range", 4)}, {_r("coalesce(hi, 0)", "strong_hi", 4)}, {_r("coalesce(lo, 0)", "strong_lo", 4)}, {_r("coalesce(4 * hi * lo, 0)", "bimodal", 4)} FROM (SELECT DISTINCT custid FROM a) LEFT JOIN y USING (custid) LEFT JOIN z USING (custid)""",
    "score_conditional_agg": f"""{HEAD}, q AS (SELECT quantile_cont(a, 0.9) AS q FROM (SELECT a FROM s UNION ALL SELECT a FROM st)),
"""
    + ",\n".join(
        f"{n} AS (SELECT custid, {', '.join(_r(f'coalesce({e}, any_value(g.g))', f'{n}_{k}', 5) for k, e in _CONDITIONS.items())} FROM (SELECT *, row_number() OVER (PARTITION BY custid ORDER BY ts DESC, line_id DESC) AS back FROM {_score_sql(c)}), q, g GROUP BY custid)"
        for n, c in (("corner", "corner_nm"), ("part", "part_nm"))
    )
    + "\nSELECT * FROM corner JOIN part USING (custid)",
    "time_decay_score": f"""{HEAD}, x AS {_score_sql("part_nm")}, n AS (SELECT max(d) AS n FROM (SELECT d FROM s UNION ALL SELECT d FROM st)),
p1 AS (SELECT custid, sum(te * exp(-date_diff('day', d, n) / 60.0)) / (sum(exp(-date_diff('day', d, n) / 60.0)) + 1e-5) AS dec, least(sum(a) FILTER (te <= 0.4::DOUBLE) / (sum(a) + 1e-5), sum(a) FILTER (te >= 0.6::DOUBLE) / (sum(a) + 1e-5)) AS b FROM x, n GROUP BY custid),
p2 AS (SELECT custid, avg(v) AS c FROM (SELECT custid, max(te) - min(te) AS v FROM x GROUP BY custid, date_trunc('minute', ts)) GROUP BY custid),
p3 AS (SELECT custid, avg(v) AS o FROM (SELECT custid, first(te ORDER BY ts, line_id) AS v FROM x GROUP BY custid, d) GROUP BY custid)
SELECT custid, {_r("dec", "decayed", 5)}, {_r("coalesce(b, 0)", "both_sides", 5)}, {_r("c", "conflict", 5)}, {_r("o", "first_of_day", 5)} FROM p1 JOIN p2 USING (custid) JOIN p3 USING (custid)""",
    "rate_deviation": f"""{HEAD}, r AS (SELECT v.fold, left({_CODE}, 6) AS g6, abs(avg(label) - g.g) AS r FROM {_SEEN} v, g GROUP BY v.fold, 2, g.g)
SELECT custid, {_r("avg(coalesce(r, 0))", "skew")} FROM a LEFT JOIN r ON r.fold = a.fold AND r.g6 = left(coalesce(a.good, '0000000000nan'), 6) GROUP BY custid""",
    "category_rate": f"{HEAD} " + " UNION ALL ".join(f"SELECT '{n}' AS level, {c} AS token, {_r('avg(label)', 'rate', 4)}, count(*) AS n_lines, count(DISTINCT custid) AS n_customers FROM l GROUP BY 2 HAVING count(*) >= 200" for n, c in _CATEGORY.items()),
}
