"""Queries of token, graph, matrix and cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import clean, represent, walks
from tidemark.operators.gram import gram_sums
from tidemark.operators.ordered import with_position, with_previous
from tidemark.operators.rank import digest_rank
from tidemark.plans.blocks import BLOCKS
from tidemark.session import cut, if_small
from tidemark.sources.sales import sales, sales_sql
from tidemark.sources.tables import table


def _counts(spark: SparkSession, folder: str, token: str, amount: bool = False) -> DataFrame:
    rows = sales(spark, folder).where(f"{token} is not null")
    return cut(rows.groupBy("custid", token).agg(F.count("*").alias("n"), F.sum("a").alias("a")))


def _over_both(spark: SparkSession, folder: str, uses: str) -> DataFrame:
    one, other = (sales(spark, folder, t, uses) for t in ("train_transactions", "test_transactions"))
    return one.unionByName(other)


def _both_counts(spark: SparkSession, folder: str, token: str, where: str = "true") -> DataFrame:
    out = None
    for t in ("train_transactions", "test_transactions"):
        one = sales(spark, folder, t, f"{token} {where} a").where(f"{token} is not null and {where}").groupBy("custid", token).agg(F.count("*").alias("n"), F.sum("a").alias("a"))
        out = one if out is None else out.unionByName(one)
    return cut(out)


def _r(c: str, digits: int = 6):
    return F.round(F.col(c).cast("double") + 1e-10, digits).alias(c)


def _attributes(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Brands with the means of their numeric attributes, which are whatever the table has, and their names."""
    meta = table(spark, folder, "brand_meta").withColumn("b", F.upper(F.trim("brd_nm"))).where("b <> ''")
    attrs = [c for c, t in meta.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    return cut(meta.groupBy("b").agg(*[F.avg(a).alias(a) for a in attrs])), attrs


def brand_spread(spark: SparkSession, folder: str) -> DataFrame:
    """For every brand attribute the mean weighted by gross amount plus 1 over all lines (an unknown brand
    adds nothing above the line), and deviation, least and greatest over the lines that have it."""
    meta, attrs = _attributes(spark, folder)
    rows, w = _over_both(spark, folder, "brand a").join(if_small(meta), F.col("brand") == F.col("b"), "left"), F.col("a") + 1
    per = rows.groupBy("custid").agg(*[x for c in attrs for x in ((F.coalesce(F.sum(F.col(c) * w), F.lit(0.0)) / (F.sum(w) + 1e-9)).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])
    return per.select("custid", *[F.coalesce(_r(c, 4), F.lit(0.0)).alias(c) for c in per.columns if c != "custid"])


def dim_weighted_mean(spark: SparkSession, folder: str, name: str = "train_transactions") -> DataFrame:
    """Brand attributes weighted by amount plus 1; brands without one have the attribute's mean."""
    meta, attrs = _attributes(spark, folder)
    means = meta.agg(*[F.avg(a).alias(f"m_{a}") for a in attrs])
    rows = sales(spark, folder, name, "brand w").join(if_small(meta), F.col("brand") == F.col("b"), "left").crossJoin(F.broadcast(means))
    w = F.col("w") + 1
    out = rows.groupBy("custid").agg(*[(F.sum(F.coalesce(F.col(a), F.col(f"m_{a}")) * w) / F.sum(w)).alias(a) for a in attrs])
    return out.select("custid", *[_r(a, 4) for a in attrs])


def catalog_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Brands with lines, customers, the lowest most frequent part, and the running share of lines."""
    rows = sales(spark, folder).where("brand is not null")
    per = rows.groupBy("brand").agg(F.count("*").alias("n_lines"), F.countDistinct("custid").alias("n_customers"), F.mode("part_nm", deterministic=True).alias("part_nm"))
    per = cut(per)
    # brands with equally many lines share a level; different numbers of lines are few, whatever the brands
    levels = per.groupBy(F.col("n_lines").alias("level")).agg(F.sum("n_lines").alias("s"))
    levels = levels.select("level", (F.sum("s").over(W.orderBy(F.desc("level"))) - F.col("s")).alias("before"), F.sum("s").over(W.partitionBy()).alias("t"))
    rows = per.join(if_small(cut(levels)), F.col("n_lines") == F.col("level"))
    place = F.row_number().over(W.partitionBy("n_lines").orderBy("brand"))
    return rows.withColumn("covered", (F.col("before") + F.col("n_lines") * place) / F.col("t")).select("brand", "n_lines", "n_customers", "part_nm", _r("covered"))


def copurchase_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Brand pairs bought by a customer in one month, at least 3 times."""
    rows = sales(spark, folder).where("brand is not null")
    words = represent.dictionary(rows, "brand")
    side = if_small(words.select(F.col("token").alias("brand"), F.col("no").cast("int").alias("no")))
    sets = rows.join(side, "brand").groupBy("custid", F.date_trunc("month", "ts").alias("m")).agg(F.collect_set("no").alias("x"))
    sums = gram_sums(sets.withColumn("any_x", F.lit(True)), {"x": max(1, words.count())}).where("a <> b and n >= 3")
    a, b = (if_small(words.select(F.col("no").alias(c), F.col("token").alias(f"t{c}"))) for c in ("a", "b"))
    return sums.join(a, "a").join(b, "b").select(F.least("ta", "tb").alias("brand_a"), F.greatest("ta", "tb").alias("brand_b"), F.col("n").alias("weight"))


def ppmi(spark: SparkSession, folder: str) -> DataFrame:
    return represent.ppmi(sales(spark, folder), "custid", "brand").select(F.col("token_a").alias("brand_a"), F.col("token_b").alias("brand_b"), "n_ab", _r("ppmi", 5))


def tfidf_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return represent.tfidf(_counts(spark, folder, "brand"), "custid", "brand").select("custid", "brand", _r("weight"))


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Of every line: part, pc, hour, the code's 4, 6 and 8 first digits, the amount's bin by powers of two
    and its sign, and the bigram of the corner before and this one."""
    rows = with_previous(sales(spark, folder, uses="part_nm pc_nm h corner_nm code net_amt"), "custid", "d", ["ts", "line_id"], ["corner_nm"])
    bin_ = F.when(F.col("net_amt").isNotNull(), F.concat(F.lit("amt="), F.when(F.col("net_amt") < 0, "-").otherwise(""), F.length(F.bin(F.abs("net_amt"))).cast("string")))
    made = [
        F.concat(F.lit("part="), F.regexp_replace("part_nm", r"\s+", "")), F.concat(F.lit("pc="), "pc_nm"), F.concat(F.lit("h="), F.col("h").cast("string")), bin_,
        *[F.concat(F.lit(f"g{k}="), F.substring("code", 1, k)) for k in (4, 6, 8)], F.concat(F.lit("step="), "prev_corner_nm", F.lit(">"), "corner_nm"),
    ]
    return rows.select("custid", F.explode(F.array(*made)).alias("tok"))


def tfidf_sublinear(spark: SparkSession, folder: str) -> DataFrame:
    """Amount bins, code prefixes, bigrams and prefixed categories as tokens, sublinear, in at least 5
    documents."""
    rows = _tokens(spark, folder)
    counts = cut(rows.where("tok is not null").groupBy("custid", "tok").agg(F.count("*").alias("n")))
    return represent.tfidf(counts, "custid", "tok", 5, True).select("custid", "tok", _r("weight"))


def category_sentence(spark: SparkSession, folder: str) -> DataFrame:
    """A customer's 20 corners of greatest amount, with counts and rounded amounts, in one sentence."""
    per = sales(spark, folder).where("corner_nm is not null").groupBy("custid", "corner_nm").agg(F.count("*").alias("n"), F.sum("a").alias("amt"))
    w = W.partitionBy("custid").orderBy(F.desc("amt"), F.desc("n"), "corner_nm")
    top = per.withColumn("k", F.row_number().over(w)).where("k <= 20")
    word = F.concat("corner_nm", F.lit(" "), F.col("n").cast("string"), F.lit("x "), F.round(F.col("amt") / 1000).cast("bigint").cast("string"), F.lit("k"))
    out = top.groupBy("custid").agg(F.array_sort(F.collect_list(F.struct("k", word.alias("w")))).alias("x"))
    return out.select("custid", F.concat_ws(", ", F.transform("x", lambda s: s["w"])).alias("sentence"))


def _numbered(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """The values of a category of both tables, numbered from 1 in the order of their digests."""
    words = None
    for t in ("train_transactions", "test_transactions"):
        one = sales(spark, folder, t, column).where(f"{column} is not null").select(F.lit(1).alias("one"), F.col(column).alias("w"))
        words = one if words is None else words.unionByName(one)
    return digest_rank(cut(words.distinct()), ["one"], "w", 42, "no").select("w", (F.col("no") + 1).cast("int").alias("no"))


def _field(name: str):
    return lambda s: s[name].cast("string")


def sequence_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Seven channels of the last 60 lines of every customer of both tables, oldest first, padded on the left
    with 0: numbers of pc, corner, store and buyer, the amount's bin, the hour plus 1, and the days since the
    line before in bins by powers of two."""
    words = {c: if_small(cut(_numbered(spark, folder, c))) for c in ("pc_nm", "corner_nm", "str_nm", "buyer_nm")}
    out = None
    for t in ("train_transactions", "test_transactions"):
        rows = with_previous(with_position(sales(spark, folder, t, "pc_nm corner_nm str_nm buyer_nm net_amt h"), "custid", "d", ["ts", "line_id"]), "custid", "d", ["ts", "line_id"], ["d"]).where("pos_back < 60")
        for c, side in words.items():
            rows = rows.join(side.select(F.col("w").alias(f"w_{c}"), F.col("no").alias(f"no_{c}")), F.col(c) == F.col(f"w_{c}"), "left")
        bits = lambda x: F.length(F.bin(x))
        channels = {
            **{c: F.coalesce(f"no_{c}", F.lit(0)) for c in words},
            "amount": F.coalesce(F.when(F.col("net_amt") < 0, -bits(-F.col("net_amt"))).when(F.col("net_amt") > 0, bits(F.col("net_amt"))), F.lit(0)),
            "hour": F.col("h") + 1,
            "gap": F.coalesce(F.when(F.col("has_prev"), bits(F.datediff("d", "prev_d").cast("long") + 1)), F.lit(0)),
        }
        one = rows.groupBy("custid").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), *[v.cast("int").alias(k) for k, v in channels.items()]))).alias("x"))
        pad = F.array_repeat(F.lit("0"), F.lit(60) - F.size("x"))
        one = one.select("custid", *[F.concat_ws(" ", F.concat(pad, F.transform("x", _field(k)))).alias(k) for k in channels])
        out = one if out is None else out.unionByName(one)
    return out


def token_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """The last 60 lines' part numbers (0 pads on the left), amount bins and gaps: fixed-length channels."""
    rows = with_position(sales(spark, folder, uses="pc_nm net_amt"), "custid", "d", ["ts", "line_id"]).where("pos_back < 60")
    words = cut(sales(spark, folder, uses="pc_nm").where("pc_nm is not null").select("pc_nm").distinct())
    # one row a pc name
    words = words.withColumn("no", F.row_number().over(W.orderBy("pc_nm")))
    rows = rows.join(if_small(words), "pc_nm", "left").withColumn("sl", F.signum("net_amt") * F.log1p(F.abs("net_amt")))
    seq = rows.groupBy("custid").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), F.coalesce("no", F.lit(0)).alias("t"), F.round(F.coalesce("sl", F.lit(0.0)) + 1e-10, 6).alias("s")))).alias("x"))
    pad = F.array_repeat(F.lit("0"), F.lit(60) - F.size("x"))
    return seq.select("custid", F.size("x").alias("length"), F.concat_ws(" ", F.concat(pad, F.transform("x", lambda s: s["t"].cast("string")))).alias("tokens"), F.round(F.aggregate("x", F.lit(0.0), lambda a, s: a + s["s"]) + 1e-10, 4).alias("amount_sum"))


def stage_clean_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Amount columns of the base block clipped to their 1 and 99 percent points and in logarithms."""
    block = BLOCKS["base_agg"]
    both = block.spark(spark, folder).unionByName(type(block)(block.steps, ["test_transactions"]).spark(spark, folder))
    base = both.select("custid", "n_lines", "net_sum", "net_max", "visit_days").na.fill(0.0)
    out = clean.clip_log(base, ["n_lines", "net_sum", "net_max", "visit_days"])
    return out.select("custid", *[_r(c) for c in ("n_lines", "net_sum", "net_max", "visit_days")])


def informative_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of the semantic block that vary and aren't nearly empty."""
    block = BLOCKS["semantic_share"].spark(spark, folder)
    kept = clean.informative(block, [c for c in block.columns if c != "custid"])
    return spark.createDataFrame([(c,) for c in kept], "column_name string")


def gauss_rank(spark: SparkSession, folder: str) -> DataFrame:
    base = BLOCKS["base_agg"].spark(spark, folder).select("custid", "n_lines")
    return clean.gauss_rank(base, "n_lines", "z").select("custid", _r("z"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return cut(copurchase_pairs(spark, folder))


def label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    return represent.label_propagation(_edges(spark, folder), "brand_a", "brand_b", "weight")


def _purchases(spark: SparkSession, folder: str) -> DataFrame:
    rows = sales(spark, folder, uses="brand").where("brand is not null")
    return rows.select(F.concat(F.lit("c"), F.col("custid").cast("string")).alias("c"), F.concat(F.lit("b"), "brand").alias("b")).distinct()


def random_walks(spark: SparkSession, folder: str) -> DataFrame:
    return represent.random_walks(_purchases(spark, folder), "c", "b")


def goods_svd(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of both tables by 24 factors of the TF-IDF weights of their codes, junk left out."""
    counts = _both_counts(spark, folder, "code", "code <> '2700000000000'")
    return represent.weight_svd(represent.tfidf(counts, "custid", "code", 3), "custid", "code", 24)


def corner_svd(spark: SparkSession, folder: str) -> DataFrame:
    return represent.count_svd(_both_counts(spark, folder, "corner_nm"), "custid", "corner_nm", 16, 3)


def token_svd(spark: SparkSession, folder: str) -> DataFrame:
    """Customers by 32 factors of the sublinear weights of all kinds of tokens."""
    counts = cut(_tokens(spark, folder).where("tok is not null").groupBy("custid", "tok").agg(F.count("*").alias("n")))
    return represent.weight_svd(represent.tfidf(counts, "custid", "tok", 5, True), "custid", "tok", 32)


def goods_als(spark: SparkSession, folder: str) -> DataFrame:
    return represent.als_factors(_both_counts(spark, folder, "code"), "custid", "code", 32)


def subword_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Corner vectors that lean on their names' parts, pooled by customer."""
    vectors = represent.subword_vectors(cut(_vectors(spark, folder, "corner_nm")))
    out = represent.pooled(_counts(spark, folder, "corner_nm"), cut(vectors), "custid", "corner_nm")
    from pyspark.ml.functions import vector_to_array

    return out.select("custid", *[vector_to_array(c).alias(c) for c in ("mean", "max", "std", "idf_mean")])


def token_map(spark: SparkSession, folder: str) -> DataFrame:
    """The categories' numbers, as models use them."""
    out = None
    for c in ("pc_nm", "corner_nm", "str_nm", "buyer_nm"):
        one = _numbered(spark, folder, c).select(F.lit(c).alias("level"), F.col("w").alias("name"), F.col("no").cast("long").alias("no"))
        out = one if out is None else out.unionByName(one)
    return out


def _vectors(spark: SparkSession, folder: str, token: str, size: int = 16) -> DataFrame:
    rows = sales(spark, folder).withColumn("month", F.date_trunc("month", "ts"))
    return represent.word_vectors(represent.sentences(rows, "custid", "month", ["ts", "line_id"], token), size)


def w2v_pool(spark: SparkSession, folder: str) -> DataFrame:
    out = represent.pooled(_counts(spark, folder, "corner_nm"), cut(_vectors(spark, folder, "corner_nm")), "custid", "corner_nm")
    from pyspark.ml.functions import vector_to_array

    return out.select("custid", *[vector_to_array(c).alias(c) for c in ("mean", "max", "std", "idf_mean")])


def kmeans_exposure(spark: SparkSession, folder: str) -> DataFrame:
    return represent.cluster_exposure(_counts(spark, folder, "brand"), cut(_vectors(spark, folder, "brand")), "custid", "brand", 8, "a")


def svd_counts(spark: SparkSession, folder: str) -> DataFrame:
    return represent.count_svd(_counts(spark, folder, "brand"), "custid", "brand", 16)


def lda_topics(spark: SparkSession, folder: str) -> DataFrame:
    return represent.lda_topics(_counts(spark, folder, "pc_nm"), "custid", "pc_nm", 8)


def als_factors(spark: SparkSession, folder: str) -> DataFrame:
    return represent.als_factors(_counts(spark, folder, "brand"), "custid", "brand", 16)


def nmf_factors(spark: SparkSession, folder: str) -> DataFrame:
    counts = _counts(spark, folder, "pc_nm").withColumn("n", F.log1p(F.col("a")) + 1)
    return represent.als_factors(counts, "custid", "pc_nm", 12, implicit=False, nonnegative=True)


def store_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every customer by store, zeros included: a pivot over the stores of both tables, turned back."""
    both = sales(spark, folder).select("custid", "str_nm").unionByName(sales(spark, folder, "test_transactions").select("custid", "str_nm"))
    stores = clean.values_of(both, "str_nm")
    if not stores:
        return both.select("custid", "str_nm", F.lit(0).cast("long").alias("n")).where("false")
    wide = clean.fixed_pivot(both, "custid", "str_nm", stores, "at_")
    names = dict(zip(wide.columns[1:], stores, strict=True))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("c"))
    return wide.unpivot("custid", list(names), "c", "n").select("custid", name.alias("str_nm"), "n")


def category_top(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 part names with most lines (a report)."""
    per = sales(spark, folder).where("part_nm is not null").groupBy("part_nm").agg(F.count("*").alias("n_lines"), F.avg("net_amt").alias("net_mean"))
    return per.orderBy(F.desc("n_lines"), "part_nm").limit(20).select("part_nm", "n_lines", _r("net_mean", 4))


def node_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of customers and brands by skip-gram over random walks."""
    return walks.node_vectors(*walks.walk_lists(cut(_purchases(spark, folder)), "c", "b"))


def community_share(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of a customer's amount by brand community, of the communities found by label propagation."""
    com = cut(label_propagation(spark, folder))
    counts = _counts(spark, folder, "brand").join(if_small(com), F.col("brand") == F.col("node"))
    per = counts.groupBy("custid", "community").agg(F.sum("a").alias("a"))
    return per.select("custid", "community", (F.col("a") / (F.sum("a").over(W.partitionBy("custid")) + 1e-9)).alias("share"))


def ppmi_svd(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as the mean of their brands' PPMI vectors, weighted by lines."""
    vectors = represent.ppmi_vectors(sales(spark, folder), "custid", "brand", 16)
    from pyspark.ml.functions import array_to_vector, vector_to_array

    side = vectors.select(F.col("word").alias("brand"), array_to_vector("vector").alias("vector"))
    rows = _counts(spark, folder, "brand").join(F.broadcast(side), "brand")
    from pyspark.ml.stat import Summarizer

    return rows.groupBy("custid").agg(vector_to_array(Summarizer.mean(F.col("vector"), F.col("n").cast("double"))).alias("factors"))


def pca(spark: SparkSession, folder: str) -> DataFrame:
    base = BLOCKS["base_agg"].spark(spark, folder)
    return represent.principal_components(base, ["n_lines", "n_goods", "n_brands", "visit_days", "net_mean", "net_std", "weekend_share", "hour_mean"], "custid", 4)


QUERIES = {
    f.__name__: f
    for f in (
        dim_weighted_mean, brand_spread, catalog_coverage, copurchase_pairs, ppmi, tfidf_tokens, tfidf_sublinear, category_sentence, token_sequence, stage_clean_columns, informative_columns,
        gauss_rank, label_propagation, random_walks, w2v_pool, kmeans_exposure, svd_counts, lda_topics, als_factors, nmf_factors, store_counts, category_top, node_vectors, community_share, ppmi_svd, pca, sequence_channels, goods_svd, corner_svd, token_svd, goods_als, subword_pool, token_map,
    )
}

def _spread(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.select("custid", *[F.coalesce(F.try_element_at(column, F.lit(i + 1)), F.lit(0.0)).alias(f"f{i}") for i in range(k)])


#: Queries that take the name of a table, and those that hold the customers of both.
OVER = {"dim_weighted_mean": dim_weighted_mean}
WHOLE = {
    "svd_counts": lambda spark, folder: _spread(represent.count_svd(_both_counts(spark, folder, "brand"), "custid", "brand", 16), "factors", 16),
    "lda_topics": lambda spark, folder: _spread(represent.lda_topics(_both_counts(spark, folder, "pc_nm"), "custid", "pc_nm", 8), "topics", 8),
}

_S = f"WITH {sales_sql()}"


def _q(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-10, {digits}) AS {name}"


def _tfidf(counts: str, token: str, tf: str, least: int) -> str:
    return f"""{_S}, c AS ({counts}), n AS (SELECT count(DISTINCT custid) AS n FROM c), d AS (SELECT {token}, count(*) AS df FROM c GROUP BY {token} HAVING count(*) >= {least}),
x AS (SELECT custid, {token}, {tf} * (ln((1.0 + n.n) / (1 + df)) + 1) AS x FROM c JOIN d USING ({token}), n)
SELECT custid, {token}, {_q(f"x / sqrt(sum(x * x) OVER (PARTITION BY custid))", "weight")} FROM x"""


_BASE = BLOCKS["base_agg"].sql()
_COLS = ("n_lines", "net_sum", "net_max", "visit_days")
_W = {
    c: f"w_{c} AS (SELECT w, row_number() OVER (ORDER BY md5('42-' || w), w) AS no FROM (SELECT {c} AS w FROM s WHERE {c} IS NOT NULL UNION SELECT {c} FROM st WHERE {c} IS NOT NULL))" for c in ("pc_nm", "corner_nm", "str_nm", "buyer_nm")
}
_TWO = f"{_S}, {sales_sql('test_transactions', 'st')}, {', '.join(_W.values())}"
_BITS = "length(ltrim(bin({0}::BIGINT), '0'))"
_CHANNELS = {**{c: f"coalesce(w_{c}.no, 0)" for c in _W}, "amount": f"CASE WHEN net_amt < 0 THEN -{_BITS.format('-net_amt')} WHEN net_amt > 0 THEN {_BITS.format('net_amt')} ELSE 0 END", "hour": "h + 1", "gap": f"CASE WHEN gap IS NULL THEN 0 ELSE {_BITS.format('gap + 1')} END"}
SQL = {
    "informative_columns": f"WITH b AS ({BLOCKS['semantic_share'].sql()}) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name FROM b HAVING var_samp({c}) >= 1e-6 AND avg(CASE WHEN {c} <> 0 THEN 1.0 ELSE 0 END) >= 0.003::DOUBLE" for c in BLOCKS["semantic_share"].steps[-1][1] if c != "custid"),
    "token_map": f"{_TWO} " + " UNION ALL ".join(f"SELECT '{c}' AS level, w AS name, no FROM w_{c}" for c in _W),
    "sequence_channels": f"""{_TWO}, x AS (SELECT *, row_number() OVER (PARTITION BY custid ORDER BY ts DESC, line_id DESC) AS k, date_diff('day', lag(d) OVER (PARTITION BY custid ORDER BY ts, line_id), d) AS gap FROM (SELECT * FROM s UNION ALL SELECT * FROM st)),
y AS (SELECT custid, k, {", ".join(f"({e})::INTEGER AS c_{n}" for n, e in _CHANNELS.items())} FROM x {" ".join(f"LEFT JOIN w_{c} ON w_{c}.w = x.{c}" for c in _W)} WHERE k <= 60)
SELECT custid, {", ".join(f"repeat('0 ', CAST(60 - count(*) AS INTEGER)) || string_agg(CAST(c_{n} AS VARCHAR), ' ' ORDER BY k DESC) AS {n}" for n in _CHANNELS)} FROM y GROUP BY custid""",
    "store_counts": f"""{_S}, {sales_sql("test_transactions", "st")}, b AS (SELECT custid, str_nm FROM s UNION ALL SELECT custid, str_nm FROM st), v AS (SELECT DISTINCT str_nm FROM b WHERE str_nm IS NOT NULL), c AS (SELECT DISTINCT custid FROM b)
SELECT c.custid, v.str_nm, count(b.custid) AS n FROM c CROSS JOIN v LEFT JOIN b ON b.custid = c.custid AND b.str_nm = v.str_nm GROUP BY ALL""",
    "category_top": f"{_S} SELECT part_nm, count(*) AS n_lines, {_q('avg(net_amt)', 'net_mean', 4)} FROM s WHERE part_nm IS NOT NULL GROUP BY part_nm ORDER BY n_lines DESC, part_nm LIMIT 20",
    "dim_weighted_mean": f"""{_S}, m AS (SELECT upper(trim(brd_nm)) AS brand, avg(target_age) AS target_age, avg(price_tier) AS price_tier, avg(open_year) AS open_year FROM brand_meta WHERE trim(brd_nm) <> '' GROUP BY 1),
g AS (SELECT avg(target_age) AS ga, avg(price_tier) AS gp, avg(open_year) AS go FROM m)
SELECT custid, {_q("sum(coalesce(target_age, ga) * (w + 1)) / sum(w + 1)", "target_age", 4)}, {_q("sum(coalesce(price_tier, gp) * (w + 1)) / sum(w + 1)", "price_tier", 4)}, {_q("sum(coalesce(open_year, go) * (w + 1)) / sum(w + 1)", "open_year", 4)}
FROM s LEFT JOIN m USING (brand), g GROUP BY custid""",
    "brand_spread": f"""{_S}, {sales_sql("test_transactions", "st")}, m AS (SELECT upper(trim(brd_nm)) AS brand, avg(target_age) AS target_age, avg(price_tier) AS price_tier, avg(open_year) AS open_year FROM brand_meta WHERE trim(brd_nm) <> '' GROUP BY 1),
x AS (SELECT custid, a + 1 AS v, target_age, price_tier, open_year FROM (SELECT * FROM s UNION ALL SELECT * FROM st) LEFT JOIN m USING (brand))
SELECT custid, {", ".join(f"coalesce({_q(e, 'x', 4).removesuffix(' AS x')}, 0) AS {c}_{n}" for c in ("target_age", "price_tier", "open_year") for n, e in {"mean": f"coalesce(sum({c} * v), 0) / (sum(v) + 1e-9)", "std": f"stddev_samp({c})", "min": f"min({c})", "max": f"max({c})"}.items())} FROM x GROUP BY custid""",
    "catalog_coverage": f"""{_S}, x AS (SELECT brand, count(*) AS n_lines, count(DISTINCT custid) AS n_customers FROM s WHERE brand IS NOT NULL GROUP BY brand),
p AS (SELECT brand, part_nm FROM (SELECT brand, part_nm, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, part_nm) AS k FROM s WHERE brand IS NOT NULL AND part_nm IS NOT NULL GROUP BY brand, part_nm) WHERE k = 1)
SELECT brand, n_lines, n_customers, part_nm, {_q("sum(n_lines) OVER (ORDER BY n_lines DESC, brand ROWS UNBOUNDED PRECEDING) / sum(n_lines) OVER ()", "covered")} FROM x LEFT JOIN p USING (brand)""",
    "copurchase_pairs": f"""{_S}, x AS (SELECT DISTINCT custid, date_trunc('month', ts) AS m, brand FROM s WHERE brand IS NOT NULL)
SELECT a.brand AS brand_a, b.brand AS brand_b, count(*) AS weight FROM x a JOIN x b ON a.custid = b.custid AND a.m = b.m AND a.brand < b.brand GROUP BY ALL HAVING count(*) >= 3""",
    "ppmi": f"""{_S}, o AS (SELECT brand FROM s WHERE brand IS NOT NULL GROUP BY brand HAVING count(*) >= 10), x AS (SELECT DISTINCT custid, brand FROM s JOIN o USING (brand)),
n AS (SELECT count(DISTINCT custid) AS n FROM x), c AS (SELECT brand, count(*) AS c FROM x GROUP BY brand),
p AS (SELECT a.brand AS brand_a, b.brand AS brand_b, count(*) AS n_ab FROM x a JOIN x b ON a.custid = b.custid AND a.brand < b.brand GROUP BY ALL)
SELECT brand_a, brand_b, n_ab, {_q("ln(n_ab * n.n / (ca.c::DOUBLE * cb.c))", "ppmi", 5)} FROM p JOIN c ca ON ca.brand = brand_a JOIN c cb ON cb.brand = brand_b, n WHERE ln(n_ab * n.n / (ca.c::DOUBLE * cb.c)) > 0""",
    "tfidf_tokens": _tfidf("SELECT custid, brand, count(*) AS n FROM s WHERE brand IS NOT NULL GROUP BY ALL", "brand", "c.n", 1),
    "tfidf_sublinear": _tfidf(
        "SELECT custid, tok, count(*) AS n FROM (SELECT custid, unnest(['part=' || regexp_replace(part_nm, '\\s+', '', 'g'), 'pc=' || pc_nm, 'h=' || h, 'amt=' || CASE WHEN net_amt < 0 THEN '-' ELSE '' END || CASE WHEN net_amt = 0 THEN 1 ELSE length(ltrim(bin(abs(net_amt)), '0')) END, 'g4=' || left(code, 4), 'g6=' || left(code, 6), 'g8=' || left(code, 8), 'step=' || lag(corner_nm) OVER (PARTITION BY custid ORDER BY ts, line_id) || '>' || corner_nm]) AS tok FROM s) WHERE tok IS NOT NULL GROUP BY ALL", "tok", "(1 + ln(c.n))", 5
    ),
    "category_sentence": f"""{_S}, p AS (SELECT custid, corner_nm, count(*) AS n, sum(a) AS amt FROM s WHERE corner_nm IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY custid ORDER BY amt DESC, n DESC, corner_nm) AS k FROM p)
SELECT custid, string_agg(corner_nm || ' ' || n || 'x ' || CAST(round(amt / 1000) AS BIGINT) || 'k', ', ' ORDER BY k) AS sentence FROM k WHERE k <= 20 GROUP BY custid""",
    "token_sequence": f"""{_S}, v AS (SELECT pc_nm, row_number() OVER (ORDER BY pc_nm) AS no FROM (SELECT DISTINCT pc_nm FROM s WHERE pc_nm IS NOT NULL)),
x AS (SELECT custid, ts, line_id, coalesce(no, 0) AS t, round(coalesce(sign(net_amt) * ln(1 + abs(net_amt)), 0) + 1e-10, 6) AS sl, row_number() OVER (PARTITION BY custid ORDER BY ts DESC, line_id DESC) AS k FROM s LEFT JOIN v USING (pc_nm))
SELECT custid, CAST(count(*) AS INTEGER) AS length, repeat('0 ', CAST(60 - count(*) AS INTEGER)) || string_agg(CAST(t AS VARCHAR), ' ' ORDER BY k DESC) AS tokens, {_q("sum(sl)", "amount_sum", 4)} FROM x WHERE k <= 60 GROUP BY custid""",
    "stage_clean_columns": f"WITH b AS (SELECT * FROM ({_BASE}) UNION ALL SELECT * FROM ({_BASE.replace('train_transactions', 'test_transactions')})), c AS (SELECT custid, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _COLS)} FROM b), q AS (SELECT {', '.join(f'quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}' for c in _COLS)} FROM c) "
    f"SELECT custid, {', '.join(_q(f'ln(1 + greatest(greatest(least({c}, hi_{c}), lo_{c}), 0))', c) for c in _COLS)} FROM c, q",
}
