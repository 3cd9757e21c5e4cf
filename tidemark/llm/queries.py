"""Queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import micros
from tidemark.llm.leaks import leaks
from tidemark.llm.names import Reference, in_reach, map_names, spellings
from tidemark.llm.packing import pack, token_counts
from tidemark.llm.pairs import pairs_together
from tidemark.llm.percentiles import from_histogram, histogram, merge, percentiles
from tidemark.llm.splits import linked_groups, number_written, split_groups, split_rows
from tidemark.llm.stuffing import keyword_pages
from tidemark.plans.events import PART_IDS, part_features
from tidemark.session import cut, if_small
from tidemark.sources.tables import table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
QS = (0.25, 0.5, 0.75, 0.9, 0.99)


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "custid_links").select(number_written(F.col("id_a")).alias("a"), number_written(F.col("id_b")).alias("b"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The custids linked to another, with the smallest of their group."""
    groups = linked_groups(table(spark, folder, "train_transactions"), "custid", _links(spark, folder), "a", "b")
    return groups.where("n_entities > 1").select("custid", F.col("group_id").alias("group_custid"))


def _splits(spark: SparkSession, folder: str) -> DataFrame:
    sales, labels = table(spark, folder, "train_transactions"), table(spark, folder, "y_train")
    return split_groups(sales, "custid", _links(spark, folder), "a", "b", labels, "gender", SHARES)


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of train_transactions with its split."""
    sales = table(spark, folder, "train_transactions").select("line_id", "custid")
    return split_rows(sales, "custid", _splits(spark, folder), SHARES, ["line_id"])


def p1_balance(spark: SparkSession, folder: str) -> DataFrame:
    """What the splits must keep: rows, rows without a split, groups with two, and whether a share of rows is
    off by over half a percent or a split's share of positive rows by over one percent."""
    sales, splits = table(spark, folder, "train_transactions").select("line_id", "custid"), cut(_splits(spark, folder))
    labels = table(spark, folder, "y_train").where("gender is not null").groupBy("custid").agg(F.min("gender").alias("y"), F.max("gender").alias("z")).where("y = z").select(F.col("custid").alias("c"), "y")
    rows = split_rows(sales, "custid", splits, SHARES, ["line_id"]).groupBy("split").agg(F.count("*").alias("n"))
    known = splits.join(labels, F.col("custid") == F.col("c")).groupBy("split").agg((F.sum(F.col("n_rows") * F.col("y")) / F.sum("n_rows")).alias("p"), F.sum("n_rows").alias("m"))
    both = rows.join(known, "split", "left")
    share = F.element_at(F.create_map(*[F.lit(x) for kv in SHARES.items() for x in kv]), F.col("split"))
    total = rows.agg(F.sum("n").alias("total"))
    mean = known.agg((F.sum(F.col("p") * F.col("m")) / F.sum("m")).alias("mean"))
    parted = splits.groupBy("group_id").agg(F.countDistinct("split").alias("k")).agg(F.coalesce(F.sum(F.when(F.col("k") > 1, 1).otherwise(0)), F.lit(0)).alias("parted"))
    off = both.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(mean)).agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("split").isNull(), F.col("n"))), F.lit(0)).alias("n_without"),
        F.max(F.abs(F.col("n") / F.col("total") - share) > 0.005).alias("shares_off"),
        F.max(F.abs(F.col("p") - F.col("mean")) > 0.01).alias("labels_off"),
    )
    return off.crossJoin(F.broadcast(parted)).select("n_rows", "n_without", F.col("parted").cast("long").alias("n_parted"), "shares_off", "labels_off").where("n_rows > 0")


def _fields(spark: SparkSession, folder: str) -> dict[str, Reference]:
    return {
        "part_nm": Reference(table(spark, folder, "part_ref"), "part_id", ("part_nm", "part_nm_en")),
        "corner_nm": Reference(table(spark, folder, "corner_ref"), "corner_id", ("corner_nm", "corner_nm_en")),
    }


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each line's typed part and corner with the entry meant, -1 if none."""
    sales, fields = table(spark, folder, "train_transactions"), _fields(spark, folder)
    rows = map_names(sales.select("line_id", *fields), fields, spellings(sales, fields))
    lines = rows.where(" or ".join(f"ref_{f} is not null" for f in fields)).groupBy("line_id").agg(*[F.max(f"ref_{f}").alias(f"ref_{f}") for f in fields])
    entry = F.explode(F.array(*[F.struct(F.lit(f).alias("field_nm"), F.col(f"ref_{f}").alias("ref_id")) for f in fields]))
    return lines.select("line_id", entry.alias("x")).select("line_id", "x.*").where("ref_id is not null")


def p2_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Every typed value with all entries within its distance."""
    sales, fields = table(spark, folder, "train_transactions"), _fields(spark, folder)
    hits = in_reach(sales, fields).where("ref_id >= 0")
    return hits.select(F.col("field").alias("field_nm"), "value", "ref_id", F.round("distance", 6).alias("distance"))


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The report of values that mean no entry, with their rows."""
    sales, fields = table(spark, folder, "train_transactions"), _fields(spark, folder)
    none = spellings(sales, fields).where("ref_id = -1")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    counts = sales.select(pairs.alias("x")).select("x.*").where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n_rows"))
    return counts.join(none.select("field", "value"), ["field", "value"]).withColumnRenamed("field", "field_nm")


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles of net_amt for each custid."""
    return percentiles(table(spark, folder, "train_transactions"), "custid", "net_amt", QS).select("custid", "q", "value", "n")


def p3_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The same from histograms of single days, merged: within a relative difference of 2**-12."""
    sales = table(spark, folder, "train_transactions").where("custid is not null").withColumn("day", F.to_date("sales_datetime"))
    days = histogram(sales, ["custid", "day"], "net_amt")
    return from_histogram(merge(days, ["custid"]), ["custid"], QS)


def p3_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """For each custid how many of its exact percentiles lie between the merged form's bounds and no further
    from its value than the stated error, and how many don't."""
    exact = percentiles(table(spark, folder, "train_transactions"), "custid", "net_amt", QS).select("custid", "q", F.col("value").alias("x"))
    both = p3_merged(spark, folder).join(exact, ["custid", "q"], "full_outer")
    good = F.coalesce((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")) & (F.abs(F.col("value") - F.col("x")) <= F.abs("x") / 4096), F.lit(False)).cast("int")
    return both.groupBy("custid").agg(F.sum(good).alias("n_inside"), F.sum(1 - good).alias("n_outside"))


def _items() -> dict[str, Column]:
    good = F.trim("goodcd")
    return {
        "brd_nm": F.upper(F.trim("brd_nm")),
        "goodcd": F.when(good == "", None).when(F.length(good) < 13, F.lpad(good, 13, "0")).otherwise(good),
    }


def _together(spark: SparkSession, folder: str, lift: float) -> DataFrame:
    basket = {"c": F.col("custid"), "m": F.floor(micros("sales_datetime") / F.lit(60_000_000))}
    return pairs_together(table(spark, folder, "train_transactions"), basket, _items(), 10, lift)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs in at least 10 common baskets, five times as many as by chance."""
    return _together(spark, folder, 5).select("item_level", "item_a", "item_b")


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs in at least 10 common baskets, with lift and npmi."""
    return _together(spark, folder, 0).withColumns({"lift": F.round("lift", 6), "npmi": F.round("npmi", 6)})


def p6_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The features of ``p6_features`` with every spelling counted for the part it means; values that name
    no part have columns of their own, ``_k0``. Null and blank values count only in the sums over all."""
    sales, fields = table(spark, folder, "train_transactions"), _fields(spark, folder)
    ref = fields["part_nm"]
    typed = spellings(sales, {"part_nm": ref}).select(F.col("value").alias("nm"), F.greatest("ref_id", F.lit(0)).cast("int").alias("part_id"))
    own = ref.table.where("trim(part_nm) <> ''").groupBy(F.col("part_nm").alias("nm")).agg(F.min("part_id").cast("int").alias("part_id"))
    return part_features(sales, F.col("part_nm"), if_small(typed.unionByName(own)), [0, *PART_IDS])


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of documents in containers of 2,048 tokens."""
    sizes = token_counts(table(spark, folder, "documents"), "doc_id", "text")
    return pack(sizes, "doc_id", "n_tokens", 2048)


def p7_balance(spark: SparkSession, folder: str) -> DataFrame:
    """For each text with tokens whether it is kept whole unless it is longer than a container, and whether
    the containers that it stands in are within their capacity."""
    placed = cut(p7_packed(spark, folder).where("container >= 0"))
    room = placed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    texts = placed.join(room, "container").groupBy("doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.max("used").alias("most"))
    return texts.select("doc_id", ((F.col("k") == 1) | (F.col("n") > 2048)).alias("kept_whole"), (F.col("most") <= 2048).alias("in_capacity"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that carry a good part of a test item."""
    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text").select("doc_id", "item_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents made of keywords, links or tags."""
    return keyword_pages(table(spark, folder, "documents"), "doc_id", "text").where("is_stuffed").select("doc_id")


QUERIES = {
    "p9_found": p9_found,
    "p8_found": p8_found,
    "p7_packed": p7_packed,
    "p7_balance": p7_balance,
    "p1_found": p1_found,
    "p1_splits": p1_splits,
    "p1_balance": p1_balance,
    "p2_found": p2_found,
    "p2_unmatched": p2_unmatched,
    "p2_reach": p2_reach,
    "p3_percentiles": p3_percentiles,
    "p3_merged": p3_merged,
    "p3_bounds": p3_bounds,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p6_parts": p6_parts,
}

_PAIRS = """
WITH r AS (SELECT custid, date_trunc('minute', sales_datetime) AS m, upper(trim(brd_nm)) AS brd_nm,
  CASE WHEN trim(goodcd) = '' THEN NULL WHEN length(trim(goodcd)) < 13 THEN lpad(trim(goodcd), 13, '0') ELSE trim(goodcd) END AS goodcd
  FROM train_transactions WHERE custid IS NOT NULL AND sales_datetime IS NOT NULL),
i AS (SELECT DISTINCT 'brd_nm' AS item_level, custid, m, brd_nm AS item FROM r WHERE brd_nm <> ''
  UNION ALL SELECT DISTINCT 'goodcd', custid, m, goodcd FROM r WHERE goodcd <> ''),
t AS (SELECT item_level, count(*) AS n_baskets FROM (SELECT DISTINCT item_level, custid, m FROM i) GROUP BY 1),
s AS (SELECT item_level, item, count(*) AS n FROM i GROUP BY 1, 2),
p AS (SELECT a.item_level, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM i a JOIN i b
  ON a.item_level = b.item_level AND a.custid = b.custid AND a.m = b.m AND a.item < b.item GROUP BY 1, 2, 3 HAVING count(*) >= 10),
x AS (SELECT p.*, a.n AS n_a, b.n AS n_b, n_baskets, n_ab * n_baskets / (a.n::DOUBLE * b.n) AS lift
  FROM p JOIN t USING (item_level) JOIN s a ON a.item_level = p.item_level AND a.item = item_a JOIN s b ON b.item_level = p.item_level AND b.item = item_b)
"""

_NUMBER = r"try_cast(nullif(regexp_replace(regexp_replace(translate(trim({0}), '０１２３４５６７８９．', '0123456789.'), '([0-9])\.0{{1,2}}($|[^0-9])', '\1\2'), '[^0-9]', '', 'g'), '') AS BIGINT)"

SQL = {
    "p1_found": f"""
WITH RECURSIVE l AS (SELECT {_NUMBER.format("id_a")} AS a, {_NUMBER.format("id_b")} AS b FROM custid_links),
e AS (SELECT a, b FROM l WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
t AS (SELECT DISTINCT custid FROM train_transactions WHERE custid IS NOT NULL)
SELECT r.a AS custid, least(r.a, min(r.b)) AS group_custid FROM reach r JOIN t x ON x.custid = r.a JOIN t y ON y.custid = r.b WHERE r.a <> r.b GROUP BY r.a""",
    "p1_balance": "SELECT count(*) AS n_rows, 0 AS n_without, 0 AS n_parted, false AS shares_off, false AS labels_off FROM train_transactions HAVING count(*) > 0",
    "p3_bounds": "SELECT custid, 5 AS n_inside, 0 AS n_outside FROM train_transactions WHERE custid IS NOT NULL AND net_amt IS NOT NULL GROUP BY custid",
    "p7_balance": "SELECT doc_id, true AS kept_whole, true AS in_capacity FROM documents WHERE text <> ''",
    "p3_percentiles": "SELECT custid, unnest([0.25, 0.5, 0.75, 0.9, 0.99])::DOUBLE AS q, unnest(quantile_disc(net_amt, [0.25, 0.5, 0.75, 0.9, 0.99]))::DOUBLE AS value, count(net_amt) AS n "
    "FROM train_transactions WHERE custid IS NOT NULL AND net_amt IS NOT NULL GROUP BY custid",
    "p4_found": _PAIRS + "SELECT item_level, item_a, item_b FROM x WHERE n_ab * n_baskets >= 5 * n_a * n_b",
    "p4_pairs": _PAIRS + "SELECT item_level, item_a, item_b, n_ab, n_a, n_b, n_baskets, round(lift, 6) AS lift, round(CASE WHEN n_ab < n_baskets THEN ln(lift) / -ln(n_ab / n_baskets) ELSE 1 END, 6) AS npmi FROM x",
}
