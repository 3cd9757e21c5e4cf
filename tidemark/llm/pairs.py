"""Items that appear together: co-occurrence counts by a blocked Gram matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.gram import gram_sums
from tidemark.operators.rank import spread_rank
from tidemark.session import cut, if_small


def item_numbers(df: DataFrame, items: dict[str, Column], least: int) -> DataFrame:
    """``level, item, no`` for the items with at least ``least`` rows, numbered from 0 by level. An item
    with fewer rows can be in no pair with so many baskets."""
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), c.alias("item")) for x, c in items.items()]))
    often = df.select(pairs.alias("x")).select("x.*").where("item is not null and item <> ''").groupBy("level", "item").count().where(F.col("count") >= least)
    return cut(spread_rank(cut(often.select("level", "item")), ["level"], ["item"], name="no"))


def pairs_together(df: DataFrame, basket: dict[str, Column], items: dict[str, Column], min_pairs: int = 10, min_lift: float = 0.0) -> DataFrame:
    """``item_level, item_a, item_b, n_ab, n_a, n_b, n_baskets, lift, npmi`` of every pair of items with
    at least ``min_pairs`` common baskets and that lift, at each level of ``items``.

    Rows with the same values of ``basket``, none null, are one basket; an item counts once in it;
    null and empty items are none. ``lift`` is n_ab * n_baskets / (n_a * n_b), where ``n_baskets`` counts
    the baskets with an item of the level; ``npmi`` is its logarithm over -log(n_ab / n_baskets).
    ``item_a`` is the smaller string by code points.

    Method: baskets become rows of a binary sparse matrix over numbered items; each task sums the
    transpose-products of its record blocks, so that pairs leave it already added up; counts are then
    normalised by the marginals on the diagonal. A basket's item set is bounded by the number of items,
    it is gathered by a partial aggregate, and a task hands on its sums when it holds too many: one huge
    basket or customer needs no more memory than another. Empty tables give no rows.
    """
    levels = list(items)
    numbers = item_numbers(df, items, min_pairs)
    size = {r["level"]: r["n"] for r in numbers.groupBy("level").agg(F.count("*").alias("n")).collect()}
    size = {x: max(1, size.get(x, 1)) for x in levels}
    keys = list(basket)
    rows = df.select(*[c.alias(k) for k, c in basket.items()], *[F.when(c != "", c).alias(f"i_{x}") for x, c in items.items()]).where(" and ".join(f"{k} is not null" for k in keys))
    for x in levels:
        side = numbers.where(F.col("level") == x).select(F.col("item").alias(f"k_{x}"), F.col("no").cast("int").alias(f"no_{x}"))
        rows = rows.join(if_small(side), F.col(f"i_{x}") == F.col(f"k_{x}"), "left")
    aggs = [a for x in levels for a in (F.collect_set(f"no_{x}").alias(x), F.max(F.col(f"i_{x}").isNotNull()).alias(f"any_{x}"))]
    baskets = rows.groupBy(*keys).agg(*aggs)
    sums = cut(gram_sums(baskets, size).where((F.col("n") >= min_pairs) | (F.col("a") == F.col("b"))))
    n_of = {r["level"]: r["n"] for r in sums.where("a = -1").collect()}
    total = F.element_at(F.create_map(*[F.lit(v) for i in range(len(levels)) for v in (i, n_of.get(i, 0))]), F.col("level"))
    name = F.element_at(F.create_map(*[F.lit(v) for i, x in enumerate(levels) for v in (i, x)]), F.col("level"))
    single = sums.where("a = b and a >= 0").select(name.alias("item_level"), F.col("a").alias("no"), F.col("n").alias("n_of"))
    single = cut(single.join(numbers.withColumnRenamed("level", "item_level"), ["item_level", "no"]))
    one = lambda c: if_small(single.select("item_level", F.col("no").alias(c), F.col("item").alias(f"item_{c}"), F.col("n_of").alias(f"n_{c}")))
    pairs = sums.where("a <> b").select(name.alias("item_level"), total.alias("n_baskets"), "a", "b", F.col("n").alias("n_ab"))
    pairs = pairs.join(one("a"), ["item_level", "a"]).join(one("b"), ["item_level", "b"])
    swap = F.col("item_a") > F.col("item_b")
    lift = F.col("n_ab") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    # whole numbers compare without rounding; the least lift counts to four digits
    big = lambda c: F.col(c).cast("decimal(19,0)")
    enough = big("n_ab") * big("n_baskets") * F.lit(10_000) >= F.lit(round(min_lift * 10_000)) * (big("n_a") * big("n_b"))
    return pairs.where(enough).select(
        "item_level",
        F.when(swap, F.col("item_b")).otherwise(F.col("item_a")).alias("item_a"),
        F.when(swap, F.col("item_a")).otherwise(F.col("item_b")).alias("item_b"),
        "n_ab",
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
        "n_baskets",
        lift.alias("lift"),
        F.when(F.col("n_ab") < F.col("n_baskets"), F.log(lift) / -F.log(F.col("n_ab") / F.col("n_baskets"))).otherwise(1.0).alias("npmi"),
    )
