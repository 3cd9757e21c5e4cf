"""Splits that keep related records together: components, then grouped iterative stratification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.rank import spread_rank
from tidemark.session import cut, if_small


def number_written(text: Column) -> Column:
    """The whole number that ``text`` writes, null if none: digits of any width, whatever marks stand
    around or between them; a decimal part of one or two zeros is no part of it."""
    plain = F.translate(F.trim(text), "０１２３４５６７８９．", "0123456789.")
    digits = F.regexp_replace(F.regexp_replace(plain, r"(?<=[0-9])\.0{1,2}(?![0-9])", ""), "[^0-9]", "")
    return F.when(digits != "", digits.try_cast("long"))


def components(edges: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges``: ``root`` is the smallest node of its component.

    Alternates large-star and small-star steps, by which every edge comes to point at the smallest node
    in a number of rounds that grows with the logarithm of the longest path. Each round is two
    aggregates to a minimum, summed before they are shuffled, and joins back, which AQE splits where a
    hub has a large share of the edges; nothing is gathered by node. Each round's edges are cut, so a
    lost executor costs at most a round. Self-links, repeated links and links with a null side add
    nothing, but the node of a self-link is a component.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = cut(nodes)
    mark = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours above u go to the least of u and its neighbours
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its neighbours below go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components were not done after {most} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def linked_groups(entities: DataFrame, entity: str, links: DataFrame, a: str, b: str) -> DataFrame:
    """``entity, group_id`` for every distinct non-null entity: ``group_id`` is the smallest entity of
    those joined to it by ``links`` of whole numbers, directly or over others, absent ones included."""
    own = entities.select(F.col(entity).cast("long").alias("node")).where("node is not null").distinct()
    roots = components(links, a, b)
    placed = cut(own.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    first = placed.groupBy("root").agg(F.min("node").alias("group_id"), F.count("*").alias("n_entities"))
    return placed.join(first, "root").select(F.col("node").alias(entity), "group_id", "n_entities")


def plan_splits(items: Sequence[tuple], shares: dict[str, float]) -> list[dict[str, float]]:
    """Where each item's rows go: for each of ``items``, (divisible, rows, *rows by label), the share of
    every split. Iterative stratification over items: the label with the fewest rows outstanding is
    taken first, its largest whole item goes to the split that lacks most of that label (then most
    rows), and divisible items are parted as the splits lack it. The last label is 'no label'."""
    names = list(shares)
    n_labels = len(items[0]) - 2 if items else 0
    need = {s: [shares[s] * sum(x[2 + j] for x in items) for j in range(n_labels)] for s in names}
    lack = {s: shares[s] * sum(x[1] for x in items) for s in names}
    out: list[dict[str, float]] = [{} for _ in items]
    left = set(range(len(items)))

    def place(i: int, parts: dict[str, float]) -> None:
        out[i] = parts
        for s, p in parts.items():
            lack[s] -= p * items[i][1]
            for j in range(n_labels):
                need[s][j] -= p * items[i][2 + j]
        left.discard(i)

    # a whole item that fits only the largest split must not be left to the end
    while left:
        rest = [sum(items[i][2 + j] for i in left) for j in range(n_labels)]
        alive = [j for j in range(n_labels) if rest[j] > 0]
        if not alive:
            for i in list(left):
                place(i, {max(names, key=lambda s: lack[s]): 1.0})
            break
        j = min(alive, key=lambda j: (rest[j], j))
        having = [i for i in left if items[i][2 + j] > 0]
        whole = [i for i in having if not items[i][0]]
        if whole:
            i = max(whole, key=lambda i: (items[i][1], -i))
            place(i, {max(names, key=lambda s: (need[s][j], lack[s])): 1.0})
            continue
        for i in having:
            wants = {s: max(0.0, need[s][j]) for s in names}
            total = sum(wants.values())
            place(i, {s: w / total for s, w in wants.items()} if total > 0 else dict(shares))
    return out


def split_groups(
    rows: DataFrame, entity: str, links: DataFrame, a: str, b: str, labels: DataFrame, label: str, shares: dict[str, float], n_labels: int = 2, whole_share: float = 0.001
) -> DataFrame:
    """``entity, group_id, split`` for every distinct non-null entity of ``rows``: linked entities share a
    split, the splits hold the given shares of the rows, and each label's shares of rows stay alike.

    Method: grouped iterative stratification. Components of the links give the groups; each group's
    label vector counts its rows by label. Groups with over ``whole_share`` of the rows, of which there
    are at most 1 / ``whole_share``, are placed one by one, rarest outstanding label first, into the
    split needing it most (``plan_splits``); the others are summed into types by the powers of two in
    their label vectors, at most a few thousand, and each type is parted among the splits. Within a type
    the groups stand in a hashed order, and each goes where the middle of its rows falls in the parts,
    so that a type misses its plan by less than one group at each border. Only the whole groups and the
    table of types reach the driver.

    Defined cases: ``labels`` may repeat an entity; one with two different labels, none or null is 'no
    label', itself a class that is kept alike. Labels are 0 to ``n_labels`` - 1, others are no label.
    Entities of ``labels`` without rows are not listed. Rows with a null entity: see ``split_rows``.
    An empty table gives no rows.
    """
    known = labels.select(F.col(entity).alias("e"), F.col(label).alias("y")).where("e is not null and y is not null").groupBy("e").agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    known = known.select("e", F.when((F.col("y0") == F.col("y1")) & F.col("y0").between(0, n_labels - 1), F.col("y0")).alias("y"))
    counts = cut(rows.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("e")).agg(F.count("*").alias("n")))
    groups = linked_groups(counts, "e", links, a, b)
    per = counts.join(groups, "e").join(known, "e", "left").withColumn("y", F.coalesce("y", F.lit(n_labels)))
    per = cut(per.select("e", "group_id", "n", "y"))
    vec = [f"n{j}" for j in range(n_labels + 1)]
    totals = per.groupBy("group_id").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("y") == j, F.col("n")).otherwise(0)).alias(v) for j, v in enumerate(vec)])
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kind = F.when(F.col("n") > total * whole_share, F.lit(None)).otherwise(F.concat_ws(",", *[F.floor(F.log2(F.col(v) + 1)).cast("string") for v in vec]))
    totals = cut(totals.withColumn("kind", kind))
    whole = totals.where("kind is null").orderBy("group_id").collect()
    kinds = totals.where("kind is not null").groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("n", *vec)]).orderBy("kind").collect()
    parts = plan_splits([(False, r["n"], *[r[v] for v in vec]) for r in whole] + [(True, r["n"], *[r[v] for v in vec]) for r in kinds], shares)
    spark, names = rows.sparkSession, list(shares)
    placed = spark.createDataFrame([(r["group_id"], next(iter(p))) for r, p in zip(whole, parts, strict=False)], "group_id long, split string")
    bounds = []
    for r, p in zip(kinds, parts[len(whole) :], strict=True):
        upto = 0.0
        for s in names:
            bounds.append((r["kind"], s, upto * r["n"], (upto + p.get(s, 0.0)) * r["n"]))
            upto += p.get(s, 0.0)
    # one row per kind: the bounds in order
    table = spark.createDataFrame(bounds, "kind string, split string, lo double, hi double").groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "split"))).alias("at"))
    ranked = spread_rank(totals.where("kind is not null").select("group_id", "kind", "n"), ["kind"], ["group_id"], weight="n", name="before")
    middle = F.col("before") + F.col("n") / 2
    ranked = ranked.join(F.broadcast(table), "kind")
    inside = F.filter("at", lambda x: (x["lo"] < middle) & (middle <= x["hi"]))
    # rounding at the upper end of the last part falls to the last part that isn't empty
    last = F.element_at(F.filter("at", lambda x: x["hi"] > x["lo"]), -1)["split"]
    small = ranked.select("group_id", F.coalesce(F.try_element_at(inside, F.lit(1))["split"], last).alias("split"))
    splits = cut(small.unionByName(placed))
    return per.join(splits, "group_id").select(F.col("e").alias(entity), "group_id", "split", F.col("n").alias("n_rows"))


def split_rows(rows: DataFrame, entity: str, splits: DataFrame, shares: dict[str, float], by: Sequence[str]) -> DataFrame:
    """``rows`` with their ``split``. Entities with over a thousandth of the rows, at most a thousand,
    come by a broadcast, so that none fills a task; the others by a shuffle. A row with a null entity has
    nothing to be kept with: it is placed by the hash of ``by`` in the given shares."""
    side = splits.select(F.col(entity).alias("__e"), F.col("split").alias("split"), "n_rows")
    total = side.agg(F.sum("n_rows")).first()[0] or 0
    hot = side.where(F.col("n_rows") > total / 1000).select(F.col("__e").alias("__h"), F.col("split").alias("__hs"))
    first = rows.join(F.broadcast(hot), F.col(entity) == F.col("__h"), "left")
    u = F.pmod(F.xxhash64(*by), F.lit(1_000_000)) / 1e6
    upto, alone = 0.0, None
    for s, p in shares.items():
        upto += p
        alone = F.when(u < upto, s) if alone is None else alone.when(u < upto, s)
    placed = first.withColumn("__hs", F.when(F.col(entity).isNull(), alone.otherwise(list(shares)[-1])).otherwise(F.col("__hs")))
    # rows that are placed match nothing and are spread by a hash
    free = F.col("__hs").isNull()
    placed = placed.withColumns({"__k": F.when(free, F.col(entity)), "__s": F.when(free, F.lit(0)).otherwise(F.pmod(F.xxhash64(*by), F.lit(1 << 20)))})
    rest = side.where(F.col("n_rows") <= total / 1000).select("__e", "split", F.lit(0).alias("__z"))
    return placed.join(if_small(rest, 100_000), (F.col("__k") == F.col("__e")) & (F.col("__s") == F.col("__z")), "left").select(*rows.columns, F.coalesce("__hs", "split").alias("split"))
