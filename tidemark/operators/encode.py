"""Out-of-fold encoders in one pass: what other folds say is the total less the own fold's share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rank import digest_rank
from tidemark.session import cut, if_small


def entity_folds(labels: DataFrame, entity: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``entity, label, fold`` of the entities with one label, in stratified folds: the place within the
    label by md5(seed-entity), modulo ``folds``. Null and contradicting labels are left out."""
    one = labels.where(F.col(entity).isNotNull() & F.col(label).isNotNull()).groupBy(entity).agg(F.min(label).alias("label"), F.max(label).alias("__y"))
    one = cut(one.where("label = __y").select(entity, "label"))
    return digest_rank(one, ["label"], entity, seed).select(entity, "label", (F.col("rank") % folds).cast("int").alias("fold"))


def category_counts(lines: DataFrame, entity: str, keys: Sequence[str]) -> DataFrame:
    """``entity, keys, n``: how often an entity has a category. Null categories are none."""
    return lines.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(entity, *keys).agg(F.count("*").alias("n"))


#: The fold of encoders that are fit on all folds, for entities without a label.
WHOLE = -1


def leave_out(counts: DataFrame, keys: Sequence[str], folds: int = 5) -> DataFrame:
    """``keys, fold, s, m``: positives and rows of each category over all folds but ``fold``, and over all
    of them with the fold ``WHOLE``. ``counts`` has keys, label, fold and n. Sums by (category, fold) are added up before the shuffle, so a hot
    category is a handful of rows, and every category's folds are gathered in an array of ``folds``."""
    own = counts.groupBy(*keys, "fold").agg(F.sum(F.col("n") * F.col("label")).alias("fs"), F.sum("n").alias("fm"))
    whole = own.groupBy(*keys).agg(F.sum("fs").alias("ts"), F.sum("fm").alias("tm"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("fs", "fm")))).alias("by"))
    rows = whole.withColumn("fold", F.explode(F.sequence(F.lit(WHOLE), F.lit(folds - 1))))
    mine = F.try_element_at("by", F.col("fold"))
    return rows.select(*keys, "fold", (F.col("ts") - F.coalesce(mine["fs"], F.lit(0))).alias("s"), (F.col("tm") - F.coalesce(mine["fm"], F.lit(0))).alias("m"))


def smoothed(s: Column | str, m: Column | str, prior: Column | float, strength: float) -> Column:
    """(s + strength * prior) / (m + strength)."""
    s, m = (F.col(x) if isinstance(x, str) else x for x in (s, m))
    return (s + F.lit(float(strength)) * prior) / (m + F.lit(float(strength)))


def join_rate(rows: DataFrame, rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``rates`` by keys and fold; a small table of rates is broadcast."""
    return rows.join(if_small(cut(rates)), [*keys, "fold"], "left")


def target_encode(counts: DataFrame, test: DataFrame, entity: str, key: str, prior: float, alpha: float = 20.0, folds: int = 5) -> DataFrame:
    """``entity, wmean, max, min, std, extreme_hi, extreme_lo, conf`` of an entity's categories' smoothed
    rates. Entities of ``counts`` (with label and fold) see the other folds only; those of ``test`` are
    encoded by each fold's encoder and averaged. Unseen categories have the rate ``prior``."""
    rates = leave_out(counts, [key], folds).select(key, "fold", smoothed("s", "m", prior, alpha).alias("r"))
    rates = if_small(cut(rates))
    train = counts.select(entity, key, "n", "fold")
    copies = test.select(entity, key, "n").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rows = train.unionByName(copies).join(rates, [key, "fold"], "left").withColumn("r", F.coalesce("r", F.lit(prior)))
    n, r = F.col("n"), F.col("r")
    per = rows.groupBy(entity, "fold").agg(
        (F.sum(n * r) / F.sum(n)).alias("wmean"),
        F.max(r).alias("max"),
        F.min(r).alias("min"),
        F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("std"),
        (F.sum(F.when(r > 0.8, n).otherwise(0)) / F.sum(n)).alias("extreme_hi"),
        (F.sum(F.when(r < 0.2, n).otherwise(0)) / F.sum(n)).alias("extreme_lo"),
        (F.sum(F.abs(r - 0.5) * n) / F.sum(n)).alias("conf"),
    )
    return per.groupBy(entity).agg(*[F.avg(c).alias(c) for c in ("wmean", "max", "min", "std", "extreme_hi", "extreme_lo", "conf")])


def weighted_std(x: Column, n: Column) -> Column:
    """Sample deviation over rows that stand for ``n`` equal ones, from sums alone; 0 for one row."""
    total, s, q = F.sum(n), F.sum(n * x), F.sum(n * x * x)
    return F.when(total > 1, F.sqrt(F.greatest((q - s * s / total) / (total - 1), F.lit(0.0)))).otherwise(0.0)


def hierarchical_encode(counts: DataFrame, test: DataFrame, entity: str, child: str, parent: str, prior: float, c_up: float = 20.0, c_lo: float = 10.0, folds: int = 5) -> DataFrame:
    """``entity, up_mean, shr_mean, shr_std, res_mean, res_std``: the parent's smoothed rate is the prior of
    the child's, and what is left is the residual; out of fold, over an entity's rows. Entities of
    ``test`` are encoded by each fold's encoder and averaged."""
    up = leave_out(counts, [parent], folds).select(parent, "fold", smoothed("s", "m", prior, c_up).alias("up"))
    low = leave_out(counts, [parent, child], folds)
    copies = test.select(entity, parent, child, "n").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rows = counts.select(entity, parent, child, "n", "fold").unionByName(copies)
    rows = join_rate(join_rate(rows, low, [parent, child]), up, [parent]).withColumn("up", F.coalesce("up", F.lit(prior)))
    none = F.lit(0)
    rows = rows.withColumn("shr", smoothed(F.coalesce("s", none), F.coalesce("m", none), F.col("up"), c_lo))
    res, n = F.col("shr") - F.col("up"), F.col("n")
    mean = lambda x: F.sum(n * x) / F.sum(n)
    per = rows.groupBy(entity, "fold").agg(
        mean(F.col("up")).alias("up_mean"), mean(F.col("shr")).alias("shr_mean"), weighted_std(F.col("shr"), n).alias("shr_std"), mean(res).alias("res_mean"), weighted_std(res, n).alias("res_std")
    )
    return per.groupBy(entity).agg(*[F.avg(c).alias(c) for c in ("up_mean", "shr_mean", "shr_std", "res_mean", "res_std")])


def fold_means(counts: DataFrame, folds: int = 5) -> dict[int, float]:
    """The mean label over the rows of all folds but each, and over all: ``folds`` + 1 numbers."""
    own = {r["fold"]: (r["s"], r["m"]) for r in counts.groupBy("fold").agg(F.sum(F.col("n") * F.col("label")).alias("s"), F.sum("n").alias("m")).collect()}
    s, m = sum(x for x, _ in own.values()), sum(x for _, x in own.values())
    out = {WHOLE: s / m if m else 0.5}
    for f in range(folds):
        a, b = own.get(f, (0, 0))
        out[f] = (s - a) / (m - b) if m > b else out[WHOLE]
    return out


def by_fold(means: dict[int, float]) -> Column:
    """A row's mean by its fold."""
    return F.element_at(F.create_map(*[F.lit(x) for f, v in means.items() for x in (f, float(v))]), F.col("fold"))


def line_rates(counts: DataFrame, keys: Sequence[str], prior: Column | float, strength: float = 0.0, least: int = 0, folds: int = 5) -> DataFrame:
    """``keys, fold, r``: each category's label rate over the other folds' rows, or all rows; smoothed to
    ``prior`` with ``strength``, or ``prior`` itself below ``least`` rows."""
    prior = F.lit(prior) if isinstance(prior, float) else prior
    rates = leave_out(counts, keys, folds)
    if strength:
        return rates.select(*keys, "fold", smoothed("s", "m", prior, strength).alias("r"))
    return rates.select(*keys, "fold", F.when(F.col("m") < max(least, 1), prior).otherwise(F.col("s") / F.col("m")).alias("r"))


def line_scores(counts: DataFrame, key: str, strength: float = 0.0, least: int = 0, folds: int = 5) -> DataFrame:
    """``line_rates`` of one category with the mean of the rows that the encoder is fit on as ``prior``."""
    prior = by_fold(fold_means(counts, folds))
    return line_rates(counts, [key], prior, strength, least, folds).withColumn("prior", prior)
