"""Feature matrices: blocks and encodings by name, for the customers of both tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clean, learn
from tidemark.plans import blocks, encoders, representing
from tidemark.plans.blocks import BLOCKS
from tidemark.session import cut, if_small, use_checkpoints
from tidemark.sources import predictions as store
from tidemark.sources.sales import PLACES, held_lines, placed, sales
from tidemark.sources.tables import table

TABLES = {"train": "train_transactions", "test": "test_transactions"}

#: Blocks that are made at the same time: most of a block's jobs are too small for all cores.
AT_ONCE = 4


@dataclass(frozen=True)
class Config:
    """What a matrix holds. ``blocks`` are always in it, those of ``groups``, ``encodings``, ``factors`` and
    ``extra`` only if switched on; ``products`` are made of columns named <block>_<column>; columns of which
    a name holds a word of ``logs`` are clipped and put in logarithms; ``root`` is a folder for the cache."""

    name: str
    blocks: tuple[str, ...]
    groups: tuple[str, ...] = ()
    encodings: tuple[str, ...] = ()
    factors: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()
    use_groups: bool = True
    use_encodings: bool = True
    use_factors: bool = False
    use_extra: bool = True
    products: tuple[tuple[str, str, str], ...] = ()
    logs: tuple[str, ...] = ()
    root: str | None = None

    def names(self) -> list[str]:
        return [*self.blocks, *(self.groups * self.use_groups), *(self.encodings * self.use_encodings), *(self.factors * self.use_factors), *(self.extra * self.use_extra)]


GENERAL = Config(
    "general",
    ("base_agg", "composition_ratio", "diversity_brand", "diversity_corner", "diversity_store", "diversity_part", "diversity_zone", "amount_stats", "temporal_dynamics", "social_share", "social_dwell", "part_score", "interest_score", "buyer_variety", "recent_3", "recent_5",
     "freq_brand", "freq_good", "freq_corner", "freq_buyer", "freq_pc", "trajectory_delta", "amount_slope", "calendar_windows", "relative_price", "interarrival", "switch_rate", "dim_weighted_mean"),
    groups=("semantic_share",),
    encodings=(*(f"oof_te_{n}" for n in ("brand", "corner", "part", "pc", "good", "buyer", "store", "part_zone", "part_season", "transition")), *(f"hier_te_{n}" for n in encoders.PAIRS)),
    factors=("svd_counts", "lda_topics"),
    products=(
        ("oof_te_corner_wmean", "oof_te_brand_wmean", "mul"), ("part_score_score", "interest_score_score", "mul"), ("oof_te_corner_wmean", "base_agg_net_mean", "mul"), ("temporal_dynamics_recency_days", "temporal_dynamics_lines_per_month", "mul"),
        ("social_dwell_longstay_share", "oof_te_corner_wmean", "mul"), ("freq_brand_rare_share", "oof_te_brand_wmean", "mul"), ("semantic_share_cosmetic_amt", "semantic_share_men_amt", "mul"), ("oof_te_corner_wmean", "temporal_dynamics_active_months", "div"),
    ),
)
CODES = Config(
    "codes",
    ("style", "behavior", "pivot_counts", "interest_share", "base_gross", "discount_peak", "refund_strength", "social_gross", "dwell_gross", "recent_3", "recent_5", "household_share", "diversity_brand", "diversity_corner"),
    encodings=("minsupport_te", "bayes_te"),
    extra=("calendar_windows_kr", "tot_quantiles", "quantile_gap_daily", "score_conditional_agg", "time_decay_score", "rate_deviation", "code_hierarchy", "top_tail_share", "brand_hhi", "gap_shape", "group_switch", "price_residual", "velocity", "refund_per_discount", "basket_stats", "sequence_price",
           "sibling_days", "buyer_niche", "food_anchor", "drift_cosine", "season_align"),
    logs=("amt", "sum", "ticket", "refund", "recency", "span", "freq", "total"),
)


def _rows(spark: SparkSession, folder: str, name: str, lines: dict[str, DataFrame]) -> DataFrame:
    """A block's rows for the customers of both tables, its columns named after it."""
    if name in BLOCKS:
        block = BLOCKS[name]
        out = block.over(lines["train"].unionByName(lines["test"])) if len(block.tables) > 1 else block.over(lines["train"]).unionByName(block.over(lines["test"]))
    elif name in encoders.QUERIES:
        out = encoders.QUERIES[name](spark, folder)
    elif name in representing.WHOLE:
        out = representing.WHOLE[name](spark, folder)
    else:
        # made of one table at a time
        parts = [representing.OVER[name](spark, folder, t) for t in TABLES.values()]
        out = parts[0].unionByName(parts[1])
    return out.select("custid", *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in out.columns if c != "custid"])


def _finite(block: DataFrame) -> DataFrame:
    return block.select("custid", *[clean.finite(F.col(c)).alias(c) for c in block.columns if c != "custid"])


def build(spark: SparkSession, folder: str, config: Config) -> DataFrame:
    """``custid, split`` and all columns, nulls and what isn't finite as 0, of every customer with lines; the
    schema is the same for both tables. The lines of a table are shuffled and deduplicated once and kept in
    that partitioning, with their places among the customer's, for all blocks and encoders; encoders that can
    share passes do so (``encoders.together``). Each block is cut, so that no plan holds more than one,
    and all meet in one shuffle by custid (``clean.gathered``)."""
    use_checkpoints(spark)
    lines = {s: placed(sales(spark, folder, t)).persist() for s, t in TABLES.items()}
    try:
        spine = cut(lines["train"].select("custid").distinct().withColumn("split", F.lit("train")).unionByName(lines["test"].select("custid").distinct().withColumn("split", F.lit("test"))))
        twice = cut(spine.groupBy("custid").count().where("count > 1").select("custid"))
        apart = twice.isEmpty()
        # a place among the lines of one table is one among all only if no customer is in both
        held = lines if apart else {s: df.drop(*PLACES) for s, df in lines.items()}
        alone, shared = config.names(), []
        if apart and encoders.kinds(alone):
            shared = [n for n in alone if encoders.kinds([n])]
            alone = [n for n in alone if n not in shared]
        with held_lines(spark, folder, {t: held[s] for s, t in TABLES.items()}), ThreadPoolExecutor(AT_ONCE) as pool:
            first = [pool.submit(lambda: cut(_finite(encoders.together(spark, folder, shared))))] if shared else []
            made = [*pool.map(lambda n: cut(_finite(_rows(spark, folder, n, held))), alone), *[x.result() for x in first]]
    finally:
        for one in lines.values():
            one.unpersist()
    own = {n: [c for c in b.columns if c != "custid"] for n, b in zip(alone, made, strict=False)} | {n: [f"{n}_{c}" for c in encoders.COLUMNS[n]] for n in shared}
    wide = clean.gathered(spine, made, "custid")
    if not apart:
        # who is in both tables has every pair of their rows, as the joins give them
        joined = spine.join(twice, "custid", "left_semi")
        for i in range(0, len(made), 8):
            joined = cut(clean.on_spine(joined, [b.join(twice, "custid", "left_semi") for b in made[i : i + 8]], "custid"))
        once = spine.join(twice, "custid", "left_anti")
        wide = clean.gathered(once, [b.join(twice, "custid", "left_anti") for b in made], "custid").unionByName(joined)
    wide = wide.select("custid", "split", *[c for n in config.names() for c in own[n]])
    names = [c for c in wide.columns if c not in ("custid", "split")]
    if config.logs:
        wide = clean.clip_log(wide, [c for c in names if any(w in c for w in config.logs)])
    return clean.interactions(wide, [p for p in config.products if p[0] in names and p[1] in names])


def matrix(spark: SparkSession, folder: str, config: Config) -> DataFrame:
    """``build``, read from the cache under ``config.root`` if it is there."""
    if config.root is None:
        return build(spark, folder, config)
    options = {k: v for k, v in asdict(config).items() if k == "name" or k.startswith("use_")}
    return store.cached(spark, config.root, options, lambda: build(spark, folder, config))


def _shown(df: DataFrame) -> DataFrame:
    """To four significant digits: among this many numbers some sums, added up in another order, differ in
    any last digit that is shown. The factor takes exact halves up in every engine."""
    return df.select("custid", "split", *[F.format_string("%.3e", F.col(c) * (1 + 1e-9)).cast("double").alias(c) for c in df.columns if c not in ("custid", "split")])


def feature_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """All general blocks with encodings and products, for both tables."""
    return _shown(matrix(spark, folder, GENERAL))


def feature_matrix_codes(spark: SparkSession, folder: str) -> DataFrame:
    """All blocks of codes and behaviour with their optional ones, amounts in logarithms, for both tables."""
    return _shown(matrix(spark, folder, CODES))


def matrix_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees over the whole general matrix: labelled customers out of fold, those of
    test_transactions by the mean over the folds."""
    wide = matrix(spark, folder, GENERAL)
    # one vector a customer, cut once: the wide rows are planned and written for nothing else
    rows = cut(learn.assemble(wide, [c for c in wide.columns if c not in ("custid", "split")], ["custid", "split"]))
    train = rows.where("split = 'train'").join(if_small(cut(encoders.folds_of(spark, folder))), "custid").select("custid", "label", "fold", "features")
    return learn.oof_predict(lambda: learn.learner("gbt", maxIter=5, maxDepth=3), train, rows.where("split = 'test'").select("custid", "features"), at_once=5)


QUERIES = {"feature_matrix": feature_matrix, "feature_matrix_codes": feature_matrix_codes, "matrix_trees": matrix_trees}


def _sql(config: Config) -> str:
    """The matrix out of its blocks' oracles."""
    every = blocks.SQL | encoders.SQL | representing.SQL
    parts, columns, joins = [], [], []
    for k, name in enumerate(config.names()):
        sql = every[name]
        alone = name in encoders.SQL or (name in BLOCKS and len(BLOCKS[name].tables) > 1)
        parts.append(f"b{k} AS (SELECT * FROM ({sql})" + ("" if alone else f" UNION ALL SELECT * FROM ({sql.replace('train_transactions', 'test_transactions')})") + ")")
        joins.append(f"LEFT JOIN b{k} ON b{k}.custid = spine.custid")
        own = COLUMNS[name]
        columns += [(f"{name}_{c}", f"CASE WHEN isfinite(b{k}.{c}::DOUBLE) THEN b{k}.{c}::DOUBLE ELSE 0 END") for c in own]
    spine = "spine AS (SELECT DISTINCT custid, 'train' AS split FROM train_transactions WHERE custid IS NOT NULL AND sales_datetime IS NOT NULL UNION ALL SELECT DISTINCT custid, 'test' FROM test_transactions WHERE custid IS NOT NULL AND sales_datetime IS NOT NULL)"
    wide = f"wide AS (SELECT spine.custid, split, {', '.join(f'{e} AS {n}' for n, e in columns)} FROM spine {' '.join(joins)})"
    names = [n for n, _ in columns]
    logged = [n for n in names if any(w in n for w in config.logs)]
    edges = f", q AS (SELECT {', '.join(f'quantile_cont({n}, 0.01) AS lo_{n}, quantile_cont({n}, 0.99) AS hi_{n}' for n in logged)} FROM wide)" if logged else ""
    value = {n: f"ln(1 + greatest(least({n}, hi_{n}), lo_{n}, 0))" if n in logged else n for n in names}
    for a, b, op in config.products:
        value[f"{a}_{op}_{b}"] = f"{a} * {b}" if op == "mul" else f"{a} / (abs({b}) + 1e-5)"
    out = ", ".join(f"printf('%.3e', ({e}) * (1 + 1e-9::DOUBLE))::DOUBLE AS {n}" for n, e in value.items())
    return f"WITH {', '.join(parts)}, {spine}, {wide}{edges} SELECT custid, split, {out} FROM wide{', q' if logged else ''}"


def _columns(name: str) -> list[str]:
    if name in BLOCKS:
        return [c for c in next(s for s in reversed(BLOCKS[name].steps) if s[0] == "out")[1] if c != "custid"]
    if name in encoders.COLUMNS:
        return encoders.COLUMNS[name]
    return ["target_age", "price_tier", "open_year"]


COLUMNS = {n: _columns(n) for c in (GENERAL, CODES) for n in c.names()}
SQL = {"feature_matrix": _sql(GENERAL), "feature_matrix_codes": _sql(CODES)}
