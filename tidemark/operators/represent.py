"""Token, vector and matrix representations of entities on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.recommendation import ALS
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.gram import gram_sums
from tidemark.operators.rank import spread_rank
from tidemark.operators.walks import walk_lists
from tidemark.session import cut, if_small


def dictionary(rows: DataFrame, token: str, least: int = 1) -> DataFrame:
    """``token, no, n``: tokens with at least ``least`` rows, numbered from 0 without a gap."""
    often = cut(rows.where(F.col(token).isNotNull()).groupBy(F.col(token).alias("token")).agg(F.count("*").alias("n")).where(F.col("n") >= least))
    return cut(spread_rank(often, [], ["token"], name="no"))


def sentences(lines: DataFrame, entity: str, slice_: str, order: Sequence[str], token: str) -> DataFrame:
    """``entity, slice, tokens``: the tokens of an entity's slice of time (a month, say) in order. A slice
    bounds the list; no entity is gathered as a whole."""
    rows = lines.where(F.col(token).isNotNull()).groupBy(entity, slice_).agg(F.array_sort(F.collect_list(F.struct(*order, token))).alias("x"))
    return rows.select(entity, slice_, F.transform("x", lambda s: s[token]).alias("tokens"))


def word_vectors(docs: DataFrame, size: int = 16, window: int = 5, epochs: int = 5, least: int = 3, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``word, vector`` by skip-gram over ``tokens``. ``partitions``, by default one for 50,000 documents, are
    trained side by side in each epoch and averaged."""
    docs = cut(docs)
    if partitions is None:
        partitions = max(1, docs.count() // 50_000)
    model = Word2Vec(vectorSize=size, windowSize=window, maxIter=epochs, minCount=least, seed=seed, numPartitions=partitions, inputCol="tokens", outputCol="v").fit(docs)
    return model.getVectors()


def pooled(counts: DataFrame, vectors: DataFrame, entity: str, token: str) -> DataFrame:
    """``entity, mean, max, std, idf_mean``: an entity's token vectors pooled, weighted by ``n`` and, for the
    last, by ln(N / (1 + df)) as well. Sums are made by parts, so a hot entity is no single task."""
    total = counts.select(entity).distinct().count()
    df = counts.groupBy(F.col(token).alias("word")).agg(F.log(F.lit(float(total)) / (1 + F.countDistinct(entity))).alias("idf"))
    side = if_small(cut(vectors.join(df, "word").select("word", "vector", F.greatest("idf", F.lit(0.0)).alias("idf"))))
    rows = counts.join(side, F.col(token) == F.col("word"))
    s = Summarizer.metrics("mean", "max", "std")
    out = rows.groupBy(entity).agg(s.summary(F.col("vector"), F.col("n").cast("double")).alias("s"), Summarizer.mean(F.col("vector"), F.col("n") * F.col("idf")).alias("idf_mean"))
    return out.select(entity, F.col("s.mean").alias("mean"), F.col("s.max").alias("max"), F.col("s.std").alias("std"), "idf_mean")


def sparse_rows(counts: DataFrame, entity: str, token: str, words: DataFrame, value: str = "n") -> DataFrame:
    """``entity, features``: a sparse vector over the numbered tokens; an entity has at most as many
    entries as there are tokens."""
    size = words.count()
    rows = counts.join(if_small(words.select(F.col("token").alias(token), "no")), token)
    pairs = rows.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col("no").cast("int").alias("i"), F.col(value).cast("double").alias("v")))).alias("x"))

    @F.udf(VectorUDT())
    def vector(x):
        return SparseVector(size, [e["i"] for e in x], [e["v"] for e in x])

    return pairs.select(entity, vector("x").alias("features"))


def _leading(times: Callable[[np.ndarray], np.ndarray], size: int, k: int, seed: int = 42, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` leading eigenvalues (by size) and eigenvectors of a symmetric matrix of which only the
    product with a thin basis is known, by subspace iteration with k + 10 columns."""
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(size, k + 10))))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(times(basis))[0]
    small = basis.T @ times(basis)
    values, inner = np.linalg.eigh((small + small.T) / 2)
    lead = np.argsort(-np.abs(values), kind="stable")[:k]
    return values[lead], (basis @ inner)[:, lead]


def _whole(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(m)
    lead = np.argsort(-np.abs(values), kind="stable")[:k]
    return values[lead], vectors[:, lead]


#: Entries of a batch that are multiplied at once: of their rows a task holds as many times k + 10 numbers.
_AT_ONCE = 100_000


def _summed(rows: DataFrame, basis: np.ndarray, add: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """A product with ``basis``, which is sent to all tasks: ``add`` adds a batch's share to a task's own sum,
    which is as large as the basis and handed on once, as its rows that aren't 0."""
    sent = rows.sparkSession.sparkContext.broadcast(basis)
    width = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        own = np.zeros_like(q)
        for batch in batches:
            if batch.num_rows:
                add(batch, q, own)
        at = np.flatnonzero(own.any(1))
        # in blocks of rows, of which the shuffle brings equal ones together
        for block in np.unique(at >> 8):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([own[block << 8 : (block + 1) << 8].tobytes()], pa.binary())], names=["a", "y"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for a, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(y).reshape(-1, width)
                found[a] = found[a] + part if a in found else part
        for a, y in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([y.tobytes()], pa.binary())], names=["a", "y"])

    got = rows.mapInArrow(run, "a long, y binary").repartition("a").mapInArrow(add_up, "a long, y binary").toArrow()
    out = np.zeros_like(basis)
    for a, y in zip(got["a"].to_pylist(), got["y"].to_pylist(), strict=True):
        out[a << 8 : (a + 1) << 8] = np.frombuffer(y).reshape(-1, width)
    sent.destroy()
    return out


def _gram_times(batch: pa.RecordBatch, q: np.ndarray, own: np.ndarray) -> None:
    """Adds X'(XQ) over a batch of rows (numbers i, values v)."""
    numbers, values = batch.column(batch.schema.get_field_index("i")), batch.column(batch.schema.get_field_index("v"))
    ends = np.asarray(numbers.offsets).astype(np.int64)
    ends -= ends[0]
    every_i, every_v = np.asarray(numbers.flatten()).astype(np.int64), np.asarray(values.flatten()).astype(float)
    lo = 0
    while lo < len(ends) - 1:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _AT_ONCE, "right")) - 1)
        i, v, n = every_i[ends[lo] : ends[hi]], every_v[ends[lo] : ends[hi]], np.diff(ends[lo : hi + 1])
        start = (ends[lo:hi] - ends[lo])[n > 0]
        lo = hi
        if len(i):
            xq = np.add.reduceat(v[:, None] * q[i], start)
            _add_rows(own, i, v[:, None] * np.repeat(xq, n[n > 0], axis=0))


def _add_rows(own: np.ndarray, at: np.ndarray, y: np.ndarray) -> None:
    """own[at] += y, where rows may come again."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    own[at[first]] += np.add.reduceat(y[order], first)


def _cell_times(batch: pa.RecordBatch, q: np.ndarray, own: np.ndarray) -> None:
    """Adds a symmetric matrix's cells, by those above the diagonal, times Q."""
    a, b, g = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("a", "b", "g"))
    for lo in range(0, len(a), _AT_ONCE):
        x, y, z = (c[lo : lo + _AT_ONCE] for c in (a, b, g))
        _add_rows(own, x, z[:, None] * q[y])
        _add_rows(own, y, z[:, None] * q[x])


def _outer(size: int):
    """Sums the outer products of a batch's rows and hands them on as (a, b, g)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, some = np.zeros((size, size)), False
        for pdf in batches:
            for i, v in zip(pdf["i"], pdf["v"], strict=True):
                m[np.ix_(i, i)] += np.outer(v, v)
                some = True
        if some:
            a, b = np.nonzero(m)
            yield pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64), "g": m[a, b]})

    return run


def count_svd(counts: DataFrame, entity: str, token: str, k: int, least: int = 1, value: str = "n", held: int = 4000) -> DataFrame:
    """``entity, factors``: the first ``k`` left singular vectors times their values of the entity-by-token
    matrix X. Its right vectors come from X'X, summed from outer products of the rows, up to ``held`` tokens;
    beyond, X'X is never made: subspace iteration (``_leading``) multiplies rows and a thin basis, of which
    the driver and every task hold k + 10 numbers a token. X V is a join and a sum."""
    words = dictionary(counts, token, least)
    size = words.count()
    rows = counts.join(if_small(words.select(F.col("token").alias(token), "no")), token).select(entity, "no", F.col(value).cast("double").alias("v"))
    lists = cut(rows.groupBy(entity).agg(F.collect_list("no").alias("i"), F.collect_list("v").alias("v")).select("i", "v"))
    k = min(k, max(1, size - 1))
    if size <= held:
        m, part = np.zeros((size, size)), lists.mapInPandas(_outer(size), "a long, b long, g double").groupBy("a", "b").agg(F.sum("g").alias("g")).toArrow()
        m[part["a"].to_numpy(), part["b"].to_numpy()] = part["g"].to_numpy()
        _, basis = _whole(m, k)
    else:
        _, basis = _leading(lambda q: _summed(lists, q, _gram_times), size, k)
    basis = basis * _signs(basis)
    side = rows.sparkSession.createDataFrame(pa.table({"no": pa.array(range(size), pa.int64()), "basis": pa.array(list(basis), pa.list_(pa.float64()))}))
    parts = rows.join(if_small(side), "no").select(entity, array_to_vector(F.transform("basis", lambda b: b * F.col("v"))).alias("x"))
    return parts.groupBy(entity).agg(vector_to_array(Summarizer.sum(F.col("x"))).alias("factors"))


def _signs(basis: np.ndarray) -> np.ndarray:
    """One sign for all runs: the greatest entry of a column is positive."""
    return np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1, 1) if len(basis) else np.ones(basis.shape[1])


def lda_topics(counts: DataFrame, entity: str, token: str, k: int, least: int = 2, seed: int = 42) -> DataFrame:
    """``entity, topics``: topic shares by online variational inference."""
    rows = cut(sparse_rows(counts, entity, token, dictionary(counts, token, least)))
    model = LDA(k=k, maxIter=10, optimizer="online", seed=seed).fit(rows)
    return model.transform(rows).select(entity, vector_to_array("topicDistribution").alias("topics"))


def als_factors(counts: DataFrame, entity: str, token: str, rank: int, implicit: bool = True, nonnegative: bool = False, reg: float = 0.05, iterations: int = 8, seed: int = 42) -> DataFrame:
    """``entity, factors`` by alternating least squares; entities and tokens are numbered without a gap."""
    words = dictionary(counts, token)
    people = cut(spread_rank(cut(counts.select(entity).distinct()), [], [entity], name="row"))
    rows = counts.join(if_small(words.select(F.col("token").alias(token), "no")), token).join(people, entity)
    rows = cut(rows.select(F.col("row").cast("int").alias("row"), F.col("no").cast("int").alias("no"), F.col("n").cast("float").alias("n")))
    als = ALS(rank=rank, maxIter=iterations, regParam=reg, implicitPrefs=implicit, nonnegative=nonnegative, userCol="row", itemCol="no", ratingCol="n", seed=seed)
    factors = als.fit(rows).userFactors.select(F.col("id").cast("long").alias("row"), F.col("features").alias("factors"))
    return people.join(factors, "row").select(entity, "factors")


def cluster_exposure(counts: DataFrame, vectors: DataFrame, entity: str, token: str, k: int, amount: str = "n", seed: int = 42) -> DataFrame:
    """``entity, c0 ... c<k-1>``: shares of ``amount`` by the k-means cluster of the token's vector."""
    model = KMeans(k=k, seed=seed, featuresCol="vector", predictionCol="c").fit(vectors)
    side = if_small(cut(model.transform(vectors).select(F.col("word").alias(token), "c")))
    rows = counts.join(side, token)
    return rows.groupBy(entity).agg(*[(F.sum(F.when(F.col("c") == i, F.col(amount)).otherwise(0)) / (F.sum(amount) + 1e-9)).alias(f"c{i}") for i in range(k)])


def ppmi(rows: DataFrame, entity: str, token: str, least: int = 10) -> DataFrame:
    """``token_a, token_b, n_ab, ppmi`` for tokens with at least ``least`` rows that stand at one entity:
    ln(n_ab * N / (n_a * n_b)) where positive, N the entities with a token. Counts come from a sparse Gram
    matrix over the entities' sets."""
    words = dictionary(rows, token, least)
    size = max(1, words.count())
    sets = rows.join(if_small(words.select(F.col("token").alias(token), F.col("no").cast("int").alias("no"))), token).groupBy(entity).agg(F.collect_set("no").alias("x"))
    sums = cut(gram_sums(sets.withColumn("any_x", F.size("x") > 0), {"x": size}))
    total = sums.where("a = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    single = cut(sums.where("a = b and a >= 0").join(words.select("token", F.col("no").alias("a")), "a").select("a", "token", F.col("n").alias("c")))
    one = lambda c: if_small(single.select(F.col("a").alias(c), F.col("token").alias(f"t{c}"), F.col("c").alias(f"n{c}")))
    pairs = sums.where("a <> b").join(one("a"), "a").join(one("b"), "b")
    score = F.log(F.col("n") * F.lit(float(total)) / (F.col("na").cast("double") * F.col("nb")))
    return pairs.select(F.least("ta", "tb").alias("token_a"), F.greatest("ta", "tb").alias("token_b"), F.col("n").alias("n_ab"), score.alias("ppmi")).where("ppmi > 0")


def random_walks(edges: DataFrame, a: str, b: str, walks: int = 10, length: int = 20, seed: int = 42, **args) -> DataFrame:
    """``start, walk, step, node``: ``walk_lists`` as rows, by the nodes' names."""
    nodes, lists = walk_lists(edges, a, b, walks, length, seed, **args)
    side = if_small(nodes)
    rows = lists.join(side.withColumnRenamed("node", "start"), "no").select("start", "walk", F.posexplode("nodes").alias("step", "no"))
    return rows.join(side, "no").select("start", "walk", "step", "node")


def label_propagation(edges: DataFrame, a: str, b: str, weight: str, rounds: int = 100) -> DataFrame:
    """``node, community``: every node takes the community with the greatest weight among its neighbours
    (and itself, by its strongest link), the smallest on ties, until nothing changes. Where communities come
    back to a state that they had, the nodes that swing take the smaller of their last two; not to end
    within ``rounds`` is an error."""
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v"), F.col(weight).alias("w")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"), F.col(weight).alias("w"))))
    own = e.groupBy("u").agg(F.max("w").alias("w"))
    now = own.select(F.col("u").alias("node"), F.col("u").alias("community"))
    seen: set[tuple] = set()
    for _ in range(rounds):
        votes = e.join(now, F.col("v") == F.col("node")).select("u", "community", "w").unionByName(own.join(now, F.col("u") == F.col("node")).select("u", "community", "w"))
        sums = votes.groupBy("u", "community").agg(F.sum("w").alias("w"))
        new = cut(sums.groupBy("u").agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("community")).withColumnRenamed("u", "node"))
        same = new.join(now.withColumnRenamed("community", "before"), "node").where("community <> before").isEmpty()
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("node", "community").cast("decimal(20,0)"))).first())
        if mark in seen and not same:
            return cut(new.join(now.withColumnRenamed("community", "before"), "node").select("node", F.least("community", "before").alias("community")))
        seen.add(mark)
        now = new
        if same:
            return now
    raise RuntimeError(f"communities did not settle in {rounds} rounds")


def tfidf(counts: DataFrame, entity: str, token: str, least_df: int = 1, sublinear: bool = False) -> DataFrame:
    """``entity, token, weight``: term frequency (or 1 + ln of it) times ln((1 + N) / (1 + df)) + 1, each
    entity's weights of length 1; tokens at under ``least_df`` entities are left out. ``counts`` has n."""
    total = counts.agg(F.countDistinct(entity)).first()[0]
    df = cut(counts.groupBy(F.col(token).alias("__t")).agg(F.count("*").alias("df")).where(F.col("df") >= least_df))
    tf = 1 + F.ln("n") if sublinear else F.col("n")
    rows = counts.join(if_small(df), F.col(token) == F.col("__t")).withColumn("x", tf * (F.ln((1.0 + total) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(entity)))
    return rows.select(entity, token, (F.col("x") / norm).alias("weight"))


def ppmi_vectors(rows: DataFrame, entity: str, token: str, k: int = 24, least: int = 10, held: int = 4000) -> DataFrame:
    """``word, vector``: leading eigenvectors of the tokens' PPMI matrix times the root of their values; up to
    ``held`` tokens from the whole matrix, beyond by subspace iteration over its cells."""
    words = dictionary(rows, token, least)
    size = words.count()
    one = lambda c: if_small(words.select(F.col("token").alias(f"token_{c}"), F.col("no").alias(c)))
    cells = cut(ppmi(rows, entity, token, least).join(one("a"), "token_a").join(one("b"), "token_b").select("a", "b", F.col("ppmi").alias("g")))
    k = min(k, max(1, size - 1))
    if size <= held:
        m, part = np.zeros((size, size)), cells.toArrow()
        a, b = part["a"].to_numpy(), part["b"].to_numpy()
        m[a, b] = m[b, a] = part["g"].to_numpy()
        values, vectors = _whole(m, k)
    else:
        values, vectors = _leading(lambda q: _summed(cells, q, _cell_times), size, k)
    x = vectors * np.sqrt(np.abs(values))
    x = x * _signs(x)
    side = rows.sparkSession.createDataFrame(pa.table({"no": pa.array(range(size), pa.int64()), "vector": pa.array(list(x), pa.list_(pa.float64()))}))
    return words.join(if_small(side), "no").select(F.col("token").alias("word"), "vector")


def weight_svd(weights: DataFrame, entity: str, token: str, k: int, least: int = 1) -> DataFrame:
    """``entity, factors`` of a TF-IDF matrix (``entity, token, weight``) by ``count_svd``."""
    return count_svd(weights.withColumnRenamed("weight", "n"), entity, token, k, least)


def subword_vectors(vectors: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """``word, vector``: each word's vector averaged with the mean of its character n-grams', a gram's vector
    being the mean over the words that hold it, so that rare and unlike spellings lean on their parts."""
    word = F.concat(F.lit("<"), "word", F.lit(">"))

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))

    grams = F.array_distinct(F.flatten(F.array(*[of(n) for n in range(least, most + 1)])))
    rows = cut(vectors.select("word", "vector", F.explode(grams).alias("gram")))
    means = cut(rows.groupBy("gram").agg(Summarizer.mean(F.col("vector")).alias("g")))
    parts = rows.select("word", "gram").join(means, "gram").groupBy("word").agg(vector_to_array(Summarizer.mean(F.col("g"))).alias("g"))
    both = vectors.join(parts, "word")
    return both.select("word", array_to_vector(F.zip_with(vector_to_array("vector"), "g", lambda a, b: (a + b) / 2)).alias("vector"))


def principal_components(df: DataFrame, columns: Sequence[str], entity: str, k: int) -> DataFrame:
    """``entity, components`` of the standardised columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    filled = df.select(entity, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    stages = [VectorAssembler(inputCols=list(columns), outputCol="f"), StandardScaler(inputCol="f", outputCol="s", withMean=True), PCA(inputCol="s", outputCol="p", k=k)]
    return Pipeline(stages=stages).fit(filled).transform(filled).select(entity, vector_to_array("p").alias("components"))
