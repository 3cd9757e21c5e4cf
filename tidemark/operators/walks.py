"""Random walks over a graph, and vectors of its nodes by skip-gram over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rank import spread_rank
from tidemark.session import cut, if_small

#: At most so many walks are multiplied at once, and so few that the commonest node is about so often among
#: them; a walk's pairs share so many drawn nodes as noise; the longest step of a node's vector in one go.
#: With longer ones the vectors of nodes that all walks meet grow without end.
_AT_ONCE, _TIMES, _NOISE, _LONGEST = 64, 12, 32, 0.5


def walk_lists(edges: DataFrame, a: str, b: str, walks: int = 10, length: int = 20, seed: int = 42, held: int = 20_000_000) -> tuple[DataFrame, DataFrame]:
    """``no, node``, the nodes of an undirected graph numbered from 0, and ``no, walk, nodes``: walks from every
    node as lists of numbers, each step to a neighbour drawn by a hash. Up to ``held`` links (each in both
    directions) the neighbours go to all tasks as one array; beyond, they are numbered within their node, so
    that a draw is a join on (node, place) and no node's neighbours are gathered. Both give the same rows."""
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u is not null and v is not null").distinct())
    nodes = cut(spread_rank(cut(both.select(F.col("u").alias("node")).distinct()), [], ["node"], name="no").select(F.col("no").cast("int").alias("no"), "node"))
    side = if_small(nodes)
    placed = spread_rank(both, ["u"], ["v"], name="place")
    for c in ("u", "v"):
        placed = placed.join(side.select(F.col("node").alias(c), F.col("no").alias(f"{c}_no")), c).drop(c)
    placed = cut(placed.select(F.col("u_no").alias("u"), F.col("place").cast("int").alias("place"), F.col("v_no").alias("v")))
    starts = nodes.select("no", "node", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"))
    drawn = _held_walks if placed.count() <= held else _joined_walks
    return nodes, drawn(starts, placed, length, seed)


def _joined_walks(starts: DataFrame, placed: DataFrame, length: int, seed: int) -> DataFrame:
    degree = cut(placed.groupBy(F.col("u").alias("d")).agg(F.count("*").alias("deg")))
    # a neighbour comes with its own degree, so a step is one join
    links = cut(placed.join(degree, F.col("v") == F.col("d")).select("u", "place", "v", F.col("deg").alias("next_deg")))
    now = starts.join(degree, F.col("no") == F.col("d")).select("no", "node", "walk", "deg", F.col("no").alias("u"), F.array("no").alias("nodes"))
    for step in range(1, length + 1):
        at = now.withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "node", "walk", F.lit(step)), F.col("deg")).cast("int"))
        now = cut(at.join(links, ["u", "place"]).select("no", "node", "walk", F.col("next_deg").alias("deg"), F.col("v").alias("u"), F.concat("nodes", F.array("v")).alias("nodes")))
    return now.select("no", "walk", "nodes")


def _hash_step(step: int, h: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 with the whole number ``step`` after what gave ``h``."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (h.view(np.uint64) + p5 + np.uint64(4)) ^ (np.array([step], np.uint64) * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _held_walks(starts: DataFrame, placed: DataFrame, length: int, seed: int) -> DataFrame:
    links = placed.toArrow()
    u, place, v = (links[c].to_numpy() for c in ("u", "place", "v"))
    first = np.concatenate([[0], np.cumsum(np.bincount(u))]).astype(np.int64)
    after = np.empty(len(v), np.int32)
    after[first[u] + place] = v
    del links, u, place, v
    sent = starts.sparkSession.sparkContext.broadcast((first, after))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, after = sent.value
        for batch in batches:
            no, walk, h = batch.columns
            h, x = h.to_numpy(), np.empty((batch.num_rows, length + 1), np.int32)
            x[:, 0] = no.to_numpy()
            for step in range(1, length + 1):
                at = first[x[:, step - 1]]
                x[:, step] = after[at + np.mod(_hash_step(step, h), first[x[:, step - 1] + 1] - at)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (length + 1)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([no, walk, lists], names=["no", "walk", "nodes"])

    rows = starts.select("no", "walk", F.xxhash64(F.lit(seed), "node", "walk").alias("h"))
    out = cut(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "no int, walk int, nodes array<int>"))
    sent.destroy()
    return out


def _add_rows(w: np.ndarray, at: np.ndarray, y: np.ndarray, longest: float = _LONGEST) -> None:
    """w[at] += y, where rows may come again: equal ones are added in pairs until each is there once, and then
    is shortened to ``longest``. Writes over ``y``."""
    at_y = np.argsort(at, kind="stable")
    at = at[at_y]
    while True:
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        if len(first) == len(at):
            break
        second = (np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))) % 2 == 1
        b = np.flatnonzero(second)
        y[at_y[b - 1]] += y[at_y[b]]
        at, at_y = at[~second], at_y[~second]
    y = y[at_y]
    w[at] += y * np.minimum(1, longest / (np.sqrt(np.einsum("ij,ij->i", y, y))[:, None] + 1e-12))


def _step(w: np.ndarray, x: np.ndarray, near: np.ndarray, noise: np.ndarray, rate: float, negatives: int) -> None:
    """One step of skip-gram over the walks ``x``: every node draws nearer to those that ``near`` marks in its
    walk, and away from its walk's ``noise``, which weighs as much as ``negatives`` drawn nodes for each of
    them. ``w`` has a node's vector, then the one that it has as a neighbour."""
    size = w.shape[1] // 2
    both = w[x]
    i, o, z = np.ascontiguousarray(both[..., :size]), np.ascontiguousarray(both[..., size:]), w[noise, size:]
    p = near * (np.float32(rate) / (1 + np.exp(i @ o.transpose(0, 2, 1))))
    q = (near.sum(2)[..., None] * np.float32(-rate * negatives / noise.shape[1])) / (1 + np.exp(-(i @ z.transpose(0, 2, 1))))
    both[..., :size] = p @ o
    both[..., :size] += q @ z
    both[..., size:] = p.transpose(0, 2, 1) @ i
    pushed = q.transpose(0, 2, 1) @ i
    _add_rows(w, x.ravel(), both.reshape(-1, 2 * size))
    _add_rows(w[:, size:], noise.ravel(), pushed.reshape(-1, size))


def _trainer(sent, cdf, at_once: int, window: int, negatives: int, seed: int, epoch: int, epochs: int, share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trains a copy of the vectors on a task's walks and hands on how it differs, in blocks of 256 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
        start, sums = sent.value, cdf.value
        w, seen, done = start.copy(), np.zeros(len(start), bool), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            places = np.arange(x.shape[1])
            far = np.abs(places[:, None] - places)
            marks = np.stack([(far > 0) & (far <= r) for r in range(window + 1)]).astype(np.float32)
            reach = rng.integers(1, window, x.shape, endpoint=True)
            noise = np.searchsorted(sums, rng.random((len(x), _NOISE)) * sums[-1], side="right")
            for lo in range(0, len(x), at_once):
                rate = 0.025 * max(1e-4, 1 - (epoch + min(1.0, (done + lo) / share)) / epochs)
                part = slice(lo, lo + at_once)
                _step(w, x[part], marks[reach[part], places], noise[part], rate, negatives)
            done += len(x)
            seen[x] = True
            seen[noise] = True
        for block in np.unique(np.flatnonzero(seen) >> 8):
            part = slice(block << 8, (block + 1) << 8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([(w[part] - start[part]).tobytes()], pa.binary()), pa.array([seen[part].astype(np.int32).tobytes()], pa.binary())], names=["block", "y", "n"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, y, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            y, n = np.frombuffer(y, np.float32), np.frombuffer(n, np.int32)
            found[block] = [found[block][0] + y, found[block][1] + n] if block in found else [y, n]
    for block, (y, n) in found.items():
        mean = y.reshape(len(n), -1) / np.maximum(n, 1).astype(np.float32)[:, None]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([mean.tobytes()], pa.binary())], names=["block", "y"])


def node_vectors(nodes: DataFrame, lists: DataFrame, size: int = 64, window: int = 5, epochs: int = 5, negatives: int = 5, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``word, vector`` by skip-gram with ``negatives`` drawn nodes a pair (by their frequency to the power
    3/4), over walks of one length. ``partitions``, by default one for 50,000 walks but no more than run at
    once, are trained side by side in each epoch, and what they change in a node is averaged. The driver and
    every task hold 2 x ``size`` floats a node."""
    spark = nodes.sparkSession
    n, total = nodes.count(), lists.count()
    if not n:
        return nodes.select(F.col("node").alias("word"), F.array().cast("array<double>").alias("vector"))
    if partitions is None:
        partitions = max(1, min(total // 50_000, spark.sparkContext.defaultParallelism))
    often = lists.select(F.explode("nodes").alias("no")).groupBy("no").agg(F.count("*").alias("n")).toArrow()
    weight = np.zeros(n)
    weight[often["no"].to_numpy()] = often["n"].to_numpy() ** 0.75
    at_once = int(max(1, min(_AT_ONCE, _TIMES * total / often["n"].to_numpy().max())))
    cdf = spark.sparkContext.broadcast(np.cumsum(weight))
    mixed = cut(lists.repartition(partitions, F.xxhash64(F.lit(seed), "no", "walk")).sortWithinPartitions(F.xxhash64(F.lit(seed + 1), "no", "walk")).select("nodes"))
    w = np.zeros((n, 2 * size), np.float32)
    w[:, :size] = (np.random.default_rng(seed).random((n, size), np.float32) - 0.5) / size
    for epoch in range(epochs):
        sent = spark.sparkContext.broadcast(w)
        run = _trainer(sent, cdf, at_once, window, negatives, seed, epoch, epochs, total / partitions)
        changed = mixed.mapInArrow(run, "block long, y binary, n binary").repartition("block").mapInArrow(_add_up, "block long, y binary")
        got = changed.toArrow()
        for block, y in zip(got["block"].to_pylist(), got["y"], strict=True):
            w[block << 8 : (block + 1) << 8] += np.frombuffer(y.as_buffer(), np.float32).reshape(-1, 2 * size)
        sent.destroy()
        del changed, got
        spark.sparkContext._jvm.System.gc()  # the epoch's shuffle, as large as the vectors of all partitions, is let go
    cdf.destroy()
    vectors = spark.createDataFrame(pa.table({"no": pa.array(range(n), pa.int32()), "vector": pa.FixedSizeListArray.from_arrays(pa.array(w[:, :size].ravel()), size).cast(pa.list_(pa.float32()))}))
    return nodes.join(vectors, "no").select(F.col("node").alias("word"), F.col("vector").cast("array<double>").alias("vector"))
