"""Texts packed into containers of a fixed number of tokens."""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rank import spread_rank
from tidemark.session import cut

#: A rank file of a public byte-level vocabulary, and the pattern that splits text before its merges.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict = {}


def encoding(ranks: str, pattern: str = PATTERN):
    """The tokenizer of a rank file, loaded once in a worker."""
    if (ranks, pattern) not in _LOADED:
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[ranks, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _LOADED[ranks, pattern]


def token_counts(df: DataFrame, key: str, text: str, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``key, n_tokens`` of every row, whole texts; null and empty texts have 0. The rank file, a few MB at
    ``ranks`` where the driver runs, is handed to the executors by the session."""
    df.sparkSession.sparkContext.addFile(ranks)
    name = ranks.rsplit("/", 1)[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoding(SparkFiles.get(name), pattern)
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "n_tokens": [len(own.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf["t"]]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, n_tokens long").withColumnRenamed("k", key)


def plan_slots(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit over counts, longest first: each item goes to the container with the least room that
    holds it, as if the items were placed one by one, but equal containers are handled together.

    Gives slots (length, first rank, first container, items a container, first offset), by length and
    rank, and the number of containers. An item of rank k stands in container ``first + j // items`` at
    ``offset + j % items * length``, where j is k less the first rank."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: ranges of containers
    slots, containers = [], 0
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        if length > capacity:
            raise ValueError("an item is longer than a container")
        left, rank = histogram[length], 0

        def fill(first: int, count: int, space: int, length: int = length) -> None:
            """Takes as many of ``count`` containers as are needed, and keeps the others as they are."""
            nonlocal left, rank
            each = space // length
            whole = min(count, left // each)
            if whole:
                slots.append((length, rank, first, each, capacity - space))
                room[space - each * length].append((first, whole))
                rank, left = rank + whole * each, left - whole * each
            rest = count - whole
            if rest and left and left < each:
                slots.append((length, rank, first + whole, left, capacity - space))
                room[space - left * length].append((first + whole, 1))
                rank, whole, rest, left = rank + left, whole + 1, rest - 1, 0
            if rest:
                room[space].append((first + whole, rest))

        for space in sorted(s for s in room if s >= length):
            if not left:
                break
            for first, count in room.pop(space):
                if left:
                    fill(first, count, space)
                else:
                    room[space].append((first, count))
        if left:
            new = -(-left // (capacity // length))
            fill(containers, new, capacity)
            containers += new
        room.pop(0, None)
    return slots, containers


def pack(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``key, piece, n_tokens, text_start, container, container_start`` of every piece: a text no longer
    than ``capacity`` is one piece, a longer one is split into pieces of ``capacity`` and a rest.

    Method: the histogram of lengths, at most ``capacity`` numbers, is planned on the driver by best fit
    over counts (``plan_slots``); the pieces of a length are then numbered without a gap, which spreads a
    length that many texts share over many tasks, and each takes the slot of its rank. The plan's size
    depends on the capacity and not on the number of texts.

    Defined cases: null and zero sizes take no room: piece 0 with container -1. Equal rows are packed
    each; keys need not be unique, but equal (key, size) rows then get their slots in no stated order.
    An empty table gives no rows.
    """
    rows = sizes.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("long") * capacity
    pieces = cut(pieces.select("k", "piece", start.alias("text_start"), F.least(F.col("n") - start, F.lit(capacity)).cast("int").alias("len")))
    histogram = {r["len"]: r["count"] for r in pieces.where("len > 0").groupBy("len").count().collect()}
    slots, _ = plan_slots(histogram, capacity)
    plan = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
    at = plan[:, 0] * (1 << 40) + plan[:, 1]

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["len"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            row = plan[np.searchsorted(at, length * (1 << 40) + rank, side="right") - 1]
            j = rank - row[:, 1]
            yield pd.DataFrame(
                {"k": pdf["k"], "piece": pdf["piece"], "n_tokens": length, "text_start": pdf["text_start"], "container": row[:, 2] + j // row[:, 3], "container_start": row[:, 4] + j % row[:, 3] * length}
            )

    kind = sizes.schema[key].dataType.simpleString()
    shape = f"k {kind}, piece int, n_tokens long, text_start long, container long, container_start long"
    none = pieces.where("len <= 0").select("k", "piece", F.lit(0).cast("long").alias("n_tokens"), "text_start", F.lit(-1).cast("long").alias("container"), F.lit(0).cast("long").alias("container_start"))
    if not slots:
        return none.withColumnRenamed("k", key)
    placed = spread_rank(pieces.where("len > 0"), ["len"], ["k", "piece"]).mapInPandas(take, shape)
    return placed.unionByName(none).withColumnRenamed("k", key)
