"""Sparse Gram matrices: how often two columns of a binary matrix are set in the same row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of products held by a task before they are summed and handed on.
HELD = 2_000_000

#: Items of a block: the triangle of one block has at most 8 million entries.
BLOCK = 4096


def _products(levels: list[str], size: dict[str, int]):
    """Sums X'X over record blocks. Each Arrow batch is a record block: its list column is the binary
    sparse matrix X, rows by columns, as offsets and column numbers. The upper triangle of X'X, diagonal
    included, comes out as (level, a, b, n); the number of filled rows as (level, -1, -1, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {x: [] for x in levels}
        counts: dict[str, list[np.ndarray]] = {x: [] for x in levels}
        filled = dict.fromkeys(levels, 0)

        def add_up(x: str) -> None:
            if held[x]:
                key, n = np.concatenate(held[x]), np.concatenate(counts[x])
                key, at = np.unique(key, return_inverse=True)
                held[x], counts[x] = [key], [np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)]

        def rows(x: str, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([levels.index(x)] * len(a), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["level", "a", "b", "n"])

        def given(x: str) -> Iterator[pa.RecordBatch]:
            add_up(x)
            if held[x]:
                key, n = held[x][0], counts[x][0]
                held[x], counts[x] = [], []
                yield rows(x, key // size[x], key % size[x], n)

        for batch in batches:
            for x in levels:
                col = batch.column(batch.schema.get_field_index(x))
                filled[x] += int(np.asarray(batch.column(batch.schema.get_field_index(f"any_{x}"))).sum())
                items, lengths = np.asarray(col.flatten()).astype(np.int64), np.diff(np.asarray(col.offsets))
                if not len(items):
                    continue
                items = items[np.lexsort((items, np.repeat(np.arange(len(lengths)), lengths)))]
                left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(items)) - 1
                at, step = np.arange(len(items)), 0
                total = sum(map(len, held[x]))
                while len(at):
                    key, n = np.unique(items[at] * size[x] + items[at + step], return_counts=True)
                    held[x].append(key)
                    counts[x].append(n)
                    total += len(key)
                    if total > HELD:
                        add_up(x)
                        total = len(held[x][0])
                        if total > HELD // 2:
                            yield from given(x)
                            total = 0
                    step += 1
                    at = at[left[at] >= step]
        for x in levels:
            yield from given(x)
            yield rows(x, np.array([-1]), np.array([-1]), np.array([filled[x]]))

    return run


def _block_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products between two item blocks: rows come sorted by (level, block a, block b), with a
    record's numbers in either block. Held are only the sums of the block pair at hand."""
    at: tuple | None = None
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def given() -> Iterator[pa.RecordBatch]:
        if keys:
            key, n = _added(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), at[0]), pa.int32()), pa.array(key >> 32, pa.int64()), pa.array(key & 0xFFFFFFFF, pa.int64()), pa.array(n, pa.int64())], names=["level", "a", "b", "n"])

    for batch in batches:
        level, ba, bb = (np.asarray(batch.column(k)) for k in range(3))
        if not len(level):
            continue
        first = np.concatenate([[0], np.nonzero((np.diff(level) != 0) | (np.diff(ba) != 0) | (np.diff(bb) != 0))[0] + 1, [len(level)]])
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            now = (int(level[lo]), int(ba[lo]), int(bb[lo]))
            if now != at:
                yield from given()
                at, keys, counts = now, [], []
            left, right = batch.column(3).slice(lo, hi - lo), batch.column(4).slice(lo, hi - lo)
            x, nx = np.asarray(left.flatten()).astype(np.int64), np.diff(np.asarray(left.offsets))
            y, ny = np.asarray(right.flatten()).astype(np.int64), np.diff(np.asarray(right.offsets))
            # every number on the left meets all on the right of its record
            each = np.repeat(ny, nx)
            start = np.repeat(np.cumsum(ny) - ny, nx)
            to = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start, each)
            a, b = np.repeat(x, each), y[to]
            keep = a <= b
            key, n = np.unique((a[keep] << 32) | b[keep], return_counts=True)
            keys.append(key)
            counts.append(n)
            if sum(map(len, keys)) > HELD:
                key, n = _added(keys, counts)
                keys, counts = [key], [n]
    yield from given()


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


def _by_blocks(rows: DataFrame, level: int, name: str, block: int, salts: int) -> DataFrame:
    """The upper triangle of X'X by pairs of item blocks: a record goes once to every pair of blocks that
    it has numbers in, and record blocks (salts) part a pair of blocks that many records fill."""
    number = F.array_sort(F.array_distinct(F.transform(name, lambda i: F.floor(i / F.lit(block)).cast("int"))))
    own = rows.select(F.col(name).alias("x"), number.alias("bs")).where(F.size("x") > 0)
    ab = F.flatten(F.transform("bs", lambda p: F.transform(F.filter("bs", lambda q: q >= p), lambda q: F.struct(p.alias("ba"), q.alias("bb")))))
    one = own.select("x", F.explode(ab).alias("p")).select(F.lit(level).alias("level"), "p.ba", "p.bb", "x")
    inside = lambda c: F.filter("x", lambda i: F.floor(i / F.lit(block)) == F.col(c))
    one = one.select("level", "ba", "bb", inside("ba").alias("l"), inside("bb").alias("r"), F.pmod(F.xxhash64("x"), F.lit(salts)).alias("salt"))
    spread = one.repartition("level", "ba", "bb", "salt").sortWithinPartitions("level", "ba", "bb").drop("salt")
    return spread.mapInArrow(_block_products, "level int, a long, b long, n long")


def gram_sums(rows: DataFrame, size: dict[str, int], block: int = BLOCK, salts: int = 32) -> DataFrame:
    """``level, a, b, n`` with a <= b: for each array column of ``rows`` named in ``size`` (distinct numbers
    below the size), in how many rows both numbers stand; level is the column's place. The row (-1, -1)
    counts the rows whose boolean column ``any_<column>`` is true.

    Items form blocks of ``block`` numbers. A column of one block is summed where its records lie: tasks hand
    on sums of their record blocks, which are then added up by (level, a, b). A column of several blocks is
    shuffled by pairs of item blocks first, so that a task holds one block of the matrix, however many
    items there are, and a pair's count is nearly whole before it is handed on.
    """
    levels = list(size)
    large = [x for x in levels if size[x] > block]
    held = {x: size[x] for x in levels if x not in large}
    shape = "level int, a long, b long, n long"
    columns = [F.col(x) if x in held else F.expr("cast(array() as array<int>)").alias(x) for x in levels]
    parts = rows.select(*columns, *[F.col(f"any_{x}") for x in levels]).mapInArrow(_products(levels, size), shape)
    for x in large:
        parts = parts.unionByName(_by_blocks(rows, levels.index(x), x, block, salts))
    return parts.groupBy("level", "a", "b").agg(F.sum("n").alias("n"))
