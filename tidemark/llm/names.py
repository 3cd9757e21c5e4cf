"""Free-typed values mapped to the entries of a reference list.

Every spelling of an entry (its names, their words in the other order, the keys that write a Hangul
name) is a path of a trie. A typed value is searched with a Levenshtein automaton: the set of states
after a path is its row of edit costs against the value, a path is left once no state is within the
allowed distance, and that distance depends on the length. All entries within it are found; the
closest is the result.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import cut

#: The keys of the Korean two-set layout, in the order of the Unicode jamo blocks.
INITIALS = "r R s e E f a q Q t T d w W c z x v g".split()
MEDIALS = "k o i O j p u P h hk ho hl y n nj np nl b m ml l".split()
FINALS = " r R rt s sw sg e f fr fa fq ft fx fv fg a q qt t T d w c z x v g".split(" ")

#: Words written around a name in shops: counters, floors, halls, sales. A parameter of the search.
AROUND = ("코너", "매장", "본관", "신관", "별관", "행사", "행", "구", "신", "외", "外", "층", "점", "특설")
FLOOR = re.compile(r"^(지하)?\d+층?$|^[bf]?\d+f?$")
ATTACHED = ("코너", "매장")


def keys_of(text: str) -> str:
    """The keys that write ``text`` on the Korean layout, without shift; other letters stay."""
    out = []
    for ch in text:
        i = ord(ch) - 0xAC00
        if 0 <= i < 11172:
            out += [INITIALS[i // 588], MEDIALS[i // 28 % 21], FINALS[i % 28]]
        else:
            out.append(ch)
    return "".join(out).lower()


def tokens_of(text: str) -> list[str]:
    """Letters and digits of ``text`` between other signs, in one width, composition and case."""
    text = unicodedata.normalize("NFKC", text)
    text = "".join(c for c in text if unicodedata.category(c) != "Cf").casefold()
    return re.findall(r"[^\W_]+", text)


def is_hangul(ch: str) -> bool:
    return "가" <= ch <= "힣"


def swap_cost(a: str, b: str) -> float:
    """Cost of ``b`` for ``a``: 1, for Hangul by the number of differing letters in the syllable."""
    if a == b:
        return 0.0
    if is_hangul(a) and is_hangul(b):
        i, j = ord(a) - 0xAC00, ord(b) - 0xAC00
        n = (i // 588 != j // 588) + (i // 28 % 21 != j // 28 % 21) + (i % 28 != j % 28)
        return (0.0, 0.7, 1.2, 1.7)[n]
    return 1.0


def allowed(length: int, hangul: bool) -> float:
    """The greatest distance for a path of this length."""
    if hangul:
        return 0.0 if length < 2 else 0.7 if length == 2 else 1.4 if length == 3 else 2.0 if length < 6 else 2.5
    return 0.0 if length < 4 else 1.0 if length < 8 else 2.0


@dataclass(slots=True)
class Node:
    """A state of the trie: the entries whose path ends here, and the greatest distance allowed for any
    path through it."""

    children: dict
    refs: frozenset = frozenset()
    most: float = 0.0


class NameTrie:
    """``entries``: pairs of an id and its spellings."""

    def __init__(self, entries: Iterable[tuple[int, Iterable[str]]]):
        self.hangul, self.letters = Node({}), Node({})
        self.exact: dict[str, frozenset] = {}
        self.longest = 0
        for ref, names in entries:
            for name in names:
                words = tokens_of(name or "")
                if words:
                    for path in {"".join(words), "".join(reversed(words))}:
                        self._add(path, ref)
                        if any(map(is_hangul, path)):
                            self._add(keys_of(path), ref)

    def _add(self, path: str, ref: int) -> None:
        self.exact[path] = self.exact.get(path, frozenset()) | {ref}
        self.longest = max(self.longest, len(path))
        hangul = any(map(is_hangul, path))
        node, most = (self.hangul if hangul else self.letters), allowed(len(path), hangul)
        node.most = max(node.most, most)
        for ch in path:
            node = node.children.setdefault(ch, Node({}))
            node.most = max(node.most, most)
        node.refs |= {ref}

    def within(self, typed: str) -> dict[int, float]:
        """Every entry within the distance allowed for its path, with its least cost."""
        found: dict[int, float] = {}
        n = len(typed)
        hangul = any(map(is_hangul, typed))
        if n > self.longest + 6:  # longer than any path and the greatest distance
            return found
        root = self.hangul if hangul else self.letters
        first = [0.0] * (n + 1)
        for j in range(1, n + 1):
            first[j] = first[j - 1] + (0.7 if j > 1 and typed[j - 1] == typed[j - 2] else 1.0)
        stack = [(child, ch, first, None, "", 1) for ch, child in root.children.items()]
        while stack:
            node, ch, above, above2, before, depth = stack.pop()
            row = [above[0] + 1.0]
            low = row[0]
            for j in range(1, n + 1):
                t = typed[j - 1]
                v = above[j - 1] + swap_cost(ch, t)
                if above[j] + 1.0 < v:
                    v = above[j] + 1.0
                # a sign typed twice is a smaller slip than a strange one
                w = row[j - 1] + (0.7 if t == ch or (j > 1 and t == typed[j - 2]) else 1.0)
                if w < v:
                    v = w
                if above2 is not None and j > 1 and t == before and typed[j - 2] == ch and above2[j - 2] + 0.8 < v:
                    v = above2[j - 2] + 0.8
                row.append(v)
                if v < low:
                    low = v
            if low > node.most:
                # a swap of two signs may still come down from the row above
                if above2 is None or min(above) > node.most:
                    continue
            if node.refs and row[n] <= allowed(depth, hangul):
                for ref in node.refs:
                    found[ref] = min(found.get(ref, 9.0), row[n])
            for nxt, child in node.children.items():
                stack.append((child, nxt, row, above, ch, depth + 1))
        return found

    def inside(self, text: str, hangul: int = 4, letters: int = 8) -> tuple[dict[int, float], int]:
        """The entries whose longest path stands whole in ``text``, at 0.5, and that path's length; paths of
        fewer signs than ``hangul`` or ``letters`` may be parts of other words and don't count."""
        found, most = {}, 0
        for i in range(len(text)):
            for root, least in ((self.hangul, hangul), (self.letters, letters)):
                node, j = root, i
                while j < len(text) and (node := node.children.get(text[j])):
                    j += 1
                    if node.refs and j - i >= max(least, most):
                        found = dict.fromkeys(node.refs, 0.5) | (found if j - i == most else {})
                        most = j - i
        return found, most

    def reach(self, typed: str, around: tuple[str, ...] = AROUND) -> tuple[dict[int, float], int]:
        """All entries within reach of ``typed`` with their distances, and 0; where there are none, those
        that stand whole inside of it, with the length of their path. The words around a name may be left
        off: those in ``around`` and floors at no cost that counts, others at 0.4 each. Each run of words
        is searched, and an entry has the least distance over all runs."""
        words = tokens_of(typed)
        costs = [0.01 if w in around or FLOOR.match(w) else 0.4 for w in words]
        total = sum(costs)
        spans: dict[str, float] = {}
        for i in range(len(words)):
            text, inside = "", 0.0
            for j in range(i, len(words)):
                text += words[j]
                inside += costs[j]
                if len(text) > self.longest + 6:
                    break
                spans[text] = min(spans.get(text, 99.0), total - inside)
                for end in ATTACHED:
                    if text.endswith(end) and len(text) > len(end) + 1:
                        bare = text[: -len(end)]
                        spans[bare] = min(spans.get(bare, 99.0), total - inside + 0.01)
        found: dict[int, float] = {}
        for text, left in spans.items():
            for ref, cost in self.within(text).items():
                found[ref] = min(found.get(ref, 99.0), cost + left)
        return (found, 0) if found else self.inside("".join(words))

    def best(self, typed: str, around: tuple[str, ...] = AROUND) -> tuple[int, float, int] | None:
        """The id of the closest entry, its distance and the number of entries as close; None if no
        entry is within reach."""
        found, _ = self.reach(typed, around)
        if not found:
            return None
        low = min(found.values())
        same = sorted(r for r, c in found.items() if c <= low + 1e-9)
        return same[0], low, len(same)


#: Built tries by the search's number: a worker that runs many tasks builds each once.
_BUILT: dict[str, dict[str, NameTrie]] = {}


def _search(tag: str, entries: Broadcast, around: tuple[str, ...]):
    """The search over batches of (field, value), as a function that workers can hold: a row for each
    entry in reach, and one without an entry for a value that has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tag not in _BUILT:
            _BUILT.clear()
            _BUILT[tag] = {f: NameTrie(e) for f, e in entries.value.items()}
        tries = _BUILT[tag]
        for pdf in batches:
            rows = []
            for field, value in zip(pdf["field"], pdf["value"], strict=True):
                hits, inner = tries[field].reach(value, around)
                rows += [(field, value, ref, cost, inner) for ref, cost in hits.items()] or [(field, value, -1, None, 0)]
            yield pd.DataFrame(rows, columns=["field", "value", "ref_id", "distance", "inner"]).astype({"ref_id": "int64", "distance": "float64", "inner": "int32"})

    return run


@dataclass(frozen=True)
class Reference:
    """A reference list: its table, id column and spelling columns. Values that equal ``own`` (the first
    spelling column) letter for letter are entries, not typed values, and are not searched."""

    table: DataFrame
    ref_id: str
    names: tuple[str, ...]


def in_reach(df: DataFrame, fields: dict[str, Reference], around: tuple[str, ...] = AROUND, block: int = 5_000) -> DataFrame:
    """Every entry within the length-dependent distance of each distinct typed value: ``field, value,
    ref_id, distance``, closest first by ``distance``; a value that none is near to has one row, -1.

    Each spelling is searched once, however many rows have it; the distinct values are gathered with a
    partial aggregate before the shuffle, so a hot value costs nothing. The list is searched in blocks of
    ``block`` entries: one block at a time is gathered, sent to the workers and searched, and all blocks'
    hits count alike, so the size of a block changes nothing. Entries that stand whole inside a value count
    only where no block has an entry in reach, and of them those with the longest path.

    Defined cases: null and blank values and values that are an entry's first name letter for letter
    give no row. A value of signs only names nothing (-1). Repeated entries are one entry, with all their
    names; null names are skipped. An empty list maps every value to -1.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    values = df.select(pairs.alias("x")).select("x.*").where("value is not null and trim(value) <> ''").distinct()
    for f, ref in fields.items():
        own = ref.table.where(F.col(ref.ref_id).isNotNull()).select(F.col(ref.names[0]).alias("__o"), F.lit(f).alias("__f")).where("__o is not null").distinct()
        values = values.join(own, (F.col("field") == F.col("__f")) & (F.col("value") == F.col("__o")), "left_anti")
    # a search is dear and its row is small: without a number of its own it would be put into one task
    values = cut(values.repartition(df.sparkSession.sparkContext.defaultParallelism, "value"))
    lists, blocks = {}, 1
    for f, ref in fields.items():
        one = ref.table.where(F.col(ref.ref_id).isNotNull()).select(F.col(ref.ref_id).cast("long").alias("id"), F.array(*ref.names).alias("names")).distinct()
        n = one.count()
        lists[f] = one.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(-(-n // block) or 1)))
        blocks = max(blocks, -(-n // block))
    hits = None
    for b in range(blocks):
        entries = {f: [(r["id"], [x for x in r["names"] if x]) for r in one.where(F.col("b") == b).collect()] for f, one in lists.items()}
        sent = df.sparkSession.sparkContext.broadcast(entries)
        part = values.mapInPandas(_search(uuid.uuid4().hex, sent, around), "field string, value string, ref_id long, distance double, inner int")
        part = cut(part) if blocks > 1 else part
        hits = part if hits is None else hits.unionByName(part)
    if blocks > 1:
        w = W.partitionBy("field", "value")
        some, near, inner = F.max("ref_id").over(w), F.max((F.col("inner") == 0) & (F.col("ref_id") >= 0)).over(w), F.max("inner").over(w)
        hits = hits.withColumns({"__s": some, "__n": near, "__i": inner}).where("__s = -1 or ref_id >= 0 and inner = if(__n, 0, __i)")
    return cut(hits.groupBy("field", "value", "ref_id").agg(F.min("distance").alias("distance")))


def spellings(df: DataFrame, fields: dict[str, Reference], around: tuple[str, ...] = AROUND, block: int = 5_000) -> DataFrame:
    """A row for each distinct typed value of each field of ``fields``: ``field, value, ref_id, distance,
    n_as_close, n_in_reach``, the closest of the entries of ``in_reach``; ``ref_id`` is -1 where there is
    none. Of entries as close as each other the one with the smallest id is given, and ``n_as_close`` tells
    how many there are; ``n_in_reach`` counts all."""
    hits = in_reach(df, fields, around, block)
    near = F.array_sort(F.collect_list(F.struct(F.round("distance", 6).alias("distance"), "ref_id")))
    best = hits.groupBy("field", "value").agg(near.alias("near"))
    first = F.element_at("near", 1)
    same = F.size(F.filter("near", lambda x: x["distance"] <= first["distance"]))
    return best.select("field", "value", first["ref_id"].alias("ref_id"), first["distance"].alias("distance"), same.alias("n_as_close"), F.when(first["ref_id"] >= 0, F.size("near")).otherwise(0).alias("n_in_reach"))


def mapped(field: str) -> Column:
    return F.col(f"ref_{field}")


def map_names(df: DataFrame, fields: dict[str, Reference], found: DataFrame) -> DataFrame:
    """``df`` with ``ref_<field>`` from ``found`` (see ``spellings``): null where the value is null,
    blank or an entry itself. The table of spellings is broadcast only when small."""
    from tidemark.session import if_small

    for f in fields:
        side = found.where(F.col("field") == f).select(F.col("value").alias(f"__v_{f}"), F.col("ref_id").alias(f"ref_{f}"))
        df = df.join(if_small(side), F.col(f) == F.col(f"__v_{f}"), "left").drop(f"__v_{f}")
    return df
