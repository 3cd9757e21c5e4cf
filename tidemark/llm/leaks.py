"""Test items found in training texts: winnowed fingerprints, joined and extended."""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

#: A fingerprint covers GRAM signs; of every WINDOW following ones the least is kept, so that every
#: shared span of GRAM + WINDOW - 1 signs has one in common.
GRAM, WINDOW = 10, 5

TAG = re.compile(r"<[a-z/!][^<>]*>")
ENTITY = re.compile(r"&(?:[a-z]{2,8}|#x?[0-9a-f]{1,6});")
NO_SIGN = re.compile(r"[\W_]+")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def plain(text: str) -> str:
    """One width, composition and letter case; without markup."""
    text = unicodedata.normalize("NFKC", text).casefold()
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = ENTITY.sub(" ", text)
    return text


def signs(text: str) -> str:
    """The letters and digits of ``text``; spacing, punctuation and line breaks don't count."""
    return NO_SIGN.sub("", plain(text))


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash) of the fingerprints of ``texts``, which are signs already."""
    lengths = np.array([len(t) + GRAM for t in texts], dtype=np.int64)  # each after signs that no text has
    whole = "".join("\0" * GRAM + t for t in texts) + "\0" * GRAM
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes) - GRAM + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(GRAM):
        h *= np.uint64(0x100000001B3)
        h += codes[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    empty = np.concatenate([[0], np.cumsum(codes == 0)])
    h[empty[GRAM : GRAM + n] > empty[:n]] = _NONE
    low = h.copy()
    for j in range(1, WINDOW):
        np.minimum(low[:-j], h[j:], out=low[:-j])
    top = low.copy()
    for j in range(1, WINDOW):
        np.maximum(top[j:], low[:-j], out=top[j:])
    at = np.nonzero((top == h) & (h != _NONE))[0]
    ends = np.cumsum(lengths)
    which = np.searchsorted(ends, at, side="right")
    return which, at - (ends - lengths)[which] - GRAM, h[at]


@dataclass
class Item:
    """A test item: its signs, and where each word begins (the end last)."""

    text: str
    starts: list[int]

    @staticmethod
    def of(text: str) -> Item:
        words = [w for w in (NO_SIGN.sub("", x) for x in plain(text).split()) if w]
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w))
        return Item("".join(words), starts)

    def __len__(self) -> int:
        return len(self.starts) - 1


def _same(a: str, i: int, b: str, j: int) -> int:
    """How many signs from ``a[i]`` and ``b[j]`` on are equal."""
    n, step = 0, 32
    while True:
        x, y = a[i + n : i + n + step], b[j + n : j + n + step]
        if x == y and len(x) == step:
            n += step
            continue
        m = min(len(x), len(y))
        for k in range(m):
            if x[k] != y[k]:
                return n + k
        return n + m


def _run(doc: str, d: int, item: str, i: int, starts: list[int], word: int) -> list[tuple[int, int]]:
    """Spans of ``item`` found in ``doc`` in order from ``doc[d]`` and ``item[i]`` on, where words between
    them may be replaced. ``word`` is the number of the word at ``i``."""
    spans = []
    while True:
        n = _same(doc, d, item, i)
        if n:
            spans.append((i, i + n))
        d, i = d + n, i + n
        last = len(starts) - 1
        while word < last and starts[word + 1] <= i:
            word += 1
        if word >= last or d >= len(doc):
            return spans
        found = None
        # the next word that goes on: this one, if a word was put in, or one of the four after it
        for k in range(word, min(word + 5, last)):
            s = starts[k]
            if s < i:
                continue
            room = 26 * (k - word) + 26
            for probe in (item[s : s + 9], item[s : starts[k + 1]]):
                if len(probe) < 3:
                    continue
                at = doc.find(probe, max(0, d - 8), d + room)
                if at >= 0 and (len(probe) >= 6 or at <= d + 16):
                    found = (at, s, k)
                    break
            if found:
                break
        if not found:
            return spans
        d, i, word = found


def stretch(doc: str, item: Item, hits: list[tuple[int, int]], back: Item, least: float = 0) -> int:
    """The most words of ``item`` that one connected stretch of ``doc`` carries in order, of which at most
    one in eight is replaced. ``hits`` are places (doc, item) of common fingerprints; ``back`` is the item
    backwards. Stretches of under ``least`` words need not be measured."""
    best, n = 0, len(item)
    done: list[tuple[int, int, int]] = []
    rev = None
    for d, i in hits:
        if any(a <= i < b and abs((d - i) - off) <= 60 for a, b, off in done):
            continue
        if doc[d : d + GRAM] != item.text[i : i + GRAM]:
            continue
        word = bisect_right(item.starts, i) - 1
        spans = _run(doc, d, item.text, i, item.starts, word)
        if rev is None:
            rev = doc[::-1]
        ri = len(item.text) - i - GRAM
        rword = bisect_right(back.starts, ri) - 1
        spans += [(len(item.text) - b, len(item.text) - a) for a, b in _run(rev, len(doc) - d - GRAM, back.text, ri, back.starts, rword)]
        lo, hi = min(a for a, _ in spans), max(b for _, b in spans)
        done.append((lo, hi, d - i))
        if bisect_right(item.starts, hi) - bisect_right(item.starts, lo) + 1 < least:
            continue
        have = np.zeros(len(item.text) + 1, dtype=np.int32)
        for a, b in spans:
            have[a] += 1
            have[b] -= 1
        got = np.concatenate([[0], np.cumsum(np.cumsum(have[:-1]) > 0)])
        s = np.array(item.starts)
        whole = got[s[1:]] - got[s[:-1]] == s[1:] - s[:-1]
        # the longest window of words with at most one missing in eight: 7 * missing <= found
        step = np.concatenate([[0], np.cumsum(np.where(whole, 1, -7))])
        low = np.minimum.accumulate(step)  # falls; the first place at or below step[j] starts the window to j
        start = np.searchsorted(-low, -step, side="left")
        wide = np.arange(n + 1) - start
        for j in np.argsort(-wide, kind="stable"):
            if wide[j] <= best:
                break
            # a window begins and ends with a word that is there
            x, y = int(start[j]), int(j)
            while x < y and not whole[x]:
                x += 1
            while y > x and not whole[y - 1]:
                y -= 1
            best = max(best, y - x)
    return best


#: Widths for the first look at hits: diagonals in bands of BAND signs; a stretch worth extending spans
#: SPAN of the item's signs within two neighbouring bands.
BAND, SPAN = 64, 0.12


def _worth(doc: np.ndarray, item: np.ndarray, d: np.ndarray, i: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(doc, item) pairs, as rows, whose hits lie along one diagonal over a part of the item."""
    band = (d - i) // BAND
    order = np.lexsort((band, item, doc))
    doc, item, band, i, length = doc[order], item[order], band[order], i[order], length[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
    at = np.nonzero(new)[0]
    lo, hi = np.minimum.reduceat(i, at), np.maximum.reduceat(i, at)
    doc, item, band, length = doc[at], item[at], band[at], length[at]
    near = np.concatenate([(doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (band[1:] == band[:-1] + 1), [False]])
    lo2, hi2 = np.append(lo[1:], 0), np.append(hi[1:], 0)
    lo, hi = np.where(near, np.minimum(lo, lo2), lo), np.where(near, np.maximum(hi, hi2), hi)
    keep = hi - lo + GRAM >= SPAN * length
    return np.unique(np.stack([doc[keep], item[keep]], axis=1), axis=0)


def backwards(item: Item) -> Item:
    return Item(item.text[::-1], [len(item.text) - s for s in reversed(item.starts)])


class ItemIndex:
    """The fingerprints of all items, sorted, with their places. ``items``: (id, text)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [k for k, _ in items]
        self.items = [Item.of(t) for _, t in items]
        self.back = [backwards(x) for x in self.items]
        which, place, h = fingerprints([x.text for x in self.items])
        order = np.argsort(h, kind="stable")
        self.which, self.place, self.hash = which[order], place[order], h[order]
        self.length = np.array([len(x.text) for x in self.items], dtype=np.int64)
        # a first sieve by the hashes' last bits, about one in sixteen set
        self.mask = np.uint64((1 << min(22, max(10, (16 * len(h)).bit_length()))) - 1)
        self.sieve = np.zeros(int(self.mask) + 1, dtype=bool)
        self.sieve[self.hash & self.mask] = True

    def hits(self, which: np.ndarray, place: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, place in text, place in item) of every common fingerprint."""
        at = np.nonzero(self.sieve[h & self.mask])[0]
        which, place, h = which[at], place[at], h[at]
        a, b = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = b - a
        row = np.repeat(np.arange(len(h)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + a[row]
        return which[row], self.which[k], place[row], self.place[k]


def _share(doc: str, item: Item, back: Item, hits: list[tuple[int, int]], share: float) -> tuple[int, int]:
    return stretch(doc, item, hits, back, share * len(item)), len(item)


def _blocks(pdf: pd.DataFrame, signs_held: int = 4_000_000) -> Iterator[tuple[list, list[str]]]:
    """Keys and signs of a batch in blocks of a bounded number of signs."""
    keys, texts, held = [], [], 0
    for k, t in zip(pdf["k"], pdf["t"], strict=True):
        if isinstance(t, str) and t:
            s = signs(t)
            if len(s) >= GRAM:
                keys.append(k)
                texts.append(s)
                held += len(s)
                if held >= signs_held:
                    yield keys, texts
                    keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


#: Built indexes by their broadcast's number: a worker that runs many tasks builds each once.
_BUILT: dict[str, ItemIndex] = {}


def _index(tag: str, items: Broadcast) -> ItemIndex:
    if tag not in _BUILT:
        _BUILT.clear()
        _BUILT[tag] = ItemIndex(items.value)
    return _BUILT[tag]


def item_texts(items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """``item, it, h``: the different (id, text) pairs without nulls, and the text's digest."""
    return items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).alias("item"), F.col(item_text).alias("it")).distinct().withColumn("h", F.md5("it"))


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, share: float = 0.4, held: int = 4_000_000) -> DataFrame:
    """``key, item_key, n_words, share`` for every text that carries one connected stretch of an item's
    text, in its order, of at least ``share`` of the item's words, where up to one word in eight is
    replaced. Letter case, width, composition, punctuation, spacing, line breaks and markup don't count.

    Method: winnowing. Texts are reduced to their letters and digits; of the hashes of every GRAM signs
    the least of each WINDOW is kept, in texts and items alike, so that every common span of GRAM +
    WINDOW - 1 signs has a common fingerprint. Fingerprints are joined; where hits of a pair lie along a
    diagonal they are extended in both directions over replaced words, and the longest stretch decides.
    Wording that many items share only gives hits; its stretch is too short to count.

    The items' fingerprints are sent to all tasks if the items have at most ``held`` signs (an index of
    about 25 bytes a sign in each worker), and the join
    happens where the text is read, so that no fingerprint of a text is shuffled. A larger test set is
    joined by a shuffle (``leaks_shuffled``) with the same rows.

    Defined cases: null, empty and too short texts or items leak nothing; every row of ``docs`` is
    listed for itself, with null and repeated keys too; equal items are listed by each of their ids, an id
    with several texts once for each that leaks, and a repeated (id, text) pair is one item. Items with a
    null id are left out. Texts are read whole, whatever their length. An empty table gives no rows.
    Columns of other names are ignored.
    """
    own = item_texts(items, item_key, item_text)
    size = own.agg(F.coalesce(F.sum(F.length("it")), F.lit(0))).first()[0]
    if size > held:
        return leaks_shuffled(docs, key, text, items, item_key, item_text, share)
    index = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in own.select("item", "it").orderBy("item", "it").collect()])
    tag = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = _index(tag, index)
        for pdf in batches:
            for keys, texts in _blocks(pdf):
                rows = []
                doc, item, d, i = ix.hits(*fingerprints(texts))
                if len(doc):
                    order = np.lexsort((i, d, item, doc))
                    doc, item, d, i = doc[order], item[order], d[order], i[order]
                    code = doc * len(ix.ids) + item
                    for a, b in _worth(doc, item, d, i, ix.length[item]):
                        x, y = np.searchsorted(code, a * len(ix.ids) + b, "left"), np.searchsorted(code, a * len(ix.ids) + b, "right")
                        n, words = _share(texts[a], ix.items[b], ix.back[b], list(zip(d[x:y].tolist(), i[x:y].tolist(), strict=True)), share)
                        if n and n >= share * words:
                            rows.append((keys[a], ix.ids[b], n, n / words))
                yield _typed(rows)

    shape = f"k {docs.schema[key].dataType.simpleString()}, item {items.schema[item_key].dataType.simpleString()}, n_words long, share double"
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, shape).withColumnsRenamed({"k": key, "item": item_key})


def _typed(rows: list[tuple]) -> pd.DataFrame:
    """The rows with their keys as they are: a null key among numbers would make all of them floats."""
    keys, ids, n, share = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pd.DataFrame({"k": pd.Series(keys, dtype=object), "item": pd.Series(ids, dtype=object), "n_words": pd.Series(n, dtype="int64"), "share": pd.Series(share, dtype="float64")})


#: The shuffled join's sieve of the items' fingerprints has so many bits: 8 MB, whatever the items.
SIEVE = 1 << 26


def sieve_of(hashes: DataFrame) -> np.ndarray:
    """Which last bits occur in the column ``hash``: SIEVE bits in 4 KB pieces, or-ed in the executors."""
    at = F.pmod(F.col("hash"), F.lit(SIEVE))
    pieces = hashes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(SIEVE + (1 << 15), dtype=bool)
    for r in pieces:
        # bucket 1 holds the numbers 1 to 32,768, bucket 0 the number 0
        first = (r["b"] - 1) * 32768 + 1 if r["b"] > 0 else 0
        bits = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), bitorder="little").astype(bool)
        out[first : first + 32768] |= bits[: len(out) - first] if r["b"] > 0 else np.pad(bits[:1], (0, 32767))
    return np.packbits(out[:SIEVE])


def fingerprint_rows(df: DataFrame, key: str, text: str, sieve: Broadcast | None = None) -> DataFrame:
    """``k, place, hash, length`` of every fingerprint of every text, or of those that pass the sieve."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = None if sieve is None else sieve.value
        for pdf in batches:
            for keys, texts in _blocks(pdf):
                which, place, h = fingerprints(texts)
                if bits is not None:
                    at = (h & np.uint64(SIEVE - 1)).astype(np.int64)
                    keep = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                    which, place, h = which[keep], place[keep], h[keep]
                lengths = np.array([len(t) for t in texts])
                yield pd.DataFrame({"k": pd.Series(keys, dtype=object).take(which).to_numpy(), "place": place, "hash": h.view(np.int64), "length": lengths[which]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, place long, hash long, length long")


def leaks_shuffled(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, share: float = 0.4, salts: int = 16) -> DataFrame:
    """``leaks`` for test sets of any size, with the same rows. Texts and items go by digests of their
    texts, so that keys may repeat or be null. A sieve of the items' fingerprints, of a fixed size, keeps
    most fingerprints of the texts from the shuffle; the join is salted since a common phrase may stand in
    a third of the texts, and only the pairs worth extending meet their texts."""
    spark = docs.sparkSession
    own = cut(item_texts(items, item_key, item_text))
    different = own.select("h", "it").distinct()
    right = cut(fingerprint_rows(different, "h", "it"))
    sieve = spark.sparkContext.broadcast(sieve_of(right))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.md5(text).alias("dh"))
    left = fingerprint_rows(rows, "dh", "t", sieve).select("k", "place", "hash").withColumn("s", F.pmod(F.xxhash64("k"), F.lit(salts)))
    right = right.select(F.col("k").alias("h"), F.col("place").alias("i"), "hash", F.col("length").alias("n")).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    hits = left.join(right, ["hash", "s"])
    bands = hits.groupBy("k", "h", F.floor((F.col("place") - F.col("i")) / BAND).alias("band")).agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.max("n").alias("n"))
    two = bands.select("k", "h", "n", "lo", "hi", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band")).groupBy("k", "h", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"))
    pairs = cut(two.where(F.col("hi") - F.col("lo") + GRAM >= SPAN * F.col("n")).select(F.col("k").alias("dh"), "h").distinct())
    both = rows.join(pairs, "dh").join(different, "h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, ItemIndex] = {}
        for pdf in batches:
            out = []
            for k, h, t, it in zip(pdf["k"], pdf["h"], pdf["t"], pdf["it"], strict=True):
                if h not in held:
                    if len(held) >= 1000:
                        held.clear()
                    held[h] = ItemIndex([(h, it)])
                ix, s = held[h], signs(t)
                _, _, d, i = ix.hits(*fingerprints([s]))
                n, words = _share(s, ix.items[0], ix.back[0], sorted(zip(d.tolist(), i.tolist(), strict=True)), share)
                if n and n >= share * words:
                    out.append((k, h, n, n / words))
            yield _typed(out)

    found = both.select("k", "h", "t", "it").mapInPandas(run, f"k {docs.schema[key].dataType.simpleString()}, item string, n_words long, share double")
    out = found.withColumnRenamed("item", "h").join(own.select("h", "item"), "h")
    return out.select(F.col("k").alias(key), F.col("item").alias(item_key), "n_words", "share")
