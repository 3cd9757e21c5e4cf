"""Pages of keywords, links and tags instead of sentences."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: English words that bind a sentence together.
FUNCTION_WORDS = frozenset(
    "a about after again against all also am an and any are as at away be because been before being below between both but by can could did do does down during each either every few for from had has have he her here him his how i if in into is it its just last left like may me might more most much must my never no nobody nor not nothing of off often on once one only or other our out over own per rather said same she should since so some still such than that the their them then there these they this those through to too toward under until up upon us very was we were what when where whether which while who whose why will with within without would yet you your".split()
)

#: Korean endings of words in a sentence (particles and verb endings), by last syllables.
#: Syllables on which many bare nouns end too are left out.
ENDINGS_1 = frozenset("다 요 은 는 을 를 에 로 도 만 고 며 서 면 니 지 게 데 라 한 된 할 쯤 씩 께 까 죠 네 져 와 던 랑 듯 된 인 될 운 른 린 진 난 낸 든 본".split())
ENDINGS_2 = frozenset(
    "십시오 니다 에서 으로 부터 까지 보다 처럼 마다 이나 에게 하는 되는 하고 하며 하면 지만 는데 라서 어서 아서 려고 다며 라며 다고 라고 이며 이고 이라 에는 에도 로는 로도 와는 과는 들이 것이 것을 수도 쪽이 것은 때문 따라 위해 대해 동안".split()
)

TOKEN = re.compile(r"https?://\S+|www\.\S+|#[^\s#]+|[^\W_]+(?:[.,:][0-9]+)*|[^\w\s]+|_+")
LINK = re.compile(r"https?://|www\.")
HANGUL = re.compile("[\uac00-\ud7a3]")
KANA, HIRAGANA = re.compile("[\u3041-\u3096\u30a1-\u30fa]"), re.compile("[\u3041-\u3096]")
LATIN = re.compile("[a-zA-Z\u00c0-\u024f]+")
#: Scripts whose words are read here: Latin, Hangul and kana; Han signs in texts with kana.
READ = re.compile("[a-z\u00c0-\u024f\uac00-\ud7a3\u3041-\u3096\u30a1-\u30fa0-9]", re.IGNORECASE)
#: Where sentences are glued together, these stand in every one of them; bare nouns seldom hold them.
INSIDE = re.compile("[을를는었았했겠]|에서|으로|니다|렸다|졌다|이다|한다|된다|까지|부터|지만|하고|하며|라고|다고|면서|십시오|어요|아요|네요|세요|습니|에게|께서|보다|처럼|이고|이며|어서|아서|해서|줘서|라서|려고|에는|에도")

#: Pieces into which longer words are cut for windows, so that a page glued into one word has terms too.
PIECE = 8

#: Terms on each side of a term that make its window, and the greatest lag at which a term recurs.
AROUND, LAGS = 8, 24
#: The gap of a term's first occurrence.
FIRST = 1 << 40
#: A window with a lower share of binding words is a list; with regular repetition, one below BOUND.
LISTED, BOUND, REPEATED = 0.2, 0.35, 0.6
#: A window with such a share of terms that recur within AROUND is a list unless BOUND of its words bind
#: surely; with PARTLY, as where a list meets a sentence, its recurring terms that don't bind surely are
#: listed. In a text of such an autocorrelation, a window with fewer than LISTED that do is a list.
CLOSE, PARTLY, REGULAR = 0.9, 0.4, 0.8

#: Unknown words of so many signs are more than a keyword.
LONG = 5

#: Single Korean letters, as in a written laugh, belong to no word.
LETTERS = re.compile("[\u1100-\u11ff\u3130-\u318f]+")
MARKUP = re.compile(r"<[^<>]*>")
HREF = re.compile(r"https?://[^\s\"'<>]+")


def _unmarked(m: re.Match) -> str:
    link = HREF.search(m.group())
    return f" {link.group()} " if link else " "


#: A text of at least WORDS Latin words of which under ENGLISH are English function words is in another
#: language if SHORT of them, at least 3 different ones, have up to 3 letters, or MARKED of them letters
#: beyond English; short words bind there, as function words are short in every alphabet.
WORDS, ENGLISH, SHORT, MARKED = 5, 0.1, 0.25, 0.15


def _latin(words: list[tuple[int, str]], kinds: list[int]) -> None:
    """Sets the kinds of a text's Latin words, given as (place, word), if it isn't English."""
    if len(words) < WORDS or sum(kinds[k] == 2 for k, _ in words) >= ENGLISH * len(words):
        return
    short = [k for k, w in words if len(w) <= 3 and kinds[k] == 0]
    marked = sum(not w.isascii() for _, w in words)
    if marked < MARKED * len(words):
        often = Counter(w for _, w in words if len(w) <= 3)
        # one short word that makes most of them is a keyword
        if len(short) < SHORT * len(words) or len(often) < 3 or 2 * max(often.values()) > often.total():
            return
    for k, w in words:
        # where words are few but long, as in agglutinating languages, they can't be told apart
        kinds[k] = 2 if len(w) <= 3 else 3 if len(short) < SHORT * len(words) else kinds[k]


def terms(text: str) -> tuple[list[int], list[int], list[int]]:
    """(number, length, kind) of every term: kind 2 is a word that surely binds sentences (a function word,
    an ending of several syllables, a particle that no noun holds, hiragana, a short word of another Latin
    language), 1 one that does by its last syllable alone, 0 another word, 3 a word in a script or language
    whose binding words aren't known, -1 a link or tag. Words over two pieces long are cut, and a piece
    binds by what stands inside."""
    text = LETTERS.sub(" ", unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = MARKUP.sub(_unmarked, text)
    kana = KANA.search(text) is not None
    ids, sizes, kinds, latin = [], [], [], []
    for t in TOKEN.findall(text):
        c = t[0]
        n = len(t)
        if c == "#" and n > 1:
            kind = -1
        elif not c.isalnum():
            continue
        elif n > 7 and LINK.match(t):
            kind = -1
        elif t.isascii():
            kind = 2 * (t.lower() in FUNCTION_WORDS)
            if t.isalpha():
                latin.append((len(kinds), t.lower()))
        elif LATIN.fullmatch(t):
            kind = 0
            latin.append((len(kinds), t.lower()))
        else:
            known = kana or READ.search(t) is not None
            if n > 2 * PIECE:
                for k in range(0, n, PIECE):
                    piece = t[k : k + PIECE]
                    ids.append(hash(piece))
                    sizes.append(len(piece))
                    kinds.append(3 if not known else 2 * (INSIDE.search(piece) is not None or len(HIRAGANA.findall(piece)) * 4 >= len(piece)))
                continue
            if kana and not HANGUL.search(t):
                kind = 2 * (len(HIRAGANA.findall(t)) * 4 >= n)
            elif not known:
                kind = 3
            else:
                sure = t[-2:] in ENDINGS_2 or t[-3:] in ENDINGS_2 or INSIDE.search(t)
                kind = 0 if n < 2 else 2 if sure and (t[-1] in ENDINGS_1 or t[-2:] in ENDINGS_2 or t[-3:] in ENDINGS_2) else int(t[-1] in ENDINGS_1)
        ids.append(hash(t.lower()) if kind >= 0 else hash(t))
        sizes.append(n)
        kinds.append(kind)
    _latin(latin, kinds)
    return ids, sizes, kinds


def measure(texts: list[str]) -> pd.DataFrame:
    """For each text: ``n_terms``, ``sentence_share`` (of the signs in terms), ``repeated_share`` (of the
    terms, in windows of regular repetition), ``best_lag`` and ``autocorrelation`` there, ``distinct_share``
    (different terms among all)."""
    ids, sizes, kinds, counts = [], [], [], []
    for t in texts:
        a, b, c = terms(t)
        ids += a
        sizes += b
        kinds += c
        counts.append(len(a))
    counts = np.array(counts, dtype=np.int64)
    n = len(ids)
    out = pd.DataFrame({"n_terms": counts})
    ends = np.cumsum(counts)
    starts = ends - counts
    if not n:
        return out.assign(sentence_share=0.0, repeated_share=0.0, best_lag=0, autocorrelation=0.0, distinct_share=0.0)
    ids, sizes, kinds = np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64), np.array(kinds)
    doc = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(n)
    first, last = starts[doc], ends[doc]
    lo, hi = np.maximum(pos - AROUND, first), np.minimum(pos + AROUND + 1, last)
    width = hi - lo

    def window(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x)])
        return (c[hi] - c[lo]) / width

    # gap to the term's last occurrence in the text
    order = np.lexsort((pos, ids, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (ids[order][1:] == ids[order][:-1])
    gap = np.full(n, FIRST, dtype=np.int64)
    gap[order[1:][same]] = (pos[order][1:] - pos[order][:-1])[same]
    # and to the nearer one of its last and next
    near = gap.copy()
    near[order[:-1][same]] = np.minimum(gap[order[:-1][same]], gap[order[1:][same]])
    fresh = np.add.reduceat(np.append((gap == FIRST).astype(np.int64), 0), np.minimum(starts, n))
    # autocorrelation of the term sequence at each lag
    best, at = np.zeros(len(counts)), np.zeros(len(counts), dtype=np.int64)
    for lag in range(1, LAGS + 1):
        if n <= lag:
            break
        equal = np.zeros(n + 1, dtype=np.int64)
        equal[lag:n] = (ids[lag:] == ids[:-lag]) & (doc[lag:] == doc[:-lag])
        share = np.add.reduceat(equal, np.minimum(starts, n)) / np.maximum(counts - lag, 1)
        share[counts <= lag + 3] = 0
        better = share > best
        best[better], at[better] = share[better], lag
    # beyond LAGS: the commonest gap of the text's recurring terms is its period
    far = gap[(gap > LAGS) & (gap < FIRST)]
    if len(far):
        pair, times = np.unique(doc[(gap > LAGS) & (gap < FIRST)] * FIRST + far, return_counts=True)
        of, lag = pair // FIRST, pair % FIRST
        share = np.where(counts[of] > lag + 3, times / np.maximum(counts[of] - lag, 1), 0)
        k = np.lexsort((lag, -share, of))
        k = k[np.concatenate([[True], of[k][1:] != of[k][:-1]])]
        k = k[share[k] > best[of[k]]]
        best[of[k]], at[of[k]] = share[k], lag[k]
    # a last syllable says nothing of a word that stands there again and again
    # nor does it in a text of a few words that doesn't end with it
    few = (counts < REMARK) & (counts > 0)
    few[few] = kinds[ends[few] - 1] < 1
    kinds = np.where(few[doc] & (kinds == 1), 0, kinds)
    binds = (kinds == 2) | ((kinds == 3) & (sizes >= LONG))
    bind = window(binds | (kinds == 3) | ((kinds == 1) & (near > AROUND)))
    sure = window(binds)
    again = window((gap <= LAGS) | ((gap == at[doc]) & (best[doc] >= REPEATED)))
    keyword = (kinds < 0) | (bind < LISTED) | ((again >= REPEATED) & (bind < BOUND))
    close = window(near <= AROUND)
    keyword |= (close >= CLOSE) & (sure < BOUND)
    keyword |= (close >= PARTLY) & (near <= AROUND) & ~binds
    keyword |= (best[doc] >= REGULAR) & (sure < LISTED)

    def total(x: np.ndarray) -> np.ndarray:
        s = np.add.reduceat(np.append(x, 0), np.minimum(starts, n))
        return np.where(counts > 0, s, 0)

    signs = np.maximum(total(sizes), 1)
    return out.assign(
        sentence_share=np.where(counts > 0, 1 - total(np.where(keyword, sizes, 0)) / signs, 0.0),
        repeated_share=total((again >= REPEATED).astype(np.int64)) / np.maximum(counts, 1),
        best_lag=at,
        autocorrelation=np.where(counts > 0, best, 0.0),
        distinct_share=np.where(counts > 0, fresh, 0) / np.maximum(counts, 1),
    )


#: A text with a smaller share of its signs in sentences is made of keywords. Below FEW terms, none a link
#: or tag, it is a remark.
SENTENCES, FEW = 0.42, 5

#: In a text of fewer terms a last syllable binds only if the text ends so.
REMARK = 12


def keyword_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """For every row ``key``, ``n_terms, sentence_share, repeated_share, best_lag, autocorrelation,
    distinct_share`` and ``is_stuffed``: whether the text is made of repeated or strung-together keywords,
    links or tags.

    Method: a window of AROUND terms on each side of a term shows a list if few of its words bind a
    sentence (function words, Korean particles and verb endings), however different the nouns are; with
    unnaturally regular repetition, that is, most terms recurring within LAGS, more binding words are
    needed. A last syllable makes no word binding that recurs within AROUND, and a window of almost only
    such terms, or any in a text whose strongest positional autocorrelation over the lags 1 to LAGS is
    at least REGULAR, is a list unless words bind it surely; so sentences that are written again and
    again stay sentences. Beyond LAGS the commonest recurrence gap is the lag, so a page that repeats after
    any number of terms is found. Binding words are listed for Korean and English; Japanese binds by
    hiragana and other Latin languages by their short words; where binding words can't be known (other
    scripts, Latin languages of long words) only repetition makes a list. Links and tags are no sentence. The signs of the terms outside of lists make
    the sentence share, which decides. ``distinct_share`` and ``repeated_share`` are only reported.

    Each row is judged by itself; nothing is shuffled. Defined cases: null, blank and sign-only texts have
    0 terms and aren't stuffed; a text of under FEW terms without link or tag is a remark; texts are read
    whole. Equal texts are judged alike. An empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["t"]]
            at, held = 0, 0
            for k, t in enumerate(texts):  # in blocks of a bounded number of signs
                held += len(t)
                if held > 2_000_000 or k == len(texts) - 1:
                    part = measure(texts[at : k + 1])
                    plain = (part["n_terms"] < FEW) & np.array([not ("#" in t or "://" in t or "www." in t) for t in texts[at : k + 1]])
                    part["is_stuffed"] = (part["sentence_share"] < SENTENCES) & (part["n_terms"] > 0) & ~plain
                    part.insert(0, "k", pdf["k"].iloc[at : k + 1].to_numpy())
                    yield part
                    at, held = k + 1, 0

    shape = "n_terms long, sentence_share double, repeated_share double, best_lag long, autocorrelation double, distinct_share double, is_stuffed boolean"
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, {shape}").withColumnRenamed("k", key)
