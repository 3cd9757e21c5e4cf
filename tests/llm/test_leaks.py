import random
import unicodedata

import pytest

from tidemark.llm import leaks as L

WORDS = "settlement branch crates umbrella ledger auditor inspector whereas customers tailor furnace harbour 온도계의 눈금이 창고 무쇠 접시 담요를 나눠 보내면서 예비로 두었다 회원 정산액은 전월보다 기록한 주문 배낭의 불량은 슬며시".split()


def passage(rng, n=70):
    return [rng.choice(WORDS) + (str(rng.randint(10, 9999)) if rng.random() < 0.4 else "") for _ in range(n)]


def world():
    rng = random.Random(6)
    head = "다음 글을 읽고 물음에 알맞은 답을 고르시오".split()
    items = {100 + i: head + passage(rng) for i in range(12)}
    noise = lambda n=60: " ".join(passage(rng, n))
    docs, want = [], set()

    def add(text, *found):
        docs.append((len(docs), text))
        want.update((len(docs) - 1, f) for f in found)

    def part(item, share, at=9, swap=0):
        words = items[item][at : at + -(-int(share * 100 * len(items[item])) // 100)]
        for k in range(4, len(words), 9)[: swap or None] if swap else []:
            words[k] = "거의"
        return words

    add(noise() + " " + " ".join(items[100]) + " " + noise(), 100)
    add(" ".join(part(101, 0.5)).upper(), 101)
    add("<p>" + "</b> <b>".join(part(102, 0.5)) + "</p>", 102)
    add("".join(part(103, 0.5)), 103)
    add("\n".join("…".join(part(104, 0.6))[i : i + 17] for i in range(0, 2000, 17)), 104)
    add(unicodedata.normalize("NFD", " ".join(part(105, 0.5))), 105)
    add(" ".join(part(106, 0.55, swap=99)), 106)
    add("".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in " ".join(part(107, 0.5))), 107)
    add("&nbsp;".join(part(108, 0.5)) + noise(), 108)
    add(noise(3000) + " ".join(part(109, 0.5)) + noise(3000), 109)
    add(" ".join(head) + " " + noise())  # shared wording alone
    add(noise() + " " + " ".join(part(110, 0.25)) + " " + noise())  # too little
    add(" ".join(w for k in range(0, 60, 6) for w in part(111, 0.9)[k : k + 6][::-1]))  # in another order
    add(" ".join(w for k in range(9, 70, 8) for w in items[110][k : k + 8] + passage(rng, 12)))  # not connected
    for t in (None, "", "짧다", "   "):
        add(t)
    add(docs[0][1], 100)  # a copy
    return docs, items, want


@pytest.fixture(scope="module")
def tables(spark):
    docs, items, want = world()
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, k string, item string")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(999, None), (998, "")], "item_id long, text string")
    return d, e, want


@pytest.mark.parametrize("how", [L.leaks, L.leaks_shuffled])
def test_planted_cases(tables, how):
    d, e, want = tables
    assert {(r.doc_id, r.item_id) for r in how(d, "doc_id", "text", e, "item_id", "text").collect()} == want


def test_large_test_sets_are_shuffled(tables):
    d, e, want = tables
    assert {(r.doc_id, r.item_id) for r in L.leaks(d, "doc_id", "text", e, "item_id", "text", held=10).collect()} == want


def test_empty_tables(tables):
    d, e, _ = tables
    for how in (L.leaks, L.leaks_shuffled):
        assert how(d.where("false"), "doc_id", "text", e, "item_id", "text").count() == 0
        assert how(d, "doc_id", "text", e.where("false"), "item_id", "text").count() == 0


def test_every_long_enough_span_has_a_common_fingerprint():
    rng = random.Random(2)
    for _ in range(300):
        span = "".join(rng.choice("abcde가나다") for _ in range(L.GRAM + L.WINDOW - 1))
        a = "".join(rng.choice("abcde") for _ in range(rng.randint(0, 30))) + span
        b = span + "".join(rng.choice("나다라") for _ in range(rng.randint(0, 30)))
        w, _, h = L.fingerprints([a, b])
        assert set(h[w == 0]) & set(h[w == 1])


def test_fingerprints_stay_in_their_text():
    whole = L.fingerprints(["abcdefghijklmnop", "qrstuvwxyzabcdefg"])
    for k, t in enumerate(["abcdefghijklmnop", "qrstuvwxyzabcdefg"]):
        one = L.fingerprints([t])
        assert list(whole[2][whole[0] == k]) == list(one[2]) and list(whole[1][whole[0] == k]) == list(one[1])
    assert len(L.fingerprints([])[0]) == 0 and len(L.fingerprints(["short"])[0]) == 0


def test_both_ways_give_the_same_rows(spark):
    """Repeated and null ids on either side, equal texts and equal items, and a repeated (id, text) pair."""
    docs, items, _ = world()
    texts = {k: " ".join(w) for k, w in items.items()}
    d = spark.createDataFrame([(1, texts[100]), (2, texts[101]), (None, texts[100]), (None, texts[102]), (1, texts[100]), (1, texts[103] + " " + texts[101]), (4, None)], "doc_id long, text string")
    e = spark.createDataFrame([(9, texts[100]), (9, texts[101]), (9, texts[101]), (8, texts[100]), (None, texts[102]), (7, texts[102]), (6, texts[103])], "item_id long, text string")
    one = sorted(map(str, L.leaks(d, "doc_id", "text", e, "item_id", "text").collect()))
    assert one == sorted(map(str, L.leaks(d, "doc_id", "text", e, "item_id", "text", held=10).collect()))
    assert len(one) == 10


def test_the_sieve_holds_all_and_little_else(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    h = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 5000), [0, 1, -1, 32768, 32769, L.SIEVE, L.SIEVE - 1]])
    bits = np.unpackbits(L.sieve_of(spark.createDataFrame([(int(x),) for x in h], "hash long")))
    at = h.view(np.uint64) & np.uint64(L.SIEVE - 1)
    assert bits[at.astype(np.int64)].all() and bits.sum() == len(np.unique(at))
