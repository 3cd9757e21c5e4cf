import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.packing import RANKS, pack, plan_slots, token_counts


def one_by_one(items, capacity):
    """Best fit, longest first: the number of containers."""
    room = []
    for x in sorted(items, reverse=True):
        fit = [r for r in room if r >= x]
        if fit:
            r = min(fit)
            room[room.index(r)] = r - x
        else:
            room.append(capacity - x)
    return len(room)


@settings(max_examples=150, deadline=None)
@given(st.integers(5, 60), st.data())
def test_plan_equals_best_fit(capacity, data):
    hist = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(1, 12), min_size=1, max_size=10))
    slots, n = plan_slots(hist, capacity)
    assert n == one_by_one([x for x, k in hist.items() for _ in range(k)], capacity)
    slots, full, got = sorted(slots), defaultdict(list), Counter()
    for i, (length, rank, first, each, offset) in enumerate(slots):
        end = slots[i + 1][1] if i + 1 < len(slots) and slots[i + 1][0] == length else hist[length]
        for j in range(end - rank):
            full[first + j // each].append((offset + j % each * length, length))
            got[length] += 1
    assert got == Counter(hist) and len(full) == n
    for parts in full.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= capacity


def check(rows, sizes, capacity):
    cover, full = defaultdict(list), defaultdict(list)
    for r in rows:
        cover[r.id].append((r.text_start, r.n_tokens))
        if r.container >= 0:
            full[r.container].append((r.container_start, r.n_tokens))
    for i, n in sizes.items():
        at = 0
        for start, k in sorted(cover[i]):
            assert start == at
            at += k
        assert at == n and (len(cover[i]) == 1 or n > capacity)
        assert len(cover[i]) == max(1, -(-n // capacity))
    for parts in full.values():
        at = 0
        for start, k in sorted(parts):
            assert start == at and k > 0
            at += k
        assert at <= capacity
    return len(full)


def test_every_token_has_one_place(spark):
    rng = random.Random(3)
    sizes = {i: rng.choice([0, 1, 7, 7, 7, 50, 64, 65, 300, rng.randint(1, 200)]) for i in range(400)}
    df = spark.createDataFrame([(i, n, 0) for i, n in sizes.items()], "id long, n long, piece int")
    n = check(pack(df, "id", "n", 64).collect(), sizes, 64)
    items = [p for x in sizes.values() for p in ([64] * (x // 64) + ([x % 64] if x % 64 else []))]
    assert n == one_by_one(items, 64)


def test_a_length_that_most_share(spark):
    sizes = dict.fromkeys(range(900), 20)
    df = spark.createDataFrame(list(sizes.items()), "id long, n long")
    assert check(pack(df, "id", "n", 64).collect(), sizes, 64) == 300


def test_null_zero_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, 0)], "id long, n long")
    assert {(r.id, r.container, r.n_tokens) for r in pack(df, "id", "n", 64).collect()} == {(1, -1, 0), (2, -1, 0)}
    assert pack(df.where("false"), "id", "n", 64).count() == 0
    with pytest.raises(ValueError):
        plan_slots({70: 1}, 64)


def test_counts_are_the_tokenizers(spark):
    from tidemark.llm.packing import encoding

    texts = ["hello world", "", None, "가나다 라마바", "x" * 200_000, "<|endoftext|> 👍🏽‍"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as k", "'y' as t", "1 as n_tokens")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, "doc_id", "text").collect()}
    own = encoding(RANKS)
    assert got == {i: len(own.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert own.decode(own.encode_ordinary(texts[3])) == texts[3]
