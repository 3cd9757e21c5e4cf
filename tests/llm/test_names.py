import pytest

from tidemark.llm.names import NameTrie, Reference, keys_of, map_names, spellings, swap_cost, tokens_of

ENTRIES = [(1, ("신사포멀", "Gents Formalwear")), (2, ("신사양말", "Gents Hosiery")), (3, ("리빙 침장", "Living Bedding")), (4, ("뷰티향", "Beauty Fragrance")), (5, ("푸드홀반찬", "Foodhall Sidedish")), (6, ("임산부양말", "Maternity Hosiery"))]
TRIE = NameTrie(ENTRIES)


@pytest.mark.parametrize(
    "typed, ref",
    [
        ("신사양말", 2), ("  신사 양말　", 2), ("★신사양말", 2), ("[신사양말](본관)", 2), ("2F 신사양말 -신관", 2), ("신사양말코너", 2), ("신/사양말", 2), ("신사﻿양말", 2), ("신양말", 2), ("신사사양말", 2), ("사신양말", 2), ("싄사양말", 2), ("신사양먈(행)", 2),
        ("tlstkdidakf", 2), ("TLSTK didakf", 2), ("GENTS HOSIERY", 2), ("ｇｅｎｔｓ ｈｏｓｉｅｒｙ", 2), ("Hosiery Gents", 2), ("GentsHosiery", 2), ("Gents-Hosiery", 2), ("Gents Hoseiry", 2), ("Gents Hosiry", 2), ("침장 리빙", 3), ("리빙침장", 3), ("리빙침장", 3), ("뷰티향.", 4), ("풍드호반찬", 5), ("임싼부양말 外", 6), ("특별본관신사양말판매", 2),
    ],
)
def test_spellings_find_their_entry(typed, ref):
    assert TRIE.best(typed)[0] == ref


@pytest.mark.parametrize("typed", ["미지정", "N/A", "???", "-", "x", "99", "주차연장", "문화강좌 민원", "MD-046", "2025-08-23", "​", "Staff canteen"])
def test_other_values_find_none(typed):
    assert TRIE.best(typed) is None


def edit(a, b):
    """Weighted distance by the whole table, with swaps of neighbours."""
    d = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for j in range(1, len(b) + 1):
        d[0][j] = d[0][j - 1] + (0.7 if j > 1 and b[j - 1] == b[j - 2] else 1.0)
    for i in range(1, len(a) + 1):
        d[i][0] = float(i)
        for j in range(1, len(b) + 1):
            again = b[j - 1] == a[i - 1] or (j > 1 and b[j - 1] == b[j - 2])
            d[i][j] = min(d[i - 1][j - 1] + swap_cost(a[i - 1], b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + (0.7 if again else 1.0))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 0.8)
    return d[-1][-1]


def test_the_automaton_finds_all_that_the_table_finds():
    import random

    from tidemark.llm.names import allowed, is_hangul

    rng = random.Random(8)
    paths = {}
    for ref, names in ENTRIES:
        for n in names:
            w = tokens_of(n)
            for p in {"".join(w), "".join(reversed(w))}:
                paths.setdefault(p, set()).add(ref)
                if any(map(is_hangul, p)):
                    paths.setdefault(keys_of(p), set()).add(ref)
    for _ in range(200):
        t = list(rng.choice(list(paths)))
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], [t[k], t[k]], [rng.choice("가신양aeq")], t[k : k + 2][::-1]])
        t = "".join(t)
        if not t or t in paths:
            continue
        hangul = any(map(is_hangul, t))
        want = {}
        for p, refs in paths.items():
            if any(map(is_hangul, p)) == hangul and edit(p, t) <= allowed(len(p), hangul):
                for r in refs:
                    want[r] = min(want.get(r, 9), edit(p, t))
        assert {r: round(c, 6) for r, c in TRIE.within(t).items()} == {r: round(c, 6) for r, c in want.items()}, t


def tables(spark, ref_rows=None):
    ref = spark.createDataFrame([(i, *n) for i, n in ENTRIES] if ref_rows is None else ref_rows, "part_id long, part_nm string, part_nm_en string")
    rows = [(1, "신사양말", "a"), (2, "신사 양말", "b"), (3, None, "c"), (4, "   ", "d"), (5, "미지정", "e"), (6, "신사 양말", "f"), (7, "뷰티향" * 4000, "g"), (8, "", None)]
    return spark.createDataFrame(rows, "line_id long, part_nm string, field string"), {"part_nm": Reference(ref, "part_id", ("part_nm", "part_nm_en"))}


def test_rows_of_every_kind(spark):
    df, fields = tables(spark)
    found = spellings(df, fields)
    got = {r.line_id: r.ref_part_nm for r in map_names(df, fields, found).collect()}
    assert got == {1: None, 2: 2, 3: None, 4: None, 5: -1, 6: 2, 7: -1, 8: None}
    assert found.where("value = '신사 양말'").count() == 1


def test_blocks_give_the_same(spark):
    df, fields = tables(spark)
    a = {tuple(r) for r in spellings(df, fields).collect()}
    assert a == {tuple(r) for r in spellings(df, fields, block=2).collect()}


def test_empty_tables_and_null_names(spark):
    df, fields = tables(spark)
    assert spellings(df.where("false"), fields).count() == 0
    df, fields = tables(spark, [])
    assert {r.ref_id for r in spellings(df, fields).collect()} == {-1}
    df, fields = tables(spark, [(9, None, "Gents Hosiery"), (None, "신사양말", None), (9, None, "Gents Hosiery")])
    assert spellings(df, fields).where("ref_id = 9").count() == 0


def test_the_size_of_a_block_changes_nothing(spark):
    """A name in reach in one block and a name inside the value in another; ties over blocks; repeated ids."""
    rows = [(1, "abcdefgh", None), (2, "xyabcdefghzq", None), (3, "xyabcdefghzv", None), (4, "abcdefghz", None), (4, "gents formal", None), (5, None, None), (6, "gants formal", "gents")]
    ref = spark.createDataFrame(rows, "part_id long, part_nm string, part_nm_en string")
    typed = ["xyabcdefghzw", "qqabcdefghzqq", "gints formal", "gents formal x", "nothing", "gents", None, " ", "abcdefgh"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(typed)], "line_id long, part_nm string")
    fields = {"part_nm": Reference(ref, "part_id", ("part_nm", "part_nm_en"))}
    want = sorted(map(str, spellings(df, fields).collect()))
    for block in (1, 2, 3):
        assert want == sorted(map(str, spellings(df, fields, block=block).collect()))
    got = {r.value: (r.ref_id, r.distance, r.n_as_close, r.n_in_reach) for r in spellings(df, fields, block=1).collect()}
    assert got["xyabcdefghzw"] == (2, 1.0, 2, 2) and got["qqabcdefghzqq"][0] == 4 and got["gints formal"][2] == 2
    assert got["nothing"] == (-1, None, 0, 0) and "abcdefgh" not in got


def test_all_entries_in_reach(spark):
    """An exact spelling of one entry doesn't hide another within the distance."""
    assert TRIE.within("신사양말") == {2: 0.0}
    near = NameTrie([(1, ("gents hosiery",)), (2, ("gents hosiary",)), (3, ("ladies hosiery",))])
    assert near.reach("Gents Hosiery")[0] == {1: 0.0, 2: 1.0}
