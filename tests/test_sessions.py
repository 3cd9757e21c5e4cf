from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators.sessions import sessionize

T0 = datetime(2025, 3, 1, 0, 0, 0)
SHAPE = "custid long, sales_datetime timestamp_ntz, line_id long"


def brute(rows, gap):
    out = []
    for c in {r[0] for r in rows if r[0] is not None and r[1] is not None}:
        own = sorted((r[1], r[2]) for r in rows if r[0] == c and r[1] is not None)
        cur = [own[0]]
        for x in own[1:]:
            if (x[0] - cur[-1][0]).total_seconds() > gap:
                out.append((c, cur))
                cur = []
            cur.append(x)
        out.append((c, cur))
    return sorted((c, s[0][0], s[-1][0], len(s), len(set(s))) for c, s in out)


def run(spark, rows, **args):
    df = sessionize(spark.createDataFrame(rows, SHAPE), "custid", "sales_datetime", "line_id", **args)
    return sorted((r.custid, r.session_start, r.session_end, r.n_rows, r.n_lines) for r in df.collect())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.integers(0, 60 * 40), st.integers(1, 30)), min_size=1, max_size=60))
def test_against_brute_force(spark, rows):
    # a line has one customer and time
    lines = {line: (c, T0 + timedelta(minutes=m)) for c, m, line in rows}
    data = [(*lines[line], line) for _, _, line in rows]
    assert run(spark, data) == brute(data, 1800)


def test_exactly_the_gap_and_over_slices(spark):
    times = [timedelta(hours=5, minutes=45), timedelta(hours=6, minutes=15), timedelta(hours=6, minutes=45, seconds=1), timedelta(hours=23, minutes=50), timedelta(hours=24, minutes=10)]
    rows = [(1, T0 + t, i) for i, t in enumerate(times)]
    assert [(s[3]) for s in run(spark, rows)] == [2, 1, 2]


def test_a_chain_over_whole_slices(spark):
    rows = [(7, T0 + timedelta(minutes=20 * i), i) for i in range(100)]
    assert run(spark, rows) == [(7, T0, T0 + timedelta(minutes=20 * 99), 100, 100)]


def test_nulls_repeats_and_empty(spark):
    rows = [(1, T0, 1), (1, T0, 1), (1, T0, None), (None, T0, 2), (1, None, 3)]
    assert run(spark, rows) == [(1, T0, T0, 3, 1)]
    assert run(spark, [(None, None, None)]) == []
    assert run(spark, []) == []


def test_least_lines(spark):
    rows = [(1, T0, 1), (1, T0, 1), (2, T0, 1), (2, T0 + timedelta(minutes=3), 2)]
    assert [s[0] for s in run(spark, rows, min_lines=2)] == [2]


def test_clashing_columns_and_bad_gap(spark):
    df = spark.createDataFrame([(1, T0, 5, "x", "y", "z")], "custid long, sales_datetime timestamp_ntz, line_id long, e string, t string, k string")
    assert sessionize(df, "custid", "sales_datetime", "line_id").count() == 1
    with pytest.raises(ValueError):
        sessionize(df, "custid", "sales_datetime", "line_id", gap_seconds=7 * 3600)
