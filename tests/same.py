"""Comparison of a Spark result with an oracle's."""

import math


def canonical(rows, columns):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        if isinstance(x, (bool, str)):
            return str(x)
        if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
            return f"{float(x):.6g}"
        return str(x)

    return sorted(tuple(one(r[c]) for c in columns) for r in rows)


def assert_same(df, con, sql):
    got = [r.asDict() for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(names)
    a, b = canonical(got, sorted(names)), canonical(want, sorted(names))
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)
