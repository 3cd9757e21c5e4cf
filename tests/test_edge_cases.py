"""Every feature block over a few awkward lines, against the oracle, and over no lines at all."""

from datetime import datetime, timedelta

import pytest

from tests.same import assert_same
from tidemark.plans import blocks, encoders
from tidemark.plans.registry import oracle_sql, queries

SHAPE = (
    "line_id long, custid long, sales_datetime timestamp_ntz, str_nm string, goodcd string, brd_nm string, corner_nm string, pc_nm string, part_nm string, team_nm string, buyer_nm string, "
    "import_flg int, tot_amt long, dis_amt long, net_amt long, inst_mon int, inst_fee long, loaded_at timestamp_ntz"
)
T0 = datetime(2025, 2, 27, 11, 59, 59)


def line(i, c, t, net, **other):
    row = {"str_nm": "가람본점", "goodcd": "0887289220363", "brd_nm": "Fayiska", "corner_nm": "도자기램프", "pc_nm": "램프류", "part_nm": "리빙조명", "team_nm": "생활2팀", "buyer_nm": "MD34", "import_flg": 0, "tot_amt": abs(net or 0) * 2, "dis_amt": abs(net or 0), "inst_mon": 0} | other
    return (i, c, t, *[row[k] for k in ("str_nm", "goodcd", "brd_nm", "corner_nm", "pc_nm", "part_nm", "team_nm", "buyer_nm", "import_flg", "tot_amt", "dis_amt")], net, row["inst_mon"], 0, t)


NULLS = dict.fromkeys(("str_nm", "goodcd", "brd_nm", "corner_nm", "pc_nm", "part_nm", "team_nm", "buyer_nm"))
LINES = [
    line(1, 1, T0, 1000),  # one line alone
    *[line(10 + i, 2, T0, 500 * i, brd_nm=f" brand{i % 2} ") for i in range(4)],  # one time for all
    *[line(20 + i, 3, T0 + timedelta(days=9 * i, hours=i), -700) for i in range(5)],  # refunds only
    *[line(30 + i, 4, T0 + timedelta(minutes=29 * i), 0, tot_amt=0, dis_amt=0) for i in range(3)],  # nothing paid
    *[line(40 + i, 5, T0 + timedelta(days=i), None, **NULLS) for i in range(3)],  # nothing known
    *[line(50 + i, 6, T0.replace(hour=h, minute=0, second=0), 300_001 * (i + 1), goodcd=g, inst_mon=i) for i, (h, g) in enumerate([(11, "  "), (14, "123"), (17, "2700000000000"), (0, "0887289220363"), (23, "2900000000000")])],
    *[line(50 + i, 6, T0.replace(hour=h, minute=0, second=0), 300_001 * (i + 1), goodcd=g, inst_mon=i) for i, (h, g) in enumerate([(11, "  "), (14, "123")])],  # delivered again
    *[line(60 + i, 7, T0 + timedelta(days=40 * i), 5_000_000_000 * (-1) ** i, import_flg=1, part_nm="여성캐쥬얼", pc_nm="향수", buyer_nm=f"MD{i % 3}") for i in range(9)],
    line(90, None, T0, 100),
    line(91, 8, None, 100),
]
OTHERS = [line(200 + i, 90 + i % 2, T0 + timedelta(hours=5 * i), 900 * i, brd_nm="only here" if i == 1 else "Fayiska") for i in range(5)]
LABELS = [(c, c % 2) for c in range(1, 9)] + [(3, 0), (7, None), (None, 1), (900, 1)]
META = [("FAYISKA", 30.0, 2, 1999), ("Fayiska", None, 4, 2001), ("brand1", 50.0, None, None), (None, 1.0, 1, 1)]

CHECKED = sorted(set(blocks.BLOCKS) | set(encoders.QUERIES) | {"dim_weighted_mean", "catalog_coverage", "copurchase_pairs", "tfidf_tokens", "category_sentence", "token_sequence", "store_counts", "category_top", "p5_found", "p5_sessions", "p6_features"})


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for name, few in (("some", False), ("none", True)):
        root = tmp_path_factory.mktemp(name)
        for t, rows, shape in (
            ("train_transactions", LINES, SHAPE), ("test_transactions", OTHERS, SHAPE), ("y_train", LABELS, "custid long, gender int"), ("brand_meta", META, "brd_nm string, target_age double, price_tier int, open_year int"),
            ("part_ref", [(1, "리빙 조명", "Living Lighting"), (2, "여성캐주얼", None), (137, None, None)], "part_id long, part_nm string, part_nm_en string"),
        ):
            spark.createDataFrame([] if few else rows, shape).coalesce(1).write.parquet(str(root / f"{t}.parquet"))
        out[name] = str(root)
    return out


@pytest.fixture(scope="module")
def oracle(folders):
    import duckdb

    con = duckdb.connect()
    for t in ("train_transactions", "test_transactions", "y_train", "brand_meta", "part_ref"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folders['some']}/{t}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_awkward_lines(name, spark, folders, oracle):
    assert_same(queries()[name](spark, folders["some"]), oracle, oracle_sql()[name])


@pytest.mark.parametrize("name", CHECKED)
def test_no_lines(name, spark, folders):
    assert queries()[name](spark, folders["none"]).count() == 0
