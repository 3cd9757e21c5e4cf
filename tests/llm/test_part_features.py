"""Every line with a part_nm counts for the part that was meant, or among those that name none."""

import unicodedata
from datetime import datetime

from tidemark.llm import queries

SALES = "line_id long, custid long, sales_datetime timestamp_ntz, part_nm string, net_amt long"


def test_spellings_count_for_their_part(spark, tmp_path):
    names = [("숙녀화장품", 3), ("Ladies Cosmetics", 3), ("가정용품", 7), ("Household Goods", 7)]
    part = {1: "숙녀화장품", 2: "LADIES cosmetics", 3: "Ｌａｄｉｅｓ Ｃｏｓｍｅｔｉｃｓ", 4: unicodedata.normalize("NFD", "숙녀화장품"), 5: "숙녀화장풍", 6: "숙녀화장품 3층", 7: "가정용품코너", 8: "qqqqqq", 9: " ", 10: None}
    rows = [(i, 1, datetime(2025, 3, 1), p, 10 * i) for i, p in part.items()] + [(5, 1, datetime(2025, 3, 1), part[5], 50)]
    spark.createDataFrame(rows, SALES).write.parquet(str(tmp_path / "train_transactions.parquet"))
    refs = [(i, *[n for n, k in names if k == i]) for i in (3, 7)]
    spark.createDataFrame(refs, "part_id long, part_nm string, part_nm_en string").write.parquet(str(tmp_path / "part_ref.parquet"))
    spark.createDataFrame([], "corner_id long, corner_nm string, corner_nm_en string").write.parquet(str(tmp_path / "corner_ref.parquet"))
    r = queries.p6_parts(spark, str(tmp_path)).first()
    assert (r.n, r.n_k3, r.total_k3, r.n_k7, r.n_k0, r.total_k0) == (10, 6, 210, 1, 1, 80)
    assert r.days_since_k3 == 0 and r.n_30_k3 == 6 and r.n_k1 == 0


def test_no_line_is_left_out(spark, data, duck):
    rows = queries.p6_parts(spark, data).toPandas()
    n, total = duck.execute(
        "SELECT count(*), sum(net_amt) FROM (SELECT DISTINCT line_id, net_amt FROM train_transactions WHERE custid IS NOT NULL AND regexp_replace(part_nm, '[\\s\\x{00a0}\\x{3000}]', '', 'g') <> '')"
    ).fetchone()
    kinds = range(138)
    assert rows[[f"n_k{k}" for k in kinds]].to_numpy().sum() == n
    assert rows[[f"total_k{k}" for k in kinds]].to_numpy().sum() == total
    assert (rows[[f"n_k{k}" for k in kinds]].sum(axis=1) <= rows["n"]).all() and rows["n_k0"].sum() > 0
