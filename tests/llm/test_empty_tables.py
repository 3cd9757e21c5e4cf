"""Every query of the package over tables without rows."""

import pytest

from tidemark.llm import queries

SALES = "line_id long, custid long, sales_datetime timestamp_ntz, goodcd string, brd_nm string, corner_nm string, part_nm string, net_amt long"
TABLES = {
    "train_transactions": SALES,
    "y_train": "custid long, gender int",
    "custid_links": "id_a string, id_b string",
    "part_ref": "part_id long, part_nm string, part_nm_en string",
    "corner_ref": "corner_id long, corner_nm string, corner_nm_en string",
    "documents": "doc_id long, text string",
    "eval_items": "item_id long, text string",
}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for t, shape in TABLES.items():
        spark.createDataFrame([], shape).write.parquet(str(root / f"{t}.parquet"))
    return str(root)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_rows(name, spark, empty):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p1_splits", "p2_found", "p3_percentiles", "p4_found"])
def test_nothing_known(name, spark, empty, tmp_path):
    rows = spark.createDataFrame([(None,) * 8, (1,) + (None,) * 7], SALES)
    for t, shape in TABLES.items():
        df = rows if t == "train_transactions" else spark.createDataFrame([(None,) * len(shape.split(","))], shape)
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == (2 if name == "p1_splits" else 0)
