"""The package's queries on the smallest tables: against DuckDB where they have SQL, else by properties."""

import pytest

from tests.same import assert_same
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracle(name, spark, data, duck):
    assert_same(queries.QUERIES[name](spark, data), duck, queries.SQL[name])


def test_every_line_has_one_split_and_linked_customers_share_it(spark, data, duck):
    rows = queries.p1_splits(spark, data).toPandas()
    assert len(rows) == duck.execute("SELECT count(*) FROM train_transactions").fetchone()[0]
    assert rows["split"].notna().all()
    known = rows.dropna(subset=["custid"])
    assert known.groupby("custid")["split"].nunique().max() == 1
    groups = queries.p1_found(spark, data).toPandas()
    both = known.drop_duplicates("custid").merge(groups, on="custid")
    assert both.empty or both.groupby("group_custid")["split"].nunique().max() == 1


def test_every_typed_value_has_an_entry_or_none(spark, data, duck):
    rows = queries.p2_found(spark, data).toPandas()
    for field, ref in (("part_nm", "part_ref"), ("corner_nm", "corner_ref")):
        want = duck.execute(
            f"SELECT count(DISTINCT line_id) FROM train_transactions WHERE {field} IS NOT NULL AND regexp_replace({field}, '[\\s\\x{{00a0}}\\x{{3000}}]', '', 'g') <> '' AND {field} NOT IN (SELECT {field} FROM {ref})"
        ).fetchone()[0]
        own = rows[rows["field_nm"] == field]
        assert len(own) == want == own["line_id"].nunique()
        ids = {r[0] for r in duck.execute(f"SELECT {ref[:-4]}_id FROM {ref}").fetchall()} | {-1}
        assert set(own["ref_id"]) <= ids
    none = queries.p2_unmatched(spark, data).toPandas()
    assert (none["n_rows"] > 0).all()


def test_merged_days_hold_the_exact_values(spark, data):
    exact = {(r.custid, r.q): r.value for r in queries.p3_percentiles(spark, data).collect()}
    merged = queries.p3_merged(spark, data).collect()
    assert len(merged) == len(exact)
    for r in merged:
        x = exact[r.custid, r.q]
        assert r.low <= x <= r.high and abs(r.value - x) <= 2**-12 * abs(x)


def test_all_documents_are_packed(spark, data, duck):
    rows = queries.p7_packed(spark, data).toPandas()
    assert set(rows["doc_id"]) == {r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall()}
    full = rows[rows["container"] >= 0].groupby("container")["n_tokens"].sum()
    assert full.max() <= 2048 and full.sum() / (2048 * len(full)) > 0.95


def test_found_documents_exist(spark, data, duck):
    docs = {r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall()}
    leaks = queries.p8_found(spark, data).toPandas()
    assert set(leaks["doc_id"]) <= docs and not leaks.duplicated().any()
    pages = queries.p9_found(spark, data).toPandas()
    assert set(pages["doc_id"]) <= docs and not pages.duplicated().any()
