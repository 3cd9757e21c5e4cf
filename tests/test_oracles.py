"""Every core query with an oracle against DuckDB on the smallest tables; the others must give rows."""

import pytest

from tests.same import assert_same
from tidemark.plans import learning, registry

SQL = registry.oracle_sql()
ROWS_ONLY = sorted(set(registry.queries()) - set(SQL) - set(learning.QUERIES))


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(name, spark, data, duck):
    assert_same(registry.queries()[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows(name, spark, data):
    assert registry.queries()[name](spark, data).count() > 0


def test_every_name_is_a_query():
    assert set(SQL) <= set(registry.queries())
