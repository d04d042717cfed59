"""Every text query with SQL agrees with DuckDB."""

import pytest

from loanbook.llm.queries import QUERIES, SQL
from tests.conftest import SMALL
from tools.compare import difference, duck


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    result = duck(SMALL).execute(SQL[name])
    assert difference(df.columns, rows, [c[0] for c in result.description], result.fetchall()) is None
