"""Every query with SQL agrees with DuckDB; every other one returns rows."""

import pytest

import __spark_entry__ as contract
from tests.conftest import SMALL
from tools.compare import difference, duck

SQL = contract.oracle_sql()
QUERIES = contract.queries()
# Trained models are exercised in test_models on a frame with a planted effect;
# the test tables at the smallest scale have too few delinquent loans.
MODELS = {
    "origination_regression", "origination_forest", "origination_boosting", "origination_importances",
    "behavioral_segments", "saved_model", "model_summary",
}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in SQL if n not in MODELS and not n.startswith("op")))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    result = con.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert difference(df.columns, rows, names, result.fetchall()) is None


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) - MODELS if n != "pipeline" and not n.startswith("op")))
def test_query_returns_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["from_bucket", "to_bucket", "transitions", "transition_pct"]
    assert df.count() == 25


