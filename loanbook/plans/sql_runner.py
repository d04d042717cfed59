"""Named tables and free SQL text over the loan table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from loanbook.operators import checks, portfolio, report

NAMED_QUERIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "data_quality": portfolio.null_profile,
    "portfolio_summary": portfolio.portfolio_summary,
    "delinquency_analysis": portfolio.delinquency_distribution,
    "roll_rates": portfolio.roll_rates,
    "risk_segmentation": portfolio.risk_segmentation,
    "prepayment_analysis": portfolio.paydown,
    "vintage_comparison": portfolio.vintage_comparison,
    "geographic_analysis": portfolio.geographic,
    "site_summary": portfolio.site_summary,
    "executive_summary": portfolio.executive_summary,
    "loan_detail": portfolio.loan_detail,
    "load_validation": checks.load_validation,
    "roll_matrix": report.roll_matrix,
}


def run_query(name: str, loans: DataFrame) -> DataFrame:
    """A table of the library by name."""
    if name not in NAMED_QUERIES:
        raise KeyError(f"unknown query {name!r}; known: {', '.join(sorted(NAMED_QUERIES))}")
    return NAMED_QUERIES[name](loans)


def run_sql(text: str, loans: DataFrame, view: str = "loans") -> DataFrame:
    """Spark SQL text over the loan table, visible under the name ``loans``."""
    loans.createOrReplaceTempView(view)
    return loans.sparkSession.sql(text.strip().rstrip(";"))


def run_sql_file(path: str, loans: DataFrame, view: str = "loans") -> DataFrame:
    """The text of a SQL file, read through Spark so any storage works."""
    spark = loans.sparkSession
    text = spark.read.text(path, wholetext=True).first()[0]
    return run_sql(text, loans, view)
