"""Totals that must hold on any portfolio, and the shape of the plans."""

import pytest
from pyspark.sql import functions as F

from loanbook.functions.ordered import shared_folder
from loanbook.operators import checks, portfolio, report
from loanbook.plans import sql_runner
from loanbook.sinks import export, store
from loanbook.sources.testtables import loans as derive
from tests.conftest import SMALL


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_buckets_sum_to_the_portfolio(loans):
    summary = portfolio.portfolio_summary(loans).first()
    buckets = {r["dpd_bucket"]: r["loans"] for r in portfolio.delinquency_distribution(loans).collect()}
    assert sum(buckets.values()) == summary["total_loans"]
    assert summary["total_loans"] - buckets["Current"] == summary["delinquent_loans"]
    serious = sum(buckets.get(b, 0) for b in ("90_DPD", "120_Plus_DPD", "REO_Acquired"))
    assert serious == summary["seriously_delinquent_loans"]


def test_roll_rates_sum_to_one_hundred(loans):
    rates = portfolio.roll_rates(loans)
    for row in rates.groupBy("from_bucket").agg(F.sum("transition_pct").alias("s")).collect():
        assert row["s"] == pytest.approx(100, abs=0.05)
    matrix = report.roll_matrix(loans)
    assert matrix.count() == rates.select("from_bucket").distinct().count()


def test_roll_rates_equal_a_loop(loans):
    states = ["Current", "30_DPD", "60_DPD", "90_DPD"] + ["120_Plus"] * 6
    moves = {}
    for (history,) in loans.select("payment_history").collect():
        if history is None or len(history) < 48:
            continue
        for a, b in zip(history[36:47], history[37:48]):
            if a.isdigit() and b.isdigit():
                key = states[int(a)], states[int(b)]
                moves[key] = moves.get(key, 0) + 1
    got = {(r["from_bucket"], r["to_bucket"]): r["transitions"] for r in portfolio.roll_rates(loans).collect()}
    assert got == moves


def test_shares_sum_to_one_hundred(loans):
    geo = portfolio.geographic(loans).agg(F.sum("pct_of_portfolio"), F.sum("pct_of_upb")).first()
    assert geo[0] == pytest.approx(100, abs=0.2) and geo[1] == pytest.approx(100, abs=0.2)


def test_empty_portfolio(loans):
    none = loans.filter("1 = 0")
    gates = {r["check_name"]: r["status"] for r in checks.load_validation(none).collect()}
    assert gates["total_rows"] == "FAIL" and gates["null_loan_id"] == "PASS"
    assert portfolio.portfolio_summary(none).first()["total_loans"] == 0
    assert checks.quality_status(none).count() == 1
    assert report.vintage_extremes(none).first()["worst_year"] is None


def test_missing_column_is_skipped(loans):
    gates = {r["check_name"]: r["status"] for r in checks.load_validation(loans.drop("ltv")).collect()}
    assert gates["null_ltv"] == "SKIP" and "range_ltv" not in gates


def test_duplicate_ids(loans):
    twice = loans.unionByName(loans.limit(3))
    gates = {r["check_name"]: r for r in checks.load_validation(twice).collect()}
    assert (gates["duplicate_loan_ids"]["value"], gates["duplicate_loan_ids"]["status"]) == (3.0, "WARN")
    assert {r["check_name"]: r["status"] for r in checks.consistency(twice).collect()}["Duplicate loan IDs"] == "FAIL"


def test_running_table_size(spark):
    counts = spark.createDataFrame(
        [("a", "P", 10), ("b", "Q", 5), ("b", None, 2), ("c", "P", 4), ("d", None, 1)], "file string, pool_prefix string, loans long"
    )
    existing = spark.createDataFrame([("P", 7), ("Z", 100)], "pool_prefix string, loans long")
    plain = {r["file"]: r["total_in_table"] for r in store.running_table_size(counts).collect()}
    assert plain == {"a": 10, "b": 17, "c": 11, "d": 12}
    grown = {r["file"]: r["total_in_table"] for r in store.running_table_size(counts, existing).collect()}
    assert grown == {"a": 110, "b": 117, "c": 111, "d": 112}


def test_exports(spark, loans, tmp_path):
    folder = str(tmp_path / "out")
    assert len(export.export_dashboard(loans, folder)) == 7
    segments = spark.range(1, 41).select(F.col("id").alias("position"), F.lit("x").alias("band"))
    assert "risk_segments" in export.export_page(loans, folder + "/page", segments)
    assert spark.read.json(folder + "/page/risk_segments").count() == 30
    assert spark.read.option("header", True).csv(folder + "/loans_detail").count() == loans.count()
    assert len(spark.read.option("header", True).csv(folder + "/loans_detail").columns) == 28


def test_sql_text_and_named_queries(spark, loans, tmp_path):
    by_text = sql_runner.run_sql("SELECT count(*) AS n FROM loans;", loans).first()["n"]
    assert by_text == loans.count()
    path = tmp_path / "q.sql"
    path.write_text("-- total\nSELECT sum(current_upb) AS upb\nFROM loans\n")
    assert sql_runner.run_sql_file(str(path), loans).first()["upb"] > 0
    assert sql_runner.run_query("roll_rates", loans).count() == 25
    with pytest.raises(KeyError):
        sql_runner.run_query("nope", loans)


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_plans_stay_in_the_engine(spark):
    table = derive(spark, SMALL)
    for build in (portfolio.roll_rates, portfolio.vintage_comparison, checks.completeness, checks.validity, portfolio.geographic):
        text = plan(build(table))
        assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    # One scan of the orders, whatever the number of checks.
    for build in (portfolio.null_profile, checks.completeness, checks.validity):
        assert plan(build(table)).count("/orders.parquet]") == 1
    assert plan(checks.load_validation(table)).count("/orders.parquet]") <= 2


def test_stored_table_is_pruned(spark, loans, tmp_path):
    path = str(tmp_path / "loans")
    store.replace_pools(loans, path)
    table = store.read_loans(spark, path)
    text = plan(portfolio.delinquency_distribution(table.filter("pool_prefix = '95DNA1'")))
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "PartitionFilters: [isnotnull(pool_prefix" in text
    assert "dpd_bucket" in schema and "payment_history" not in schema
    text = plan(portfolio.paydown(table))
    assert "GreaterThan(orig_loan_amount,0.0)" in text


def test_filters_narrow_the_portfolio(loans):
    whole, part = loans.count(), portfolio.filter_loans(loans, year=1998, state="NATION_2").count()
    assert 0 < part < whole
