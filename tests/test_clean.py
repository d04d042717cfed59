from pyspark.sql import functions as F

from loanbook.config import DEFAULT
from loanbook.functions.expressions import bucketize, integer_text, rnd, rnd_even, to_number
from loanbook.operators.clean import cast_failures, clean, null_rates, sentinel_counts, cast_numeric, trim_blanks


def raw(spark, *rows):
    """Raw tape rows: given fields as text, all others empty."""
    names = DEFAULT.names
    return spark.createDataFrame([[row.get(n, "") for n in names] for row in rows], DEFAULT.raw_schema)


def column(df, name):
    return [r[name] for r in df.select(name).collect()]


def test_numbers_are_plain_numbers(spark):
    texts = ["751", " 1", "1d", "nan", "abc", "1_000", "-5.25", ".5", "5.", "+2", "1e3", "1E-2", "0x10", "inf", "-Infinity", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(to_number("t")).collect()]
    inf = float("inf")
    assert got == [751.0, None, None, None, None, None, -5.25, 0.5, 5.0, 2.0, 1000.0, 0.01, None, inf, -inf, None, None]


def test_credit_score_edge_cases(spark):
    scores = ["9999", "0", "abc", "1d", "nan", " 700 "]
    df = raw(spark, *[{"loan_id": str(i), "credit_score": s} for i, s in enumerate(scores)])
    assert column(clean(df), "credit_score") == [None, None, None, None, None, 700.0]
    assert [tuple(r) for r in cast_failures(df).collect()] == [("credit_score", 3)]
    typed = cast_numeric(trim_blanks(df))
    assert [tuple(r) for r in sentinel_counts(typed).collect()] == [("credit_score", 2)]


def test_delinquency_buckets(spark):
    codes = ["00", "01", "02", "03", "04", "0", "1", "RA", "F", "", " 05 ", "12", "99999999999"]
    out = clean(raw(spark, *[{"delinquency_status": c} for c in codes]))
    assert column(out, "dpd_bucket") == [
        "Current", "30_DPD", "60_DPD", "90_DPD", "120_Plus_DPD", "Other", "Other", "REO_Acquired",
        "Other", "Unknown", "120_Plus_DPD", "120_Plus_DPD", "120_Plus_DPD",
    ]
    assert column(out, "is_delinquent") == [0] + [1] * 12
    assert column(out, "is_seriously_delinquent") == [0, 0, 0, 1, 1, 0, 0, 1, 0, 0, 1, 1, 1]


def test_quarters_and_years(spark):
    dates = ["201613", "201600", "2016", "", "201601", "201612", "20165", "2016ab"]
    out = clean(raw(spark, *[{"orig_date": d} for d in dates]))
    assert column(out, "orig_quarter") == ["2016Q5", "2016Q0", None, None, "2016Q1", "2016Q4", "2016Q2", None]
    assert column(out, "orig_year") == [2016.0, 2016.0, 2016.0, None, 2016.0, 2016.0, 2016.0, 2016.0]


def test_bands(spark):
    scores = ["619", "620", "779.9", "780", "9998", "-1"]
    assert column(clean(raw(spark, *[{"credit_score": s} for s in scores])), "credit_score_band") == [
        "Subprime (<620)", "Fair (620-679)", "Very Good (720-779)", "Excellent (780+)", "Excellent (780+)", "Unknown",
    ]
    rates = ["3.4995", "3.499", "3.5", "6.5", ""]
    assert column(clean(raw(spark, *[{"orig_interest_rate": r} for r in rates])), "rate_bucket") == [
        "Unknown", "Below 3.5%", "3.5% - 4.5%", "6.5%+", "Unknown",
    ]


def test_truncated_bands_cover_the_integer_part(spark):
    values = [-1.0, -0.5, 0.0, 60.9, 61.0, 999.9, 1000.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(bucketize("v", DEFAULT.ltv_buckets, truncate=True)).collect()]
    assert got == ["Unknown", "Low (<=60)", "Low (<=60)", "Low (<=60)", "Medium (61-80)", "Very High (>90)", "Unknown"]


def test_balance(spark):
    out = clean(raw(spark, {}, {"current_ib_upb": "-7"}, {"current_ib_upb": "1", "current_deferred_upb": "3"}))
    assert column(out, "current_upb") == [0.0, -7.0, 3.0]


def test_null_rates(spark):
    out = clean(raw(spark, {"loan_id": "a"}, {"loan_id": "b", "ltv": "80"}, {"ltv": "70"}))
    got = {r["column_name"]: (r["rows_out"], r["null_pct"]) for r in null_rates(out).collect()}
    assert got["loan_id"] == (3, 33.33) and got["ltv"] == (3, 33.33) and got["current_upb"] == (3, 0.0)


def test_integer_text(spark):
    texts = ["007", "+5", "-07", "1_0", "0", "4.0", "x", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(integer_text("t")).collect()]
    assert got == ["7", "5", "-7", "10", "0", None, None, None]


def test_rounding_rules(spark):
    df = spark.range(1).select(
        rnd(F.lit(0.285), 2), rnd(F.lit(1.005), 2), rnd(F.lit(2.5)), rnd_even(F.lit(2.5)), rnd_even(F.lit(0.125), 2)
    )
    assert list(df.first()) == [0.28, 1.0, 3.0, 2.0, 0.12]
