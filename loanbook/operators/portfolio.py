"""Portfolio tables: summaries, roll rates, segments, vintages, geography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loanbook.functions.expressions import pct, rank_of, rnd, rows, settled
from loanbook.functions.history import WINDOW_MONTHS, has_history, last_year, state_label

DPD_ORDER = ("Current", "30_DPD", "60_DPD", "90_DPD", "120_Plus_DPD", "REO_Acquired")
ROLL_STATES = ("Current", "30_DPD", "60_DPD", "90_DPD", "120_Plus")
PROFILE_COLUMNS = (
    "loan_id", "credit_score", "ltv", "dti", "current_upb", "delinquency_status",
    "property_state", "orig_interest_rate", "payment_history", "current_credit_score",
)


def all_groups() -> WindowSpec:
    """A window over every row of a grouped frame: one row per state, bucket
    or vintage, so a handful of rows."""
    return Window.partitionBy()


def n_loans() -> Column:
    return F.count(F.lit(1))


def balance(digits: int = 0, scale: float = 1.0) -> Column:
    total = F.sum("current_upb")
    return rnd(total if scale == 1.0 else total / F.lit(scale), digits)


def delinquency_rate(digits: int = 2) -> Column:
    return pct(F.sum("is_delinquent"), n_loans(), digits)


def serious_rate(digits: int = 2) -> Column:
    return pct(F.sum("is_seriously_delinquent"), n_loans(), digits)


def mean(column: str, digits: int = 0) -> Column:
    return rnd(F.avg(column), digits)


def mean_rate(digits: int = 3) -> Column:
    return rnd(settled(F.avg("orig_interest_rate")), digits)


def share_where(condition: Column, digits: int) -> Column:
    return pct(F.count_if(condition), n_loans(), digits)


def as_year(column: str = "orig_year") -> Column:
    return F.col(column).cast("int")


def null_profile(loans: DataFrame) -> DataFrame:
    """NULL share of ten columns in one pass; a zero balance counts as NULL."""

    def missing(c: str) -> Column:
        absent = F.col(c).isNull()
        return absent | (F.col(c) == 0) if c == "current_upb" else absent

    one = loans.agg(n_loans().alias("_rows"), *[F.count_if(missing(c)).alias(c) for c in PROFILE_COLUMNS])
    return rows(
        one,
        [
            {
                "column_name": F.lit(c),
                "null_pct": pct(F.col(c), F.col("_rows"), 3),
                "total_rows": F.col("_rows"),
            }
            for c in PROFILE_COLUMNS
        ],
    ).orderBy(F.desc("null_pct"), "column_name")


def _cells(loans: DataFrame, *keys: str) -> DataFrame:
    """Partial sums per low-cardinality key. Rolling these up gives distinct
    counts of the keys without expanding every loan row once per count."""
    return loans.groupBy(*keys).agg(
        n_loans().alias("n"),
        F.sum("current_upb").alias("upb"),
        F.sum("is_delinquent").alias("dlq"),
        F.sum("is_seriously_delinquent").alias("serious"),
        *[
            measure(c).alias(f"{c}_{kind}")
            for c in ("credit_score", "orig_interest_rate", "ltv")
            for kind, measure in (("sum", F.sum), ("n", F.count))
        ],
        F.min("orig_year").alias("first_year"),
        F.max("orig_year").alias("last_year"),
    )


def _rolled_mean(column: str, digits: int) -> Column:
    count = F.nullif(F.sum(f"{column}_n").cast("double"), F.lit(0.0))
    return rnd(settled(F.sum(f"{column}_sum") / count), digits)


def portfolio_summary(loans: DataFrame) -> DataFrame:
    """Thirteen headline figures."""
    return _cells(loans, "property_state", "pool_prefix").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_loans"),
        rnd(F.sum("upb")).alias("total_upb"),
        _rolled_mean("credit_score", 0).alias("avg_credit_score"),
        _rolled_mean("orig_interest_rate", 3).alias("avg_orig_rate"),
        _rolled_mean("ltv", 1).alias("avg_ltv"),
        pct(F.sum("dlq"), F.sum("n"), 2).alias("delinquency_rate_pct"),
        pct(F.sum("serious"), F.sum("n"), 2).alias("serious_dlq_rate_pct"),
        F.sum("dlq").alias("delinquent_loans"),
        F.sum("serious").alias("seriously_delinquent_loans"),
        F.min("first_year").alias("earliest_vintage"),
        F.max("last_year").alias("latest_vintage"),
        F.count_distinct("property_state").alias("states_covered"),
        F.count_distinct("pool_prefix").alias("pools_loaded"),
    )


def site_summary(loans: DataFrame) -> DataFrame:
    """Seven figures for a landing page; balance in billions."""
    return _cells(loans, "orig_year").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_loans"),
        rnd(F.sum("upb") / 1e9, 1).alias("upb_billions"),
        pct(F.sum("dlq"), F.sum("n"), 2).alias("dlq_rate"),
        pct(F.sum("serious"), F.sum("n"), 2).alias("serious_dlq"),
        _rolled_mean("credit_score", 0).alias("avg_fico"),
        _rolled_mean("orig_interest_rate", 2).alias("avg_rate"),
        F.count_distinct(as_year()).alias("vintage_count"),
    )


def executive_summary(loans: DataFrame) -> DataFrame:
    """Headline figures with the latest reporting period (text order)."""
    return loans.agg(
        n_loans().alias("total_loans"),
        balance().alias("total_upb"),
        delinquency_rate().alias("dlq_rate"),
        serious_rate().alias("serious_dlq_rate"),
        mean("credit_score").alias("avg_fico"),
        F.max("reporting_period").alias("reporting_period"),
    )


def delinquency_distribution(loans: DataFrame) -> DataFrame:
    """Loans and balance per delinquency bucket, with the share of all loans."""
    grouped = loans.groupBy("dpd_bucket").agg(n_loans().alias("loans"), balance().alias("total_upb"))
    return grouped.select(
        "dpd_bucket",
        "loans",
        "total_upb",
        pct(F.col("loans"), F.sum("loans").over(all_groups()), 2).alias("pct_of_portfolio"),
    ).orderBy(rank_of("dpd_bucket", DPD_ORDER), "dpd_bucket")


def roll_rates(loans: DataFrame) -> DataFrame:
    """Month-to-month moves between delinquency states over the last year.

    The year of a loan is unfolded into its eleven month pairs in the map
    stage, where they are counted into at most a hundred pairs; nothing else
    is shuffled, whatever the histories.
    """
    history = F.col("payment_history")
    months = F.sequence(F.lit(1), F.lit(WINDOW_MONTHS - 1))
    year = loans.filter(has_history(history)).select(last_year(history).alias("pattern"))
    pairs = year.select("pattern", F.explode(months).alias("month")).select(
        F.substring("pattern", F.col("month"), F.lit(1)).alias("was"),
        F.substring("pattern", F.col("month") + 1, F.lit(1)).alias("became"),
    )
    known = pairs.filter(F.col("was").between("0", "9") & F.col("became").between("0", "9"))
    moves = (
        known.groupBy("was", "became")
        .agg(n_loans().alias("n"))
        .groupBy(state_label(F.col("was")).alias("from_bucket"), state_label(F.col("became")).alias("to_bucket"))
        .agg(F.sum("n").alias("transitions"))
    )
    leaving = F.sum("transitions").over(Window.partitionBy("from_bucket"))
    return moves.select(
        "from_bucket",
        "to_bucket",
        "transitions",
        pct(F.col("transitions"), leaving, 2).alias("transition_pct"),
    ).orderBy(rank_of("from_bucket", ROLL_STATES), rank_of("to_bucket", ROLL_STATES))


def risk_segmentation(loans: DataFrame, min_loans: int = 20) -> DataFrame:
    """Delinquency and exposure per score band, LTV, rate and vintage."""
    return (
        loans.filter(
            (F.col("credit_score_band") != "Unknown")
            & (F.col("ltv_bucket") != "Unknown")
            & F.col("orig_year").isNotNull()
        )
        .groupBy("credit_score_band", "ltv_bucket", "rate_bucket", F.col("orig_year").alias("_year"))
        .agg(
            n_loans().alias("loans"),
            balance().alias("total_upb"),
            delinquency_rate().alias("dlq_rate_pct"),
            serious_rate().alias("serious_dlq_pct"),
            mean("credit_score").alias("avg_fico"),
            mean_rate().alias("avg_rate"),
            mean("loan_age").alias("avg_loan_age"),
        )
        .filter(F.col("loans") >= min_loans)
        .select(
            "credit_score_band", "ltv_bucket", "rate_bucket", as_year("_year").alias("orig_year"),
            "loans", "total_upb", "dlq_rate_pct", "serious_dlq_pct", "avg_fico", "avg_rate", "avg_loan_age",
        )
        .orderBy(F.desc("dlq_rate_pct"), "credit_score_band", "ltv_bucket", "rate_bucket", "orig_year")
    )


def paydown(loans: DataFrame) -> DataFrame:
    """Principal repaid since origination, per vintage and rate bucket."""
    original, current = F.sum("orig_loan_amount"), F.sum("current_upb")
    return (
        loans.filter(F.col("orig_year").isNotNull() & (F.col("orig_loan_amount") > 0) & (F.col("current_upb") >= 0))
        .groupBy(F.col("orig_year").alias("_year"), "rate_bucket")
        .agg(
            n_loans().alias("loans"),
            rnd(original).alias("total_orig_amount"),
            rnd(current).alias("total_current_upb"),
            rnd(original - current).alias("total_paydown"),
            pct(original - current, original, 2).alias("paydown_pct"),
            mean("loan_age").alias("avg_loan_age_months"),
            mean_rate().alias("avg_rate"),
        )
        .withColumn("orig_year", as_year("_year"))
        .drop("_year")
        .select(
            "orig_year", "rate_bucket", "loans", "total_orig_amount", "total_current_upb", "total_paydown",
            "paydown_pct", "avg_loan_age_months", "avg_rate",
        )
        .orderBy("orig_year", "rate_bucket")
    )


def vintage_comparison(loans: DataFrame) -> DataFrame:
    """Fifteen measures per origination year."""
    bucket, band = F.col("dpd_bucket"), F.col("credit_score_band")
    return (
        loans.filter(F.col("orig_year").isNotNull())
        .groupBy(F.col("orig_year").alias("_year"))
        .agg(
            n_loans().alias("loans"),
            balance(2, 1e9).alias("upb_billions"),
            delinquency_rate().alias("dlq_rate_pct"),
            serious_rate().alias("serious_dlq_pct"),
            mean("credit_score").alias("avg_fico"),
            mean_rate().alias("avg_rate"),
            mean("ltv", 1).alias("avg_ltv"),
            mean("loan_age").alias("avg_loan_age"),
            share_where(bucket == "30_DPD", 2).alias("pct_30dpd"),
            share_where(bucket == "60_DPD", 2).alias("pct_60dpd"),
            share_where(bucket == "90_DPD", 2).alias("pct_90dpd"),
            share_where(bucket == "120_Plus_DPD", 2).alias("pct_120plus"),
            share_where(band == "Excellent (780+)", 1).alias("pct_excellent"),
            share_where(band == "Fair (620-679)", 1).alias("pct_fair"),
        )
        .select(as_year("_year").alias("orig_year"), "*")
        .drop("_year")
        .orderBy("orig_year")
    )


def state_table(loans: DataFrame) -> DataFrame:
    """Performance per state with its shares, next to the delinquency rate of
    the whole portfolio (``avg_dlq``, which includes loans without a state)."""
    upb = F.sum("current_upb")
    grouped = loans.groupBy("property_state").agg(
        n_loans().alias("loans"),
        upb.alias("_upb"),
        F.sum("is_delinquent").alias("_dlq"),
        balance(3, 1e9).alias("upb_billions"),
        delinquency_rate().alias("dlq_rate_pct"),
        serious_rate().alias("serious_dlq_pct"),
        mean("credit_score").alias("avg_fico"),
        mean_rate().alias("avg_rate"),
        mean("ltv", 1).alias("avg_ltv"),
    )
    known = F.col("property_state").isNotNull()

    def total(c: str) -> Column:
        return F.sum(F.when(known, F.col(c))).over(all_groups())

    shared = grouped.select(
        "*",
        pct(F.col("loans"), total("loans"), 2).alias("pct_of_portfolio"),
        pct(F.col("_upb"), total("_upb"), 2).alias("pct_of_upb"),
        pct(F.sum("_dlq").over(all_groups()), F.sum("loans").over(all_groups()), 2).alias("avg_dlq"),
    )
    return shared.filter(known).drop("_upb", "_dlq")


def geographic(loans: DataFrame) -> DataFrame:
    """Performance per state with its share of loans and of balance."""
    return state_table(loans).drop("avg_dlq").orderBy(F.desc("dlq_rate_pct"), "property_state")


DETAIL_COLUMNS = (
    "loan_id", "pool_prefix", "orig_year", "orig_quarter", "property_state", "credit_score",
    "credit_score_band", "ltv", "ltv_bucket", "dti", "orig_interest_rate", "rate_bucket",
    "orig_loan_amount", "current_upb", "loan_age", "channel", "property_type", "occupancy_status",
    "loan_purpose", "num_borrowers", "first_time_homebuyer", "dpd_bucket", "delinquency_status",
    "is_delinquent", "is_seriously_delinquent", "current_credit_score", "servicer_name", "payment_history",
)


def loan_detail(loans: DataFrame) -> DataFrame:
    """Loan-level extract for ad-hoc analysis: 28 columns."""
    return loans.select(
        *[as_year(c).alias(c) if c == "orig_year" else F.col(c) for c in DETAIL_COLUMNS]
    )


def filter_loans(
    loans: DataFrame,
    year: int | None = None,
    state: str | None = None,
    band: str | None = None,
    property_type: str | None = None,
) -> DataFrame:
    """Optional dashboard filters; put in front of any other operator."""
    for column, wanted in (
        ("orig_year", None if year is None else float(year)),
        ("property_state", state),
        ("credit_score_band", band),
        ("property_type", property_type),
    ):
        if wanted is not None:
            loans = loans.filter(F.col(column) == wanted)
    return loans
