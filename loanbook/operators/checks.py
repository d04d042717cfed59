"""Quality gates: load validation and the data-quality report.

All counts that need no regrouping come from one aggregation; only duplicate
ids need a shuffle by loan, which repeated ids shrink on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanbook.config import DEFAULT, TapeConfig
from loanbook.functions.expressions import pct, pct_even, rank_of, rnd, rows
from loanbook.operators.portfolio import (
    DPD_ORDER,
    all_groups,
    as_year,
    balance,
    delinquency_rate,
    mean,
    mean_rate,
    n_loans,
)

# Plausible ranges of three columns.
VALUE_RANGES = {
    "credit_score": (300, 850),
    "ltv": (1, 200),
    "orig_interest_rate": (0.1, 15.0),
}
COMPLETENESS_COLUMNS = (
    "loan_id", "credit_score", "ltv", "dti", "current_upb", "delinquency_status",
    "property_state", "orig_interest_rate", "payment_history", "current_credit_score",
)
RANGE_WARN_PCT = 1.0
VALIDITY_WARN_PCT, VALIDITY_FAIL_PCT = 0.5, 2.0
CONSISTENCY_WARN_SHARE = 0.01
SHORT_HISTORY = 10


def _status(passed: Column, otherwise: str) -> Column:
    return F.when(passed, "PASS").otherwise(otherwise)


def _null(c: str) -> Column:
    return F.count_if(F.col(c).isNull())


def _outside(c: str, low: float, high: float) -> Column:
    return (F.col(c) < low) | (F.col(c) > high)


def _share(count: Column, total: Column, digits: int) -> Column:
    """Percent of all loans; an empty table gives 0."""
    return F.coalesce(pct_even(count, total, digits), F.lit(0.0))


def duplicate_ids(loans: DataFrame) -> DataFrame:
    """One row: ids that occur more than once, and the number of loans."""
    per_id = loans.groupBy("loan_id").agg(n_loans().alias("n"))
    return per_id.agg(
        F.count_if((F.col("n") > 1) & F.col("loan_id").isNotNull()).alias("duplicates"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )


# -- load validation -----------------------------------------------------------


def load_validation(loans: DataFrame, cfg: TapeConfig = DEFAULT) -> DataFrame:
    """One row per gate: ``check_name``, ``status``, measured ``value`` and a
    readable ``detail``."""
    null_limits = {**cfg.max_null_pct_critical, **cfg.max_null_pct_warning}
    null_limits.setdefault("current_upb", 2.0)
    known = [c for c in null_limits if c in loans.columns]
    ranged = [c for c in VALUE_RANGES if c in loans.columns]

    # Partial counts per vintage and pool roll up to every figure needed, the
    # number of vintages and of small pools included.
    cells = loans.groupBy("orig_year", "pool_prefix").agg(
        n_loans().alias("n"),
        *[_null(c).alias(f"null_{c}") for c in known],
        *[F.count_if(_outside(c, *VALUE_RANGES[c])).alias(f"range_{c}") for c in ranged],
    )
    sized = cells.withColumn("pool_size", F.sum("n").over(Window.partitionBy("pool_prefix")))
    small_pool = F.when(F.col("pool_size") < cfg.min_loans_per_pool, F.coalesce("pool_prefix", F.lit("")))
    one = sized.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count_distinct("orig_year").alias("vintages"),
        F.count_distinct(small_pool).alias("small_pools"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in [f"null_{c}" for c in known] + [f"range_{c}" for c in ranged]
        ],
    )
    total = F.col("total")

    def entry(name: str, status: Column, value: Column, detail: Column) -> dict[str, Column]:
        return {
            "check_name": F.lit(name),
            "status": status,
            "value": value.cast("double"),
            "detail": detail,
        }

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def number(c: Column) -> Column:
        return F.format_number(c, 0)

    entries = [
        entry("total_rows", _status(total > 0, "FAIL"), total, text(number(total), " loans loaded")),
    ]
    for c, limit in null_limits.items():
        if c not in known:
            entries.append(
                entry(f"null_{c}", F.lit("SKIP"), F.lit(None), F.lit(f"Column '{c}' not found in table"))
            )
            continue
        share = _share(F.col(f"null_{c}"), total, 2)
        worse = "FAIL" if c in cfg.max_null_pct_critical else "WARN"
        entries.append(
            entry(
                f"null_{c}", _status(share <= limit, worse), share,
                text(share.cast("string"), f"% null (threshold: {limit}%)"),
            )
        )
    for c in ranged:
        low, high = VALUE_RANGES[c]
        outside = F.col(f"range_{c}")
        share = _share(outside, total, 2)
        entries.append(
            entry(
                f"range_{c}", _status(share < RANGE_WARN_PCT, "WARN"), outside,
                text(number(outside), f" loans out of [{low}, {high}] (", share.cast("string"), "%)"),
            )
        )
    entries.append(
        entry(
            "vintage_coverage", _status(F.col("vintages") >= cfg.min_vintages, "WARN"), F.col("vintages"),
            text(F.col("vintages").cast("string"), " distinct origination years"),
        )
    )
    pools = F.col("small_pools")
    entries.append(
        entry(
            "small_pools", F.when(pools > 0, "WARN"), pools,
            text(pools.cast("string"), f" pool(s) have fewer than {cfg.min_loans_per_pool} loans"),
        )
    )
    duplicates = F.col("duplicates")
    duplicate_row = rows(
        duplicate_ids(loans),
        [
            entry(
                "duplicate_loan_ids",
                _status(duplicates <= cfg.max_duplicate_loan_ids, "WARN"),
                duplicates,
                text(number(duplicates), f" duplicate loan IDs (threshold: {cfg.max_duplicate_loan_ids})"),
            )
        ],
    )
    # The small-pool row exists only when there are small pools.
    return rows(one, entries).filter(F.col("status").isNotNull()).unionByName(duplicate_row)


def overall_status(checks: DataFrame) -> DataFrame:
    """FAIL if any check failed, else WARN if any warned, else PASS."""

    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return checks.agg(
        F.when(count("FAIL") > 0, "FAIL").when(count("WARN") > 0, "WARN").otherwise("PASS").alias("overall"),
        (count("FAIL") == 0).alias("passed"),
        count("PASS").alias("n_pass"),
        count("WARN").alias("n_warn"),
        count("FAIL").alias("n_fail"),
    )


def vintage_coverage(loans: DataFrame) -> DataFrame:
    """Summary per origination year."""
    return (
        loans.filter(F.col("orig_year").isNotNull())
        .groupBy("orig_year")
        .agg(
            n_loans().alias("loans"),
            balance().alias("total_upb"),
            delinquency_rate().alias("dlq_rate_pct"),
            mean("credit_score").alias("avg_fico"),
            mean_rate().alias("avg_rate"),
        )
        .orderBy("orig_year")
    )


def pool_sizes(loans: DataFrame, cfg: TapeConfig = DEFAULT) -> DataFrame:
    """Loans per pool and whether the pool is large enough."""
    return (
        loans.groupBy(F.col("pool_prefix").alias("pool"))
        .agg(n_loans().alias("loans"))
        .select("pool", "loans", _status(F.col("loans") >= cfg.min_loans_per_pool, "WARN").alias("status"))
        .orderBy(F.asc_nulls_last("pool"))
    )


def small_pools(loans: DataFrame, cfg: TapeConfig = DEFAULT) -> DataFrame:
    """Pools below the minimum size."""
    return pool_sizes(loans, cfg).filter(F.col("loans") < cfg.min_loans_per_pool).select("pool", "loans")


# -- data-quality report -------------------------------------------------------


def quality_summary(loans: DataFrame) -> DataFrame:
    """Loads at a glance. Distinct pools and states come from partial counts."""
    cells = loans.groupBy("pool_prefix", "property_state").agg(
        n_loans().alias("n"),
        F.sum("current_upb").alias("upb"),
        F.min("orig_year").alias("first_year"),
        F.max("orig_year").alias("last_year"),
    )
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_loans"),
        rnd(F.sum("upb")).alias("total_upb"),
        F.count_distinct("pool_prefix").alias("pools_loaded"),
        F.count_distinct("property_state").alias("states_covered"),
        F.min("first_year").cast("int").alias("earliest_vintage"),
        F.max("last_year").cast("int").alias("latest_vintage"),
    )


def completeness(loans: DataFrame, cfg: TapeConfig = DEFAULT) -> DataFrame:
    """NULL share of ten columns against their limits. Only NULL counts here;
    a zero balance is a value."""
    one = loans.agg(n_loans().alias("_rows"), *[_null(c).alias(c) for c in COMPLETENESS_COLUMNS])
    entries = []
    for c in COMPLETENESS_COLUMNS:
        limit = cfg.max_null_pct_critical.get(c, cfg.max_null_pct_warning.get(c, cfg.max_null_pct_default))
        worse = "FAIL" if c in cfg.max_null_pct_critical else "WARN"
        share = _share(F.col(c), F.col("_rows"), 3)
        entries.append(
            {
                "column_name": F.lit(c),
                "null_pct": share,
                "threshold": F.lit(float(limit)),
                "status": _status(share <= limit, worse),
            }
        )
    return rows(one, entries)


def _validity_rules() -> dict[str, Column]:
    state, history = F.col("property_state"), F.col("payment_history")
    # The labels are part of the result.
    return {
        "Credit score outside 300–850": _outside("credit_score", *VALUE_RANGES["credit_score"]),
        "LTV outside 1–200": _outside("ltv", *VALUE_RANGES["ltv"]),
        "Interest rate outside 0.1–15%": _outside("orig_interest_rate", *VALUE_RANGES["orig_interest_rate"]),
        "Negative current UPB": F.col("current_upb") < 0,
        "Empty property state": state.isNull() | (F.length(F.trim(state)) == 0),
        "Payment history shorter than 10 chars": F.length(history) < SHORT_HISTORY,
    }


def validity(loans: DataFrame) -> DataFrame:
    """Loans that break each of six rules, in one pass."""
    rules = _validity_rules()
    one = loans.agg(n_loans().alias("_rows"), *[F.count_if(r).alias(f"r{i}") for i, r in enumerate(rules.values())])
    entries = []
    for i, label in enumerate(rules):
        share = _share(F.col(f"r{i}"), F.col("_rows"), 3)
        entries.append(
            {
                "check_name": F.lit(label),
                "violations": F.col(f"r{i}"),
                "pct": share,
                "status": F.when(share < VALIDITY_WARN_PCT, "PASS").when(share < VALIDITY_FAIL_PCT, "WARN").otherwise("FAIL"),
            }
        )
    return rows(one, entries)


def consistency(loans: DataFrame) -> DataFrame:
    """Balance above the original amount, repeated ids, missing age."""
    current, original = F.col("current_upb"), F.col("orig_loan_amount")
    one = loans.agg(
        n_loans().alias("_rows"),
        F.count_if(
            (current > original) & (original > 0) & (current > 0) & (F.col("dpd_bucket") == "Current")
        ).alias("above"),
        _null("loan_age").alias("no_age"),
    )

    def entry(label: str, count: str, total: str, status: Column, note: str) -> dict[str, Column]:
        return {
            "check_name": F.lit(label),
            "violations": F.col(count),
            "pct": _share(F.col(count), F.col(total), 3),
            "status": status,
            "note": F.lit(note),
        }

    def rare(count: str) -> Column:
        return _status(F.col(count) / F.nullif(F.col("_rows").cast("double"), F.lit(0.0)) < CONSISTENCY_WARN_SHARE, "WARN")

    # The labels are part of the result; the notes are not.
    counted = rows(
        one,
        [
            entry(
                "Current UPB exceeds original amount (performing loans)", "above", "_rows", rare("above"),
                "The balance can pass the original amount when missed interest is added to it by a modification",
            ),
            entry(
                "Missing loan_age", "no_age", "_rows", rare("no_age"),
                "Record-type tapes carry no loan age",
            ),
        ],
    )
    repeated = rows(
        duplicate_ids(loans),
        [entry("Duplicate loan IDs", "duplicates", "total", _status(F.col("duplicates") == 0, "FAIL"), "")],
    )
    return counted.unionByName(repeated)


def quality_status(loans: DataFrame, cfg: TapeConfig = DEFAULT) -> DataFrame:
    """Overall result of completeness, validity and consistency."""
    checks = (
        completeness(loans, cfg).select("status")
        .unionByName(validity(loans).select("status"))
        .unionByName(consistency(loans).select("status"))
    )
    return overall_status(checks)


def _distribution(grouped: DataFrame, key: str, digits: int) -> DataFrame:
    return grouped.withColumn("pct", pct(F.col("loans"), F.sum("loans").over(all_groups()), digits)).select(
        *[c for c in grouped.columns if c == key], "loans", "pct", *[c for c in grouped.columns if c.startswith("_")]
    )


def credit_distribution(loans: DataFrame) -> DataFrame:
    """Loans per known score band, in order of score."""
    grouped = (
        loans.filter(F.col("credit_score_band") != "Unknown")
        .groupBy(F.col("credit_score_band").alias("band"))
        .agg(n_loans().alias("loans"), F.min("credit_score").alias("_lowest"))
    )
    return _distribution(grouped, "band", 1).orderBy("_lowest").drop("_lowest")


def dpd_distribution(loans: DataFrame) -> DataFrame:
    """Loans per delinquency bucket; real estate owned and the rest tie last."""
    grouped = loans.groupBy(F.col("dpd_bucket").alias("bucket")).agg(n_loans().alias("loans"))
    return _distribution(grouped, "bucket", 2).orderBy(rank_of("bucket", DPD_ORDER[:5]), "bucket")


def vintage_distribution(loans: DataFrame) -> DataFrame:
    """Loans per origination year."""
    grouped = (
        loans.filter(F.col("orig_year").isNotNull())
        .groupBy(F.col("orig_year").alias("_year"))
        .agg(n_loans().alias("loans"))
        .select(as_year("_year").alias("year"), "loans")
    )
    return _distribution(grouped, "year", 1).orderBy("year")
