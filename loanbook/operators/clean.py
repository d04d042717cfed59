"""Cleaning: trim, type, drop sentinels, derive columns.

Each step is one projection, so a whole clean is a narrow stage: no shuffle,
no Python, and unused columns are pruned away when the result is queried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanbook.config import DEFAULT, TapeConfig
from loanbook.functions.expressions import blank_to_null_sql, bucketize, integer_text, pct_even, rows, strip, to_number, to_number_sql

KEY_COLUMNS = ("loan_id", "credit_score", "ltv", "dti", "delinquency_status", "current_upb", "property_state")
SERIOUS_BUCKETS = ("90_DPD", "120_Plus_DPD", "REO_Acquired")
BALANCE_COLUMNS = ("current_ib_upb", "current_actual_upb", "current_deferred_upb")


def trim_blanks(df: DataFrame) -> DataFrame:
    """Trim every string column; empty text becomes NULL."""
    return df.selectExpr(*[f"{blank_to_null_sql(name)} AS `{name}`" if kind == "string" else f"`{name}`" for name, kind in df.dtypes])


def cast_numeric(df: DataFrame, cfg: TapeConfig = DEFAULT) -> DataFrame:
    """Type the numeric columns; text that is not a number becomes NULL."""
    numeric = set(cfg.numeric_names)
    return df.selectExpr(
        *[f"{to_number_sql(name)} AS `{name}`" if name in numeric and kind == "string" else f"`{name}`" for name, kind in df.dtypes])


def null_sentinels(df: DataFrame, cfg: TapeConfig = DEFAULT) -> DataFrame:
    """Replace "not available" codes by NULL. Runs after the cast."""

    def keep(name: str) -> str:
        return f"CASE WHEN NOT ({_is_sentinel(name, cfg)}) THEN `{name}` END AS `{name}`"

    return df.selectExpr(*[keep(name) if name in cfg.sentinels else f"`{name}`" for name in df.columns])


def _is_sentinel(name: str, cfg: TapeConfig) -> str:
    return f"`{name}` IN ({', '.join(f'{float(code)!r}D' for code in cfg.sentinels[name])})"


def derive_columns(df: DataFrame, cfg: TapeConfig = DEFAULT) -> DataFrame:
    """Add balance, vintage, delinquency bucket, bands and flags.

    A missing status is ``Unknown`` and, like every bucket other than
    ``Current``, counts as delinquent. The rate bands leave gaps
    (3.499 to 3.5 and so on); a rate in a gap is ``Unknown``.
    """
    balances = [F.col(c) for c in BALANCE_COLUMNS if c in df.columns]
    if len(balances) > 1:
        balance = F.coalesce(F.greatest(*balances), F.lit(0.0))
    else:
        balance = F.coalesce(*balances, F.lit(0.0))

    month_text = integer_text("orig_date")
    month = F.substring(month_text, 5, 2).try_cast("int")
    quarter = F.concat(
        F.substring(month_text, 1, 4), F.lit("Q"), (F.floor((month - 1) / F.lit(3.0)) + 1).cast("string")
    )

    status = strip("delinquency_status")
    bucket = F.when(status.isNull(), "Unknown")
    for code, label in cfg.dpd_labels.items():
        bucket = bucket.when(status == code, label)
    bucket = bucket.when(
        integer_text("delinquency_status").try_cast("double") >= cfg.dpd_severe_from, cfg.dpd_severe_label
    ).otherwise(cfg.dpd_default)

    with_buckets = df.select(
        "*",
        balance.alias("current_upb"),
        to_number(F.substring("orig_date", 1, 4)).alias("orig_year"),
        quarter.alias("orig_quarter"),
        bucket.alias("dpd_bucket"),
        bucketize("credit_score", cfg.credit_score_bands, truncate=True).alias("credit_score_band"),
        bucketize("ltv", cfg.ltv_buckets, truncate=True).alias("ltv_bucket"),
        bucketize("orig_interest_rate", cfg.rate_buckets, truncate=False).alias("rate_bucket"),
    )
    return with_buckets.select(
        "*",
        (F.col("dpd_bucket") != "Current").cast("int").alias("is_delinquent"),
        F.col("dpd_bucket").isin(*SERIOUS_BUCKETS).cast("int").alias("is_seriously_delinquent"),
    )


def clean(raw: DataFrame, cfg: TapeConfig = DEFAULT) -> DataFrame:
    """Raw text columns to the loan table."""
    return derive_columns(null_sentinels(cast_numeric(trim_blanks(raw), cfg), cfg), cfg)


LOST, REPLACED = "lost_casts", "replaced_sentinels"


def clean_with_marks(raw: DataFrame, cfg: TapeConfig = DEFAULT) -> DataFrame:
    """``clean``, and for each row the names, joined by commas, of the columns
    that lost a value in the cast and of those with a sentinel replaced. What a report
    on the cleaning needs thus comes with the rows, without another pass."""
    numeric = [c for c in cfg.numeric_names if c in raw.columns]
    had = [f"`{c}` IS NOT NULL AS `_had_{c}`" for c in numeric]
    typed = cast_numeric(trim_blanks(raw).selectExpr("*", *had), cfg)
    lost = [f"CASE WHEN `_had_{c}` AND `{c}` IS NULL THEN '{c}' END" for c in numeric]
    found = [f"CASE WHEN {_is_sentinel(c, cfg)} THEN '{c}' END" for c in cfg.sentinels if c in raw.columns]
    marked = typed.selectExpr(
        *[f"`{c}`" for c in raw.columns], f"concat_ws(',', {', '.join(lost)}) AS {LOST}", f"concat_ws(',', {', '.join(found)}) AS {REPLACED}")
    return derive_columns(null_sentinels(marked, cfg), cfg)


def mark_counts(marked: DataFrame, mark: str, into: str) -> DataFrame:
    """Rows per file and marked column."""
    named = marked.filter(F.col(mark) != "").select("file", F.explode(F.split(mark, ",")).alias("column_name"))
    return named.groupBy("file", "column_name").agg(F.count(F.lit(1)).alias(into))


# -- reports on the cleaning ---------------------------------------------------


def _per(df: DataFrame, by: str | None, values: Sequence[Column]) -> tuple[DataFrame, dict[str, Column]]:
    """One row in all, or one per value of ``by``, and the key to repeat."""
    return (df.groupBy(by).agg(*values), {by: F.col(by)}) if by else (df.agg(*values), {})


def cast_failures(raw: DataFrame, cfg: TapeConfig = DEFAULT, by: str | None = None) -> DataFrame:
    """Per numeric column, values present before the cast and missing after,
    for each file when ``by`` names it. Columns without failures are left out."""
    names = [c for c in cfg.numeric_names if c in raw.columns]
    trimmed = trim_blanks(raw.select(*([by] if by else []), *names))
    one, key = _per(trimmed, by, [F.count_if(F.col(c).isNotNull() & to_number(c).isNull()).alias(c) for c in names])
    return rows(one, [{**key, "column_name": F.lit(c), "failures": F.col(c)} for c in names]).filter("failures > 0")


def sentinel_counts(typed: DataFrame, cfg: TapeConfig = DEFAULT, by: str | None = None) -> DataFrame:
    """Per column, how many sentinel codes would be replaced, for each file
    when ``by`` names it."""
    names = [c for c in cfg.sentinels if c in typed.columns]
    one, key = _per(typed, by, [F.count_if(F.col(c).isin([float(code) for code in cfg.sentinels[c]])).alias(c) for c in names])
    return rows(one, [{**key, "column_name": F.lit(c), "replaced": F.col(c)} for c in names]).filter("replaced > 0")


def null_rates(cleaned: DataFrame, columns: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """Row count and NULL share of the key columns, in one pass."""
    names = [c for c in columns if c in cleaned.columns]
    one = cleaned.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names]
    )
    return rows(
        one,
        [
            {
                "column_name": F.lit(c),
                "rows_out": F.col("_rows"),
                "null_pct": pct_even(F.col(c), F.col("_rows"), 2),
            }
            for c in names
        ],
    )
