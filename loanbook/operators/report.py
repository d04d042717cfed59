"""Tables behind the executive report and the dashboard views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanbook.functions.expressions import one_digit, pct, rank_of, rnd, rnd_even, rows, settled
from loanbook.functions.history import has_history, last_year
from loanbook.functions.ordered import staged
from loanbook.operators import portfolio as P
from loanbook.operators.portfolio import DPD_ORDER, ROLL_STATES, all_groups, as_year, delinquency_rate, mean, n_loans

SIGNIFICANT_VINTAGE = 1000
SIGNIFICANT_STATE = 500
HOTSPOT_COUNT = 12
SEGMENT_COUNT = 15

# Chart colour per delinquency bucket.
BUCKET_COLOURS = {
    "Current": "#27ae60",
    "30_DPD": "#f39c12",
    "60_DPD": "#e67e22",
    "90_DPD": "#e74c3c",
    "120_Plus_DPD": "#c0392b",
    "REO_Acquired": "#7d3c98",
}
OTHER_COLOUR = "#95a5a6"

# What a model feature means to a reader.
FEATURE_NOTES = {
    "credit_score": "Lower FICO scores strongly predict higher delinquency risk",
    "num_borrowers": "Single-borrower loans carry more risk than co-borrower loans",
    "orig_interest_rate": "Higher rates mean higher monthly payments and more payment stress",
    "dti": "Higher debt-to-income ratios indicate the borrower is financially stretched",
    "loan_age": "Loan seasoning affects risk — newer and very old loans behave differently",
    "ltv": "Higher LTV means less borrower equity and more risk of underwater default",
    "orig_loan_amount": "Larger loans have higher absolute exposure per delinquency",
    "credit_score_band_Fair (620-679)": "Fair credit borrowers default at 4-5x the rate of Excellent",
    "credit_score_band_Good (680-719)": "Good credit borrowers show moderate elevated risk",
    "credit_score_band_Subprime (<620)": "Subprime borrowers have the highest baseline delinquency",
    "ltv_bucket_Medium (61-80)": "Medium LTV loans represent the bulk of the portfolio",
    "ltv_bucket_Very High (>90)": "Very high LTV borrowers have minimal equity cushion",
    "rate_bucket_Below 3.5%": "Low-rate loans have affordable payments — lower risk",
    "rate_bucket_5.5% - 6.5%": "Higher-rate environment correlates with payment stress",
    "rate_bucket_6.5%+": "Highest rate bucket shows elevated delinquency across all vintages",
    "rate_bucket_4.5% - 5.5%": "Mid-range rates with moderate payment burden",
}
DEFAULT_NOTE = "Contributes to risk assessment"

# State and territory names.
STATE_NAMES = {
    "AK": "Alaska", "AL": "Alabama", "AR": "Arkansas", "AZ": "Arizona", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DC": "District of Columbia", "DE": "Delaware",
    "FL": "Florida", "GA": "Georgia", "GU": "Guam", "HI": "Hawaii", "IA": "Iowa", "ID": "Idaho",
    "IL": "Illinois", "IN": "Indiana", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana",
    "MA": "Massachusetts", "MD": "Maryland", "ME": "Maine", "MI": "Michigan", "MN": "Minnesota",
    "MO": "Missouri", "MS": "Mississippi", "MT": "Montana", "NC": "North Carolina",
    "ND": "North Dakota", "NE": "Nebraska", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NV": "Nevada", "NY": "New York", "OH": "Ohio", "OK": "Oklahoma",
    "OR": "Oregon", "PA": "Pennsylvania", "PR": "Puerto Rico", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah",
    "VA": "Virginia", "VI": "U.S. Virgin Islands", "VT": "Vermont", "WA": "Washington",
    "WI": "Wisconsin", "WV": "West Virginia", "WY": "Wyoming",
}

# Origination eras of the seasoning curve: first year, last year, label.
VINTAGE_ERAS = ((2014, 2016, "2014-2016"), (2017, 2019, "2017-2019"), (2020, 2021, "2020-2021"), (2022, 9999, "2022+"))


def _lookup(c: Column | str, table: dict[str, str], default: Column | None = None) -> Column:
    """A constant map as an expression: no join for a few dozen entries."""
    value = F.col(c) if isinstance(c, str) else c
    found = F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)
    return found if default is None else F.coalesce(found, default)


def _with_portfolio_rate(grouped: DataFrame) -> DataFrame:
    """Add the rounded delinquency rate of the whole portfolio to grouped
    counts ``loans`` and ``dlq``. The groups must cover every loan."""
    overall = pct(F.sum("dlq").over(all_groups()), F.sum("loans").over(all_groups()), 2)
    return grouped.withColumn("avg_dlq", overall)


# -- cells -----------------------------------------------------------------------

# What report tables can be filtered by and are grouped by.
CELL_KEYS = ("orig_year", "property_state", "credit_score_band", "property_type")


def cells(loans: DataFrame) -> DataFrame:
    """Sums per vintage, state, score band and property type, in one scan.

    Sums merge, so rates, vintages, states and the cure rate of the book, or of
    any part that the keys can select, are read from a few thousand cells
    instead of the loans. ``behind`` counts months one payment behind that a
    reported month followed, ``cured`` those after which the loan was current."""
    year = F.when(has_history(F.col("payment_history")), last_year(F.col("payment_history")))
    return loans.groupBy(*[k for k in CELL_KEYS if k in loans.columns]).agg(
        n_loans().alias("loans"),
        F.sum("is_delinquent").alias("dlq"),
        F.sum("current_upb").alias("upb"),
        F.sum(F.regexp_count(year, F.lit("1(?=[0-9])"))).alias("behind"),
        F.sum(F.regexp_count(year, F.lit("1(?=0)"))).alias("cured"),
    )


def _rolled_up(table: DataFrame, key: str, into: str) -> DataFrame:
    return table.groupBy(F.col(key).alias(into)).agg(*[F.sum(c).alias(c) for c in ("loans", "dlq", "upb")])


def vintage_cells(table: DataFrame) -> DataFrame:
    """Loans, rate and balance per vintage from cells, next to the rate of all
    of them."""
    return _with_portfolio_rate(_rolled_up(table, "orig_year", "_year")).filter(F.col("_year").isNotNull()).select(
        as_year("_year").alias("orig_year"),
        "loans",
        pct(F.col("dlq"), F.col("loans"), 2).alias("dlq_rate_pct"),
        rnd(F.col("upb") / 1e9, 2).alias("upb_billions"),
        "avg_dlq",
    )


def state_cells(table: DataFrame) -> DataFrame:
    """The same per state."""
    return _with_portfolio_rate(_rolled_up(table, "property_state", "property_state")).filter(F.col("property_state").isNotNull()).select(
        "property_state", "loans", pct(F.col("dlq"), F.col("loans"), 2).alias("dlq_rate_pct"), rnd(F.col("upb") / 1e9, 3).alias("upb_billions"), "avg_dlq"
    )


def hotspot_cells(table: DataFrame, limit: int = HOTSPOT_COUNT) -> DataFrame:
    worse = (F.col("dlq_rate_pct") > F.col("avg_dlq")) & (F.col("loans") >= SIGNIFICANT_STATE)
    return state_cells(table).filter(worse).orderBy(F.desc("dlq_rate_pct"), "property_state").limit(limit)


def cure_rate_cells(table: DataFrame) -> DataFrame:
    return table.agg(F.coalesce(pct(F.sum("cured"), F.sum("behind"), 2), F.lit(0.0)).alias("cure_rate_30"))


def _vintages(loans: DataFrame) -> DataFrame:
    """Loans, rate and balance per vintage, next to the portfolio's rate."""
    one_each = loans.select("orig_year", F.lit(1).alias("loans"), F.col("is_delinquent").alias("dlq"), F.col("current_upb").alias("upb"))
    return vintage_cells(one_each)


def vintage_extremes(loans: DataFrame) -> DataFrame:
    """Worst and best vintage with at least 1000 loans, the earlier one among
    equals; NULL when there is none."""
    significant = _vintages(loans).filter(F.col("loans") >= SIGNIFICANT_VINTAGE)
    worst = F.struct(F.col("dlq_rate_pct"), -F.col("orig_year"))
    best = F.struct(F.col("dlq_rate_pct"), F.col("orig_year"))
    return significant.agg(
        F.max_by("orig_year", worst).alias("worst_year"),
        F.max("dlq_rate_pct").alias("worst_dlq_pct"),
        F.min_by("orig_year", best).alias("best_year"),
        F.min("dlq_rate_pct").alias("best_dlq_pct"),
    )


def headline(loans: DataFrame) -> DataFrame:
    """One sentence: portfolio rate, size and the worst vintage. Fixed values:
    its wording is part of the result."""
    grouped = loans.groupBy(F.col("orig_year").alias("_year")).agg(
        n_loans().alias("loans"), F.sum("is_delinquent").alias("dlq"), F.sum("current_upb").alias("upb")
    )
    rate = pct(F.col("dlq"), F.col("loans"), 2)
    significant = F.col("_year").isNotNull() & (F.col("loans") >= SIGNIFICANT_VINTAGE)
    order = F.when(significant, F.struct(rate, -F.col("_year")))
    one = grouped.agg(
        F.sum("loans").alias("loans"),
        pct(F.sum("dlq"), F.sum("loans"), 2).alias("avg_dlq"),
        F.sum("upb").alias("upb"),
        F.max_by(F.struct(as_year("_year").alias("year"), rate.alias("rate")), order).alias("worst"),
    )
    short = F.concat(F.lit("Portfolio delinquency stands at "), F.col("avg_dlq").cast("string"), F.lit("%"))
    full = F.concat(
        short,
        F.lit(" across "), F.format_number("loans", 0), F.lit(" loans ($"), one_digit(settled(F.col("upb") / 1e9)),
        F.lit("B UPB). The "), F.col("worst.year").cast("int").cast("string"), F.lit(" vintage is the highest-risk cohort at "),
        F.col("worst.rate").cast("string"), F.lit("% delinquency — "),
        one_digit(F.col("worst.rate") / F.nullif(F.col("avg_dlq"), F.lit(0.0))), F.lit("x the portfolio average."),
    )
    return one.select(F.when(F.col("worst").isNotNull(), full).otherwise(F.concat(short, F.lit("."))).alias("headline"))


def dpd_chart(loans: DataFrame) -> DataFrame:
    """Delinquency distribution, most severe first, with colour and label."""
    return (
        P.delinquency_distribution(loans)
        .select(
            F.col("dpd_bucket").alias("label"),
            "loans",
            _lookup("dpd_bucket", BUCKET_COLOURS, F.lit(OTHER_COLOUR)).alias("colour"),
            F.concat(F.col("pct_of_portfolio").cast("string"), F.lit("%")).alias("text"),
        )
        .orderBy(rank_of("label", DPD_ORDER).desc(), F.desc("label"))
    )


def roll_matrix(loans: DataFrame) -> DataFrame:
    """Roll rates as a matrix: one row per starting state, 0 where no move."""
    return (
        P.roll_rates(loans)
        .groupBy("from_bucket")
        .pivot("to_bucket", list(ROLL_STATES))
        .agg(F.first("transition_pct"))
        .na.fill(0.0, list(ROLL_STATES))
        .orderBy(rank_of("from_bucket", ROLL_STATES))
    )


def hotspot_severity(loans: DataFrame) -> DataFrame:
    """Shading of the hotspot table: high above 1.5 times the portfolio rate."""
    high = F.col("dlq_rate_pct") > F.col("avg_dlq") * 1.5
    return geo_hotspots(loans).select(
        "property_state", "dlq_rate_pct", F.when(high, "high").otherwise("medium").alias("severity")
    )


def cure_rate(loans: DataFrame) -> DataFrame:
    """Share of months one payment behind that were current the month after."""
    cured = (F.col("from_bucket") == "30_DPD") & (F.col("to_bucket") == "Current")
    return P.roll_rates(loans).agg(
        F.coalesce(F.max(F.when(cured, F.col("transition_pct"))), F.lit(0.0)).alias("cure_rate_30")
    )


def geo_hotspots(loans: DataFrame, limit: int = HOTSPOT_COUNT) -> DataFrame:
    """States above the portfolio's rate with at least 500 loans, worst first."""
    return (
        P.state_table(loans)
        .filter((F.col("dlq_rate_pct") > F.col("avg_dlq")) & (F.col("loans") >= SIGNIFICANT_STATE))
        .orderBy(F.desc("dlq_rate_pct"), "property_state")
        .limit(limit)
    )


def segment_concentration(segments: DataFrame, limit: int = SEGMENT_COUNT) -> DataFrame:
    """Size and loan-weighted rate of the leading risk segments."""
    weighted = F.sum(F.col("actual_dlq_rate") * F.col("loans")) / F.nullif(F.sum("loans").cast("double"), F.lit(0.0))
    return segments.filter(F.col("position") <= limit).agg(
        F.sum("loans").alias("loans"),
        F.sum("total_upb").alias("upb"),
        rnd_even(weighted, 1).alias("avg_dlq"),
    )


def segment_page(segments: DataFrame, limit: int = SEGMENT_COUNT) -> DataFrame:
    """Leading segments with a severity of their actual rate."""
    rate = F.col("actual_dlq_rate")
    severity = F.when(rate > 5, "high").when(rate > 2, "medium").otherwise("none")
    return segments.filter(F.col("position") <= limit).withColumn("severity", severity)


def model_summary(metrics: DataFrame, lift: DataFrame, importances: DataFrame, top: int = 7) -> DataFrame:
    """AUC, lift at 10 and 20 percent and the top features of one model."""
    share = F.col("capture_rate_pct")
    lifts = lift.agg(
        F.max(F.when(F.col("top_pct") == 10, share)).alias("lift_10"),
        F.max(F.when(F.col("top_pct") == 20, share)).alias("lift_20"),
    ).first()
    area = metrics.agg(F.max("auc_roc").alias("auc")).first()["auc"]
    return (
        importances.filter(F.col("position") <= top)
        .select(
            F.lit(area).cast("double").alias("auc"),
            F.lit(lifts["lift_10"]).cast("double").alias("lift_10"),
            F.lit(lifts["lift_20"]).cast("double").alias("lift_20"),
            "position",
            "feature",
            "importance",
            _lookup("feature", FEATURE_NOTES, F.lit(DEFAULT_NOTE)).alias("interpretation"),
        )
        .orderBy("position")
    )


def vintage_severity(loans: DataFrame) -> DataFrame:
    """Shading of the vintage table: rate against the portfolio's."""
    rate, avg = F.col("dlq_rate_pct"), F.col("avg_dlq")
    return (
        _vintages(loans)
        .select(
            "orig_year", "loans", "dlq_rate_pct",
            F.when(rate > avg * 1.5, "high").when(rate > avg, "medium").otherwise("low").alias("severity"),
        )
        .orderBy("orig_year")
    )


def roll_severity(loans: DataFrame) -> DataFrame:
    """Shading of the roll matrix cells."""
    to, value = F.col("to_bucket"), F.col("transition_pct")
    severity = (
        F.when((to == "Current") & (value > 70), "low")
        .when((to != "Current") & (value > 10), "high")
        .when(value > 5, "medium")
        .otherwise("none")
    )
    return P.roll_rates(loans).select("from_bucket", "to_bucket", "transition_pct", severity.alias("severity"))


# -- recommendations -------------------------------------------------------------

_REC = ("category", "subject", "rate", "ratio", "loans", "upb_billions")


def _recommendation(df: DataFrame, category: str | Column, subject: Column, rate: Column, ratio: Column, loans: Column, upb: Column) -> DataFrame:
    label = F.lit(category) if isinstance(category, str) else category
    values = (label, subject.cast("string"), rate.cast("double"), ratio.cast("double"), loans.cast("long"), upb.cast("double"))
    return df.select(*[v.alias(n) for n, v in zip(_REC, values)])


def recommendations(loans: DataFrame, segments: DataFrame, lift: DataFrame) -> DataFrame:
    """Alerts that pass their threshold, one row each: vintages above twice
    the portfolio rate, the three worst hotspots above 1.5 times, leading
    segments above three times, a cure rate above 75 or below 60, and the
    lift at 20 percent.

    The loans are scanned once, into cells that all rules read."""
    return recommendations_of_cells(staged(cells(loans)), segments, lift)


def recommendations_of_cells(table: DataFrame, segments: DataFrame, lift: DataFrame) -> DataFrame:
    none = F.lit(None)
    ratio = F.col("dlq_rate_pct") / F.nullif(F.col("avg_dlq"), F.lit(0.0))

    vintage = _recommendation(
        vintage_cells(table).filter((F.col("dlq_rate_pct") > F.col("avg_dlq") * 2) & (F.col("loans") >= SIGNIFICANT_VINTAGE)),
        "Vintage Risk", F.col("orig_year"), F.col("dlq_rate_pct"), ratio, F.col("loans"), F.col("upb_billions"),
    )
    state = _recommendation(
        hotspot_cells(table, 3).filter(F.col("dlq_rate_pct") > F.col("avg_dlq") * 1.5),
        "Geographic Concentration", F.col("property_state"), F.col("dlq_rate_pct"), ratio, F.col("loans"), none,
    )
    # One row meets one row: the portfolio rate is put on the segment row by a
    # union and an aggregate instead of a join.
    portfolio = table.agg(pct(F.sum("dlq"), F.sum("loans"), 2).alias("avg_dlq")).select(
        F.lit(None).cast("long").alias("loans"), F.lit(None).cast("double").alias("upb"),
        F.lit(None).cast("double").alias("rate"), "avg_dlq",
    )
    leading = segment_concentration(segments).select(
        "loans", "upb", F.col("avg_dlq").alias("rate"), F.lit(None).cast("double").alias("avg_dlq")
    )
    merged = leading.unionByName(portfolio).agg(
        F.max("loans").alias("loans"), F.max("upb").alias("upb"), F.max("rate").alias("rate"), F.max("avg_dlq").alias("avg_dlq")
    )
    concentration = _recommendation(
        merged.filter(F.col("rate") > F.col("avg_dlq") * 3),
        "Segment Concentration", F.lit("Top 15 segments"), F.col("rate"), F.col("rate") / F.nullif(F.col("avg_dlq"), F.lit(0.0)),
        F.col("loans"), F.col("upb") / 1e9,
    )
    rate = F.col("cure_rate_30")
    category = F.when(rate > 75, "Loss Mitigation Effectiveness").when(rate < 60, "Loss Mitigation Concern")
    cure = _recommendation(
        cure_rate_cells(table).filter(category.isNotNull()), category, F.lit("30-DPD cure rate"), rate, none, none, none
    )
    scoring = _recommendation(
        lift.filter(F.col("top_pct") == 20), "Risk Scoring Opportunity", F.lit("Top 20% of scores"),
        F.col("capture_rate_pct"), none, none, none,
    )
    out = vintage
    for part in (state, concentration, cure, scoring):
        out = out.unionByName(part)
    return out


# What each recommendation says, with the numbers of its row filled in.
RECOMMENDATION_TEXTS = {
    "Vintage Risk": "{rate}% of the {subject} vintage is delinquent, {ratio} times the rate of the whole book; its {loans} loans hold ${upb} billion and should be contacted first.",
    "Geographic Concentration": "{subject}: {rate}% of {loans} loans are delinquent, {ratio} times the rate of the whole book. Follow the local economy.",
    "Segment Concentration": "{subject} hold {loans} loans with ${upb} billion outstanding, of which {one}% are delinquent on average. Send loss-mitigation staff there first.",
    "Loss Mitigation Effectiveness": "{one}% of loans one payment behind are current a month later: early contact works, keep it as it is.",
    "Loss Mitigation Concern": "Only {one}% of loans one payment behind are current a month later, less than the 60% aimed at. Contact them earlier.",
    "Risk Scoring Opportunity": "A fifth of the loans, taken from the top of the score, holds {rate}% of all delinquent ones. Work down that list.",
}


def recommendation_text(recs: DataFrame) -> DataFrame:
    """Readable sentence per recommendation; numbers are rounded here only."""
    values = {
        "subject": F.col("subject"), "rate": F.col("rate").cast("string"), "one": one_digit("rate"),
        "ratio": one_digit("ratio"), "loans": F.format_number("loans", 0), "upb": one_digit("upb_billions"),
    }
    text = None
    for kind, pattern in RECOMMENDATION_TEXTS.items():
        parts = [values[p] if n % 2 else F.lit(p) for n, p in enumerate(re.split(r"[{}]", pattern))]
        hit = F.col("category") == kind
        text = F.when(hit, F.concat(*parts)) if text is None else text.when(hit, F.concat(*parts))
    return recs.select("category", text.alias("text"))


# -- dashboard views ---------------------------------------------------------------


def band_ltv_heatmap(loans: DataFrame, ltv_labels: list[str]) -> DataFrame:
    """Delinquency rate per score band (rows) and LTV bucket (columns)."""
    return (
        loans.filter((F.col("credit_score_band") != "Unknown") & (F.col("ltv_bucket") != "Unknown"))
        .groupBy("credit_score_band")
        .pivot("ltv_bucket", ltv_labels)
        .agg(delinquency_rate())
    )


def dlq_by_band(loans: DataFrame) -> DataFrame:
    """Delinquency rate per score band."""
    return (
        loans.filter(F.col("credit_score_band") != "Unknown")
        .groupBy("credit_score_band")
        .agg(n_loans().alias("loans"), delinquency_rate().alias("dlq_rate_pct"))
    )


def seasoning_curve(loans: DataFrame, eras=VINTAGE_ERAS) -> DataFrame:
    """Delinquency rate by loan age within each vintage era."""
    year = F.col("orig_year")
    era = None
    for first, last, label in eras:
        inside = year.between(first, last)
        era = F.when(inside, label) if era is None else era.when(inside, label)
    return (
        loans.filter(F.col("loan_age").isNotNull())
        .groupBy(era.otherwise("Other").alias("era"), F.col("loan_age").cast("int").alias("loan_age"))
        .agg(n_loans().alias("loans"), delinquency_rate().alias("dlq_rate_pct"))
        .orderBy("era", "loan_age")
    )


def _shares(loans: DataFrame, within: Column, label: Column, names: tuple[str, str]) -> DataFrame:
    grouped = loans.groupBy(within.alias(names[0]), label.alias(names[1])).agg(n_loans().alias("loans"))
    total = F.sum("loans").over(Window.partitionBy(names[0]))
    return grouped.withColumn("pct", pct(F.col("loans"), total, 2)).orderBy(*names)


def rate_by_vintage(loans: DataFrame) -> DataFrame:
    """Origination rate buckets within each vintage."""
    known = loans.filter(F.col("orig_year").isNotNull())
    return _shares(known, as_year(), F.col("rate_bucket"), ("orig_year", "rate_bucket"))


def score_by_status(loans: DataFrame) -> DataFrame:
    """Score bands within each delinquency bucket."""
    return _shares(loans, F.col("dpd_bucket"), F.col("credit_score_band"), ("dpd_bucket", "credit_score_band"))


def top_segments(loans: DataFrame, limit: int = SEGMENT_COUNT) -> DataFrame:
    """Riskiest segments by delinquency rate."""
    return (
        P.risk_segmentation(loans)
        .orderBy(F.desc("dlq_rate_pct"), "credit_score_band", "ltv_bucket", "rate_bucket", "orig_year")
        .limit(limit)
    )


def state_names(loans: DataFrame) -> DataFrame:
    """Loans per state with the state's name; NULL for an unknown code."""
    return (
        loans.groupBy("property_state")
        .agg(n_loans().alias("loans"))
        .select("property_state", _lookup("property_state", STATE_NAMES).alias("state_name"), "loans")
    )
