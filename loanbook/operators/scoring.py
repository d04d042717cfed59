"""Metrics and gates over a frame of scored loans.

Input frames have a score column in [0, 1], a 0/1 label and a loan id. Ordered
metrics work on scores grouped with their counts, so ties cost nothing and no
task ever sorts all loans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanbook.config import MODEL_DEFAULT, ModelConfig
from loanbook.functions.expressions import pct_even, rnd, rnd_even, rows, settled
from loanbook.functions.ordered import checkpointed, exact_quantiles, running_totals
from loanbook.operators.portfolio import n_loans

SEGMENT_KEYS = ("credit_score_band", "ltv_bucket", "rate_bucket", "orig_year")
# What segments are made from, besides the score.
SEGMENT_INPUTS = (*SEGMENT_KEYS, "current_upb", "is_delinquent", "credit_score", "orig_interest_rate")


class GateFailed(Exception):
    """A gate that must stop a model run."""


# -- training gates --------------------------------------------------------------


def class_weights(df: DataFrame, target: str = MODEL_DEFAULT.target) -> DataFrame:
    """Balanced weights: loans / (2 x loans of the class), one row per class."""
    one = df.agg(n_loans().alias("n"), F.count_if(F.col(target) == 1).alias("pos"))
    negatives = F.col("n") - F.col("pos")

    def entry(label: int, size: Column) -> dict[str, Column]:
        weight = F.col("n") / F.nullif(F.lit(2.0) * size, F.lit(0.0))
        return {"label": F.lit(label), "loans": size, "weight": weight}

    return rows(one, [entry(0, negatives), entry(1, F.col("pos"))])


def target_check(df: DataFrame, cfg: ModelConfig = MODEL_DEFAULT) -> DataFrame:
    """Target rate and whether it lies within the limits."""
    rate = F.avg(cfg.target)
    status = (
        F.when(rate < cfg.min_target_rate, "TOO_LOW").when(rate > cfg.max_target_rate, "TOO_HIGH").otherwise("PASS")
    )
    return df.agg(rnd(rate, 6).alias("target_rate"), status.alias("status"))


def require_target(df: DataFrame, cfg: ModelConfig = MODEL_DEFAULT) -> None:
    row = target_check(df, cfg).first()
    if row["status"] != "PASS":
        raise GateFailed(
            f"target rate {row['target_rate']} outside [{cfg.min_target_rate}, {cfg.max_target_rate}]"
        )


def feature_correlations(encoded: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """Absolute Pearson correlation of every feature with the target, from one
    aggregate over all features. Constant features and those with missing
    values have none and are left out."""
    y = F.col(f"`{target}`").cast("double")

    def correlation(x: Column) -> Column:
        return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))

    found = encoded.agg(
        *[correlation(F.col(f"`{c}`").cast("double")).alias(f"r{i}") for i, c in enumerate(names)],
        *[(F.count(f"`{c}`") < n_loans()).alias(f"gaps{i}") for i, c in enumerate(names)],
        *[(F.min(f"`{c}`") == F.max(f"`{c}`")).alias(f"flat{i}") for i, c in enumerate(names)],
    )
    each = found.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.when(~F.col(f"gaps{i}") & ~F.col(f"flat{i}"), F.abs(f"r{i}")).alias("correlation"))
        for i, c in enumerate(names)
    ])))
    return each.filter(F.col("correlation").isNotNull() & ~F.isnan("correlation"))


def leakage_check(
    encoded: DataFrame, names: Sequence[str], target: str, threshold: float = MODEL_DEFAULT.leakage_correlation
) -> DataFrame:
    """Features that follow the target suspiciously closely."""
    return (
        feature_correlations(encoded, names, target)
        .filter(F.col("correlation") >= threshold)
        .select("feature", rnd_even("correlation", 4).alias("correlation"))
    )


def split_check(matrix: DataFrame, cut: float, cfg: ModelConfig = MODEL_DEFAULT) -> DataFrame:
    """Positives on both sides of the split, and whether there are enough."""
    positive = F.col(cfg.target) == 1
    one = matrix.agg(
        F.count_if(positive & (F.col("loan_age") >= cut)).alias("train"),
        F.count_if(positive & (F.col("loan_age") < cut)).alias("test"),
    )
    return rows(
        one,
        [
            {
                "split": F.lit(side),
                "positives": F.col(side),
                "status": F.when(F.col(side) >= cfg.min_positives, "PASS").otherwise("FAIL"),
            }
            for side in ("train", "test")
        ],
    )


def require_split(matrix: DataFrame, cut: float, cfg: ModelConfig = MODEL_DEFAULT) -> None:
    failed = split_check(matrix, cut, cfg).filter("status = 'FAIL'").collect()
    if failed:
        raise GateFailed(
            "; ".join(f"{r['split']} has only {r['positives']} delinquent loans" for r in failed)
        )


# -- evaluation ------------------------------------------------------------------


def score_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score, highest first, with loans and positives at
    the score and running totals down to it."""
    grouped = scored.groupBy(F.col(score).alias("score")).agg(
        n_loans().alias("loans"), F.sum(F.col(label).cast("long")).alias("positives")
    )
    return running_totals(
        grouped,
        [F.desc("score")],
        {"loans_to_here": F.col("loans"), "positives_to_here": F.col("positives")},
    )


def auc(curve: DataFrame) -> DataFrame:
    """Area under the ROC curve: share of (positive, negative) pairs in the
    right order, ties counting one half."""
    negatives = F.col("loans") - F.col("positives")
    negatives_above = (F.col("loans_to_here") - F.col("positives_to_here")) - negatives
    # Per score: the pairs whose negative ranks above the positive are lost.
    one = curve.agg(
        F.sum(F.col("positives").cast("double") * (negatives_above + negatives / F.lit(2.0))).alias("lost"),
        F.sum("positives").cast("double").alias("pos"),
        F.sum(negatives).cast("double").alias("neg"),
    )
    pairs = F.nullif(F.col("pos") * F.col("neg"), F.lit(0.0))
    return one.select(rnd_even(F.lit(1.0) - F.col("lost") / pairs, 4).alias("auc_roc"))


def classification_metrics(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Confusion matrix at one half with precision, recall and F1; a division
    by zero gives 0."""
    predicted, actual = F.col(score) > 0.5, F.col(label) == 1
    one = scored.agg(
        F.count_if(~predicted & ~actual).alias("true_negatives"),
        F.count_if(predicted & ~actual).alias("false_positives"),
        F.count_if(~predicted & actual).alias("false_negatives"),
        F.count_if(predicted & actual).alias("true_positives"),
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("true_positives", "false_positives", "false_negatives"))

    def ratio(part: Column, whole: Column) -> Column:
        return rnd_even(F.coalesce(part / F.nullif(whole, F.lit(0.0)), F.lit(0.0)), 4)

    return one.select(
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        "true_negatives", "false_positives", "false_negatives", "true_positives",
    )


def lift_table(
    scored: DataFrame,
    percentiles: Sequence[int] = MODEL_DEFAULT.lift_percentiles,
    score: str = "score",
    label: str = "label",
    loan_id: str = "loan_id",
    curve: DataFrame | None = None,
) -> DataFrame:
    """Positives among the highest-scored 1, 5, 10 and 20 percent of loans.

    The curve tells in which group of equal scores each cut falls. Groups
    above it count in full; only the loans of the group that is cut are
    ordered, by loan id.
    """
    if curve is None:
        curve = score_curve(scored, score, label)
    ends = curve.agg(F.max("loans_to_here").alias("n"), F.max("positives_to_here").alias("pos")).first()
    total, positives = ends["n"] or 0, ends["pos"] or 0
    sizes = {p: max(1, int(total * p / 100)) for p in percentiles}

    # Each percentile falls into exactly one row of the curve.
    above = F.col("loans_to_here") - F.col("loans")
    cuts = F.array(*[F.struct(F.lit(p).alias("top_pct"), F.lit(n).cast("long").alias("size")) for p, n in sizes.items()])
    inside = F.filter(cuts, lambda cut: (above < cut["size"]) & (F.col("loans_to_here") >= cut["size"]))
    whole = F.col("loans_to_here") == F.col("cut.size")
    boundary = checkpointed(
        curve.select("*", F.explode(inside).alias("cut")).select(
            F.col("cut.top_pct").alias("top_pct"),
            F.col("cut.size").alias("loans_reviewed"),
            F.when(whole, F.col("positives_to_here"))
            .otherwise(F.col("positives_to_here") - F.col("positives"))
            .alias("caught_above"),
            F.when(whole, 0).otherwise(F.col("cut.size") - above).alias("from_tie"),
            F.col("score").alias("tie_score"),
        )
    )

    # At most one row per percentile is broadcast.
    ties = scored.select(
        F.col(score).alias("tie_score"), F.col(loan_id).alias("loan_id"), F.col(label).cast("long").alias("label")
    ).join(F.broadcast(boundary.filter(F.col("from_tie") > 0)), "tie_score")
    ordered = running_totals(
        ties.select("top_pct", "loan_id", "label", "from_tie"),
        [F.col("top_pct"), F.col("loan_id")],
        {"position": F.lit(1)},
    )
    starts = ordered.groupBy("top_pct").agg((F.min("position") - 1).alias("before"))
    taken = (
        ordered.join(F.broadcast(starts), "top_pct")
        .filter(F.col("position") - F.col("before") <= F.col("from_tie"))
        .groupBy("top_pct")
        .agg(F.sum("label").alias("caught_in_tie"))
    )
    caught = F.col("caught_above") + F.coalesce(F.col("caught_in_tie"), F.lit(0))
    return boundary.join(taken, "top_pct", "left").select(
        "top_pct",
        "loans_reviewed",
        caught.cast("long").alias("delinquencies_caught"),
        F.coalesce(pct_even(caught, F.lit(positives), 1), F.lit(0.0)).alias("capture_rate_pct"),
    ).orderBy("top_pct")


def lift_curve(lift: DataFrame) -> DataFrame:
    """Points of the lift chart, from the origin."""
    origin = lift.sparkSession.range(1).select(F.lit(0).alias("top_pct"), F.lit(0.0).alias("capture_rate_pct"))
    return origin.unionByName(lift.select("top_pct", "capture_rate_pct")).orderBy("top_pct")


def post_training_check(metrics: DataFrame, kind: str = "origination", cfg: ModelConfig = MODEL_DEFAULT) -> DataFrame:
    """Diagnosis per model: an AUC near one means leakage for a model that
    only knows the origination, and is expected of a behavioral one."""
    suspicious = F.col("auc_roc") >= cfg.auc_suspect
    if kind == "origination":
        diagnosis = (
            F.when(F.col("auc_roc") >= cfg.auc_confirmed, "LEAKAGE_CONFIRMED")
            .when(suspicious, "LEAKAGE_SUSPECTED")
            .otherwise("healthy")
        )
    else:
        diagnosis = F.when(suspicious, "expected_behavioral").otherwise("healthy")
    return metrics.select(
        "model_name",
        "auc_roc",
        suspicious.alias("auc_flag"),
        (F.col("precision") == 1.0).alias("perfect_precision"),
        (F.col("recall") == 1.0).alias("perfect_recall"),
        diagnosis.alias("diagnosis"),
    )


def best_model(metrics: DataFrame) -> DataFrame:
    """Name and AUC of the best model; the first in position among equals."""
    order = F.struct(F.col("auc_roc"), -F.col("position"))
    return metrics.agg(
        F.max_by("model_name", order).alias("model_name"), F.max("auc_roc").alias("auc_roc")
    )


# -- scores and segments -----------------------------------------------------------


def score_stats(scored: DataFrame, score: str = "score") -> DataFrame:
    """Mean, median and 95th percentile of the score, 4 decimals."""
    cuts = exact_quantiles(scored, [score], [0.5, 0.95])[score]
    return scored.agg(
        n_loans().alias("loans"),
        rnd(F.avg(score), 4).alias("mean_score"),
        rnd(F.lit(cuts[0.5]).cast("double"), 4).alias("median_score"),
        rnd(F.lit(cuts[0.95]).cast("double"), 4).alias("p95_score"),
    )


def rank_segments(scored: DataFrame, score: str = "score", min_loans: int = MODEL_DEFAULT.min_segment_loans) -> DataFrame:
    """Segments by mean score, highest first. ``position`` follows the exact
    mean, so it keeps the order wherever the rows are stored; the values are
    then rounded half to even."""
    known = scored
    for key in SEGMENT_KEYS:
        known = known.filter(F.col(key).isNotNull())
    grouped = known.groupBy(*SEGMENT_KEYS).agg(
        F.count("loan_id").alias("loans"),
        F.sum("current_upb").alias("total_upb"),
        F.avg(score).alias("avg_risk_score"),
        F.avg("is_delinquent").alias("actual_dlq_rate"),
        F.avg("credit_score").alias("avg_fico"),
        settled(F.avg("orig_interest_rate")).alias("avg_rate"),
    )
    # Segments are combinations of bands and years, a few hundred rows.
    order = Window.orderBy(F.desc("avg_risk_score"), *SEGMENT_KEYS)
    return (
        grouped.filter(F.col("loans") >= min_loans)
        .withColumn("position", F.row_number().over(order))
        .select(
            "position",
            *SEGMENT_KEYS,
            "loans",
            rnd_even("total_upb").alias("total_upb"),
            rnd_even(F.col("avg_risk_score") * 100, 2).alias("avg_risk_score"),
            rnd_even(F.col("actual_dlq_rate") * 100, 2).alias("actual_dlq_rate"),
            rnd_even("avg_fico").alias("avg_fico"),
            rnd_even("avg_rate", 3).alias("avg_rate"),
        )
        .orderBy("position")
    )
