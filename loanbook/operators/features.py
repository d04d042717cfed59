"""Model features: eligible loans, payment-history measures, encoding, split."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanbook.config import MODEL_DEFAULT, ModelConfig
from loanbook.functions.expressions import rnd_even
from loanbook.functions.history import (
    count_of,
    delinquent_months,
    has_history,
    last_year,
    trailing_current,
    worst_level,
)
from loanbook.functions.ordered import exact_quantiles

REQUIRED = ("loan_id", "credit_score", "ltv", "loan_age")
WITH_DEFAULT = ("channel", "property_type", "occupancy_status", "loan_purpose")


def feature_matrix(loans: DataFrame) -> DataFrame:
    """Feature columns of every loan that has an id, score, LTV, age and a full
    history.

    ``dlq_count_12m`` and ``dlq_trend_6m`` count months marked ``X`` (not
    reported), which is what the published models were trained on.
    ``dlq_months_12m`` is the count of months that were really delinquent.
    """
    history = F.col("payment_history")
    year = last_year(history)
    recent, prior = F.substring(history, 43, 6), F.substring(history, 37, 6)
    eligible = has_history(history)
    for c in REQUIRED:
        eligible = eligible & F.col(c).isNotNull()
    return loans.filter(eligible).select(
        "loan_id",
        "credit_score",
        "ltv",
        "dti",
        "orig_interest_rate",
        "loan_age",
        "orig_loan_amount",
        "num_borrowers",
        F.col("orig_year").cast("int").alias("orig_year"),
        "credit_score_band",
        "ltv_bucket",
        "rate_bucket",
        *[F.coalesce(c, F.lit("Unknown")).alias(c) for c in WITH_DEFAULT],
        F.when(F.col("first_time_homebuyer") == "Y", 1).otherwise(0).alias("is_first_time_buyer"),
        count_of(year, "X").alias("dlq_count_12m"),
        worst_level(year).alias("max_dpd_12m"),
        trailing_current(year).alias("consecutive_current"),
        (count_of(recent, "X") - count_of(prior, "X")).alias("dlq_trend_6m"),
        "current_upb",
        F.coalesce("current_credit_score", "credit_score").alias("latest_credit_score"),
        "is_delinquent",
        "is_seriously_delinquent",
        "dpd_bucket",
        delinquent_months(year).alias("dlq_months_12m"),
    )


@dataclass(frozen=True)
class FeatureSet:
    """Fitted encoding: medians to impute with and levels to one-hot encode.

    It holds a few numbers and labels; applying it is a projection."""

    numeric: tuple[str, ...]
    medians: dict[str, float | None]
    levels: dict[str, list[str]]
    binary: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        encoded = [f"{c}_{level}" for c, levels in self.levels.items() for level in levels[1:]]
        return [*self.numeric, *encoded, *self.binary]

    def columns(self) -> list[Column]:
        """Numeric, then one-hot, then binary columns."""
        numeric = []
        for c in self.numeric:
            value = F.col(c).cast("double")
            median = self.medians.get(c)
            numeric.append((value if median is None else F.coalesce(value, F.lit(float(median)))).alias(c))
        # A NULL level matches no column and leaves all of them zero.
        encoded = [
            F.coalesce((F.col(c) == level).cast("int"), F.lit(0)).alias(f"{c}_{level}")
            for c, levels in self.levels.items()
            for level in levels[1:]
        ]
        binary = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in self.binary]
        return [*numeric, *encoded, *binary]

    def vector(self) -> Column:
        return array_to_vector(F.array(*[c.cast("double") for c in self.columns()]))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> FeatureSet:
        data = json.loads(text)
        return cls(tuple(data["numeric"]), data["medians"], data["levels"], tuple(data["binary"]))


def category_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values per column, NULL left out.

    The combinations of all columns are reduced first, in one pass with a
    map-side combine."""
    combinations = df.select(*columns).distinct()
    pairs = combinations.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("level")) for c in columns]))
    )
    found = pairs.filter(F.col("level").isNotNull()).distinct().collect()
    return {c: sorted(r["level"] for r in found if r["name"] == c) for c in columns}


def fit_features(matrix: DataFrame, kind: str = "origination", cfg: ModelConfig = MODEL_DEFAULT) -> FeatureSet:
    """Medians and levels over the whole matrix, before any split."""
    numeric = cfg.origination_numeric
    if kind == "behavioral":
        numeric = numeric + cfg.behavioral_numeric
    elif kind != "origination":
        raise ValueError(f"unknown feature set: {kind}")
    medians = exact_quantiles(matrix, numeric, [0.5])
    return FeatureSet(
        numeric=numeric,
        medians={c: medians[c][0.5] for c in numeric},
        levels=category_levels(matrix, cfg.categorical),
        binary=cfg.binary,
    )


def imputed(matrix: DataFrame, features: FeatureSet) -> DataFrame:
    """The matrix with medians in place of missing numbers."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(m))).alias(c) for c, m in features.medians.items() if m is not None}
    return matrix.select(*[filled.get(c, F.col(c)) for c in matrix.columns])


def median_age(matrix: DataFrame) -> float:
    return exact_quantiles(matrix, ["loan_age"], [0.5])["loan_age"][0.5]


def split_by_age(matrix: DataFrame, cut: float) -> tuple[DataFrame, DataFrame]:
    """Seasoned loans train, newer ones test."""
    return matrix.filter(F.col("loan_age") >= cut), matrix.filter(F.col("loan_age") < cut)


def split_info(matrix: DataFrame, cut: float, target: str = MODEL_DEFAULT.target) -> DataFrame:
    """Sizes and target rates of both sides, in one pass."""
    train = F.col("loan_age") >= cut
    test = F.col("loan_age") < cut
    return matrix.agg(
        F.lit("loan_age_median").alias("split_method"),
        F.lit(float(cut)).alias("median_age"),
        F.count_if(train).alias("train_size"),
        F.count_if(test).alias("test_size"),
        rnd_even(F.avg(F.when(train, F.col(target))), 4).alias("train_dlq_rate"),
        rnd_even(F.avg(F.when(test, F.col(target))), 4).alias("test_dlq_rate"),
    )
