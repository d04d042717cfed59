"""Schema, cleaning rules and thresholds.

Everything an operator needs to know about a tape lives in one ``TapeConfig``;
``TapeConfig.from_yaml`` overrides any part of it without touching code.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The published tape layout. A position that is not listed holds
# a filler field named f<position + 1>, of type str.
# ---------------------------------------------------------------------------
FIELD_COUNT = 90
NAMED_FIELDS: tuple[tuple[int, str, str], ...] = (
    (0, "reporting_period", "str"),
    (1, "pool_prefix", "str"),
    (2, "loan_id", "str"),
    (3, "amortization_type", "str"),
    (4, "seller_name", "str"),
    (5, "property_state", "str"),
    (6, "postal_code", "str"),
    (7, "msa", "str"),
    (8, "orig_date", "str"),
    (9, "maturity_date", "str"),
    (10, "loan_term", "int"),
    (11, "orig_interest_rate", "float"),
    (12, "orig_loan_amount", "float"),
    (13, "orig_upb", "float"),
    (14, "occupancy_status", "str"),
    (15, "channel", "str"),
    (16, "property_type", "str"),
    (17, "num_units", "int"),
    (18, "loan_purpose", "str"),
    (19, "num_borrowers", "int"),
    (20, "first_time_homebuyer", "str"),
    (21, "prepayment_penalty", "str"),
    (22, "credit_score", "int"),
    (23, "ltv", "int"),
    (24, "cltv", "int"),
    (25, "dti", "int"),
    (26, "mi_percent", "int"),
    (27, "co_borrower_credit_score", "int"),
    (32, "servicer_name", "str"),
    (33, "loan_age", "int"),
    (34, "remaining_months", "int"),
    (35, "adj_remaining_months", "int"),
    (36, "delinquency_status", "str"),
    (37, "payment_history", "str"),
    (38, "current_interest_rate", "float"),
    (39, "current_ib_upb", "float"),
    (40, "current_actual_upb", "float"),
    (41, "current_deferred_upb", "float"),
    (42, "mi_cancel_indicator", "str"),
    (43, "first_default_date", "str"),
    (47, "zero_balance_eff_date", "str"),
    (55, "actual_loss", "float"),
    (58, "high_balance_indicator", "str"),
    (59, "orig_dti_2", "int"),
    (61, "current_credit_score", "int"),
    (62, "co_borr_current_score", "int"),
    (83, "mi_type", "str"),
    (84, "servicing_indicator", "str"),
    (88, "relief_refinance", "str"),
)

# Record-type layout, field index -> column, per record type.
ORIGINATION_RECORD = {
    1: "loan_id",
    3: "amortization_type",
    4: "num_borrowers",
    5: "first_time_homebuyer",
    6: "prepayment_penalty",
    11: "seller_name",
    12: "property_state",
    13: "postal_code",
    14: "msa",
    15: "orig_date",
    17: "loan_term",
    18: "orig_interest_rate",
    19: "orig_loan_amount",
    20: "orig_upb",
    21: "occupancy_status",
    22: "channel",
    23: "property_type",
    24: "num_units",
    25: "loan_purpose",
    29: "credit_score",
    30: "ltv",
    31: "cltv",
    32: "dti",
}
PERFORMANCE_RECORD = {
    2: "reporting_period",
    3: "servicer_name",
    5: "current_interest_rate",
    6: "maturity_date",
    7: "current_deferred_upb",
    18: "delinquency_status",
    19: "payment_history",
}

# Codes that mean "not available", per numeric column.
SENTINELS = {
    "credit_score": [9999, 0],
    "co_borrower_credit_score": [9999, 0],
    "current_credit_score": [9999, 0],
    "co_borr_current_score": [9999, 0],
    "dti": [999, 0],
    "ltv": [999, 0],
    "cltv": [999, 9999, 0],
    "mi_percent": [999],
    "orig_dti_2": [999, 0],
}

# Delinquency codes and band limits (both ends inclusive).
DPD_LABELS = {
    "00": "Current",
    "01": "30_DPD",
    "02": "60_DPD",
    "03": "90_DPD",
    "RA": "REO_Acquired",
}
CREDIT_SCORE_BANDS = [
    (0, 619, "Subprime (<620)"),
    (620, 679, "Fair (620-679)"),
    (680, 719, "Good (680-719)"),
    (720, 779, "Very Good (720-779)"),
    (780, 9999, "Excellent (780+)"),
]
LTV_BUCKETS = [
    (0, 60, "Low (<=60)"),
    (61, 80, "Medium (61-80)"),
    (81, 90, "High (81-90)"),
    (91, 999, "Very High (>90)"),
]
RATE_BUCKETS = [
    (0.0, 3.499, "Below 3.5%"),
    (3.5, 4.499, "3.5% - 4.5%"),
    (4.5, 5.499, "4.5% - 5.5%"),
    (5.5, 6.499, "5.5% - 6.5%"),
    (6.5, 999.0, "6.5%+"),
]

# Columns the cleaning step adds to the tape.
DERIVED_FIELDS: tuple[tuple[str, T.DataType], ...] = (
    ("current_upb", T.DoubleType()),
    ("orig_year", T.DoubleType()),
    ("orig_quarter", T.StringType()),
    ("dpd_bucket", T.StringType()),
    ("credit_score_band", T.StringType()),
    ("ltv_bucket", T.StringType()),
    ("rate_bucket", T.StringType()),
    ("is_delinquent", T.IntegerType()),
    ("is_seriously_delinquent", T.IntegerType()),
)


def _tape_fields() -> list[tuple[str, str]]:
    named = {position: (name, kind) for position, name, kind in NAMED_FIELDS}
    return [named.get(i, (f"f{i + 1}", "str")) for i in range(FIELD_COUNT)]


@dataclass(frozen=True)
class TapeConfig:
    """What a tape looks like and how it is cleaned and judged."""

    columns: list[tuple[str, str]] = field(default_factory=_tape_fields)
    origination_record: dict[int, str] = field(default_factory=lambda: dict(ORIGINATION_RECORD))
    performance_record: dict[int, str] = field(default_factory=lambda: dict(PERFORMANCE_RECORD))
    sentinels: dict[str, list[float]] = field(default_factory=lambda: dict(SENTINELS))
    dpd_labels: dict[str, str] = field(default_factory=lambda: dict(DPD_LABELS))
    dpd_severe_from: int = 4
    dpd_severe_label: str = "120_Plus_DPD"
    dpd_default: str = "Other"
    credit_score_bands: list[tuple] = field(default_factory=lambda: list(CREDIT_SCORE_BANDS))
    ltv_buckets: list[tuple] = field(default_factory=lambda: list(LTV_BUCKETS))
    rate_buckets: list[tuple] = field(default_factory=lambda: list(RATE_BUCKETS))
    field_tolerance: int = 2
    sample_lines: int = 20
    max_null_pct_critical: dict[str, float] = field(
        default_factory=lambda: {"loan_id": 0.0, "delinquency_status": 1.0}
    )
    max_null_pct_warning: dict[str, float] = field(
        default_factory=lambda: {"credit_score": 5.0, "ltv": 5.0, "current_upb": 2.0}
    )
    max_null_pct_default: float = 10.0
    max_duplicate_loan_ids: int = 0
    min_loans_per_pool: int = 100
    min_vintages: int = 5

    # -- schema accessors ---------------------------------------------------
    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.columns]

    def names_of(self, *kinds: str) -> list[str]:
        return [name for name, kind in self.columns if kind in kinds]

    @property
    def numeric_names(self) -> list[str]:
        return self.names_of("float", "int")

    def index_of(self, name: str) -> int:
        return self.names.index(name)

    @property
    def raw_schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in self.names])

    @property
    def loan_schema(self) -> T.StructType:
        """The loan table: every tape column plus the derived ones."""
        typed = [
            T.StructField(n, T.StringType() if kind == "str" else T.DoubleType())
            for n, kind in self.columns
        ]
        return T.StructType(typed + [T.StructField(n, t) for n, t in DERIVED_FIELDS])

    # -- overrides ----------------------------------------------------------
    @classmethod
    def from_mapping(cls, overrides: dict[str, Any]) -> TapeConfig:
        known = {f.name for f in fields(cls)}
        unknown = set(overrides) - known
        if unknown:
            raise KeyError(f"unknown settings: {sorted(unknown)}")
        return replace(cls(), **overrides)

    @classmethod
    def from_yaml(cls, path: str) -> TapeConfig:
        import yaml

        with open(path) as handle:
            return cls.from_mapping(yaml.safe_load(handle) or {})


@dataclass(frozen=True)
class ModelConfig:
    """Feature sets, model parameters and safety limits of the risk models."""

    origination_numeric: tuple[str, ...] = (
        "credit_score", "ltv", "dti", "orig_interest_rate", "loan_age",
        "orig_loan_amount", "num_borrowers",
    )
    categorical: tuple[str, ...] = (
        "credit_score_band", "ltv_bucket", "rate_bucket", "channel",
        "property_type", "occupancy_status", "loan_purpose",
    )
    binary: tuple[str, ...] = ("is_first_time_buyer",)
    behavioral_numeric: tuple[str, ...] = (
        "dlq_count_12m", "max_dpd_12m", "consecutive_current", "dlq_trend_6m",
        "current_upb", "latest_credit_score",
    )
    target: str = "is_delinquent"
    max_iter: int = 1000
    inverse_penalty: float = 1.0
    trees: int = 200
    max_depth: int = 12
    min_leaf: int = 50
    seed: int = 42
    # Forests twice as fast for about 0.8 kB per loan and 200 trees, which spill
    # to the executors' disks; False walks every tree anew at each level.
    cache_node_ids: bool = True
    boosting_rounds: int = 100
    boosting_depth: int = 3
    boosting_rate: float = 0.1
    min_target_rate: float = 0.001
    max_target_rate: float = 0.50
    leakage_correlation: float = 0.95
    auc_suspect: float = 0.99
    auc_confirmed: float = 0.999
    min_positives: int = 50
    lift_percentiles: tuple[int, ...] = (1, 5, 10, 20)
    min_segment_loans: int = 30


DEFAULT = TapeConfig()
MODEL_DEFAULT = ModelConfig()
