"""Models on a frame with a planted effect, judged by bounds."""

import random

import pytest
from pyspark.sql import functions as F

from loanbook.config import ModelConfig
from loanbook.functions.ordered import checkpointed
from loanbook.operators import scoring
from loanbook.operators.features import FeatureSet, category_levels, feature_matrix, fit_features
from loanbook.operators.models import TrainedModel
from loanbook.operators.report import model_summary, recommendation_text, recommendations, segment_concentration
from loanbook.plans.model_run import evaluation_rows, run_behavioral, run_origination, save_all

CFG = ModelConfig(trees=12, max_depth=5, min_leaf=10, max_iter=100, boosting_rounds=10)


@pytest.fixture(scope="module")
def matrix(spark):
    """Delinquency depends strongly on the credit score."""
    rng = random.Random(5)
    rows = []
    for i in range(6_000):
        score = rng.randrange(560, 830)
        late = int(rng.random() < max(0.02, (720 - score) / 250))
        rows.append((
            f"L{i:06d}", float(score), float(rng.randrange(30, 98)), None if i % 40 == 0 else float(rng.randrange(10, 50)),
            3.0 + rng.random() * 4, float(rng.randrange(12, 120)), 1e5 + rng.randrange(400_000), float(1 + i % 2), 2016 + i % 5,
            "Fair (620-679)" if score < 680 else "Good (680-719)" if score < 720 else "Excellent (780+)",
            rng.choice(["Low (<=60)", "Medium (61-80)"]), "3.5% - 4.5%", rng.choice("BCR"), rng.choice(["SF", "CO"]), "P", rng.choice("PN"),
            i % 2, 0, late * 2, 12 - late * 3, 0, 9e4, float(score), late, 0, "Current" if not late else "30_DPD",
        ))
    schema = (
        "loan_id string, credit_score double, ltv double, dti double, orig_interest_rate double, loan_age double, orig_loan_amount double, "
        "num_borrowers double, orig_year int, credit_score_band string, ltv_bucket string, rate_bucket string, channel string, property_type string, "
        "occupancy_status string, loan_purpose string, is_first_time_buyer int, dlq_count_12m int, max_dpd_12m int, consecutive_current int, "
        "dlq_trend_6m int, current_upb double, latest_credit_score double, is_delinquent int, is_seriously_delinquent int, dpd_bucket string"
    )
    return checkpointed(spark.createDataFrame(rows, schema).repartition(4))


@pytest.fixture(scope="module")
def origination(matrix):
    return run_origination(matrix, CFG, names=("logistic_regression", "random_forest", "gradient_boosting"))


@pytest.fixture(scope="module")
def behavioral(matrix):
    return run_behavioral(matrix, CFG)


def test_models_find_the_planted_effect(origination):
    assert origination.errors == {}
    for name, report in origination.reports.items():
        metrics = report["metrics"].first()
        assert 0.7 < metrics["auc_roc"] <= 1.0, name
        lift = {r["top_pct"]: r for r in report["lift"].collect()}
        assert lift[20]["capture_rate_pct"] > 30
        assert report["importances"].first()["feature"].startswith("credit_score")
    assert origination.best in origination.models
    assert {r["diagnosis"] for r in origination.diagnosis.collect()} == {"healthy"}
    assert origination.leakage.count() == 0


def test_split_covers_every_loan(origination, matrix):
    split = origination.split.first()
    assert split["train_size"] + split["test_size"] == matrix.count()


def test_confusion_matrix_covers_the_test_side(origination):
    metrics = origination.reports["random_forest"]["metrics"].first()
    total = sum(metrics[c] for c in ("true_negatives", "false_positives", "false_negatives", "true_positives"))
    assert total == origination.split.first()["test_size"]


def test_behavioral_model_ranks_segments(behavioral, matrix):
    segments = behavioral.segments.orderBy("position").collect()
    assert len(segments) > 5
    scores = [r["avg_risk_score"] for r in segments]
    assert scores == sorted(scores, reverse=True)
    assert all(r["loans"] >= CFG.min_segment_loans for r in segments)
    assert behavioral.importances.first()["feature"] in {"max_dpd_12m", "consecutive_current"}
    assert segment_concentration(behavioral.segments).first()["loans"] == sum(r["loans"] for r in segments[:15])


def test_saved_model_scores_alike(spark, origination, behavioral, matrix, tmp_path):
    folder = str(tmp_path / "artifacts")
    save_all(origination, behavioral, folder)
    loaded = TrainedModel.load(spark, f"{folder}/origination_model")
    best = origination.models[origination.best]
    assert loaded.features == best.features
    both = best.score(matrix).select("loan_id", F.col("score").alias("a")).join(
        loaded.score(matrix).select("loan_id", F.col("score").alias("b")), "loan_id"
    )
    assert both.filter(F.abs(F.col("a") - F.col("b")) > 1e-12).count() == 0
    assert spark.read.json(f"{folder}/evaluation_report").count() == evaluation_rows(origination, behavioral).count()
    assert spark.read.option("header", True).csv(f"{folder}/risk_segments").count() == behavioral.segments.count()


def test_model_summary(origination):
    report = origination.reports["random_forest"]
    rows = model_summary(report["metrics"], report["lift"], report["importances"]).collect()
    assert len(rows) == 7 and all(r["interpretation"] for r in rows)
    assert rows[0]["auc"] == report["metrics"].first()["auc_roc"]


def test_a_failing_model_is_recorded(matrix):
    result = run_origination(matrix, CFG, names=("no_such_model", "logistic_regression"))
    assert set(result.errors) == {"no_such_model"} and result.best == "logistic_regression"


def test_gates_stop_a_run(matrix):
    with pytest.raises(scoring.GateFailed):
        run_origination(matrix.withColumn("is_delinquent", F.lit(0)), CFG)
    with pytest.raises(scoring.GateFailed):
        run_origination(matrix, ModelConfig(min_positives=10**6))


def test_leaking_feature_is_flagged(matrix):
    leaky = matrix.select("is_delinquent", (F.col("is_delinquent") * 3).alias("leak"), F.lit(1).alias("constant"), "ltv")
    flagged = scoring.leakage_check(leaky, ["leak", "constant", "ltv"], "is_delinquent").collect()
    assert [tuple(r) for r in flagged] == [("leak", 1.0)]


def test_encoding(spark, matrix):
    fitted = fit_features(matrix)
    assert FeatureSet.from_json(fitted.to_json()) == fitted
    assert fitted.levels["channel"] == ["B", "C", "R"]
    row = matrix.limit(1).withColumn("channel", F.lit(None).cast("string")).withColumn("dti", F.lit(None).cast("double"))
    encoded = row.select(*fitted.columns()).first()
    assert encoded["channel_C"] == 0 and encoded["channel_R"] == 0
    assert encoded["dti"] == fitted.medians["dti"]
    many = category_levels(matrix, ["loan_id"])["loan_id"]
    assert len(many) == matrix.select("loan_id").distinct().count()


def test_history_features(spark, loans):
    history = "0" * 36 + "01X0X0000400"
    row = loans.limit(1).withColumn("payment_history", F.lit(history))
    for c in ("credit_score", "ltv", "loan_age"):
        row = row.withColumn(c, F.lit(50.0))
    got = feature_matrix(row).first()
    assert (got["dlq_count_12m"], got["dlq_months_12m"], got["max_dpd_12m"]) == (2, 2, 4)
    assert (got["consecutive_current"], got["dlq_trend_6m"]) == (2, -2)
    assert feature_matrix(row.withColumn("payment_history", F.lit("0" * 47))).count() == 0
    assert feature_matrix(row.withColumn("payment_history", F.lit("0" * 47 + "X"))).first()["consecutive_current"] == 0


def test_all_recommendations(spark):
    """A portfolio that trips every rule."""
    def block(n, year, state, late, history):
        return spark.range(n).select(
            F.lit(float(year)).alias("orig_year"), F.lit(state).alias("property_state"),
            (F.col("id") < n * late).cast("int").alias("is_delinquent"), F.lit(0).alias("is_seriously_delinquent"),
            F.lit(2e5).alias("current_upb"), F.lit(700.0).alias("credit_score"), F.lit(4.0).alias("orig_interest_rate"),
            F.lit(80.0).alias("ltv"), F.lit(history).alias("payment_history"),
        )

    loans = block(8000, 2018, "TX", 0.01, "0" * 36 + "010101010101").unionByName(block(1000, 2022, "WV", 0.2, "0" * 48))
    segments = spark.createDataFrame([(1, 400, 8e7, 25.0)], "position int, loans long, total_upb double, actual_dlq_rate double")
    lift = spark.createDataFrame([(10, 30.0), (20, 58.8)], "top_pct int, capture_rate_pct double")
    recs = recommendations(loans, segments, lift)
    assert [r["category"] for r in recs.collect()] == [
        "Vintage Risk", "Geographic Concentration", "Segment Concentration", "Loss Mitigation Effectiveness", "Risk Scoring Opportunity",
    ]
    assert recommendation_text(recs).filter("text is null").count() == 0


def test_few_training_tasks(spark, origination):
    """Every task hands over the statistics of all nodes: tasks follow cores and loans, not shuffle partitions."""
    from loanbook.operators import models

    assert models.training_tasks(900_000, 12) == 12
    assert models.training_tasks(27_000_000, 12) == 54
    assert models.training_tasks(0, 4) == 4


def test_training_waves_are_even():
    from loanbook.operators import models

    assert [models.even_waves(n, 12) for n in (1, 12, 18, 54, 108)] == [12, 12, 24, 60, 108]


def test_matrix_is_written_by_all_cores(spark):
    """A forest scores a loan in tenths of a millisecond, in as many tasks as the matrix has files."""
    from conftest import SMALL

    from loanbook import registry
    from loanbook.sources import testtables

    matrix = registry._matrix(spark, SMALL)
    assert len(matrix.inputFiles()) >= spark.sparkContext.defaultParallelism
    plain = feature_matrix(testtables.loans(spark, SMALL))
    assert matrix.exceptAll(plain).isEmpty() and plain.exceptAll(matrix).isEmpty()
