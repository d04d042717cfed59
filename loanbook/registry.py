"""Every operator as a named query over the test tables.

Each entry takes ``(spark, sf_dir)`` and reads the whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanbook.config import DEFAULT, MODEL_DEFAULT, TapeConfig
from loanbook.functions.expressions import rnd
from loanbook.functions.ordered import checkpointed, shared_folder, staged, wide_rows
from loanbook.operators import checks, clean, features, models, portfolio, report, scoring
from loanbook.plans import etl, model_run, sql_runner
from loanbook.sinks import export, store
from loanbook.sources import tape, testtables

Query = Callable[[SparkSession, str], DataFrame]

# Settings of the registered queries that differ from the library's defaults,
# because the test tables start in 1995 and have few pools.
TEST_ERAS = ((1995, 1997, "1995-1997"), (1998, 2000, "1998-2000"), (2001, 9999, "2001+"))
TEST_SMALL_POOL = 2000
DEMO_SQL = """
SELECT dpd_bucket, property_type, count(*) AS loans, max(current_upb) AS largest_upb
FROM loans WHERE orig_year >= 1998 GROUP BY dpd_bucket, property_type
"""
STATE_CODES = [*report.STATE_NAMES, "ZZ"]


class OverLoans:
    """A query over the loan table; ``table`` takes any such table, as after a
    load, and calling it derives one from the test tables."""

    def __init__(self, table: Callable[[DataFrame], DataFrame]):
        self.table = table

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.table(testtables.loans(spark, sf_dir))


def _over_loans(table: Callable[[DataFrame], DataFrame]) -> Query:
    return OverLoans(table)


def _over_flat(table: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: table(testtables.flat_lines(spark, sf_dir))


def _over_records(table: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: table(testtables.record_lines(spark, sf_dir))


def _written(derived: DataFrame) -> DataFrame:
    """What is derived from the test tables, written down in one wide pass."""
    with wide_rows(derived.sparkSession):
        return staged(derived)


def _over_matrix(table: Callable[[DataFrame], DataFrame]) -> Query:
    """The matrix is derived once and written down: fitting reads it often."""
    return OverLoans(lambda loans: table(_written(features.feature_matrix(loans))))


def _over_scored(table: Callable[[DataFrame], DataFrame]) -> Query:
    return OverLoans(lambda loans: table(_scored_loans(loans)))


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by all cores: tasks that fit and score a model follow its files."""
    return _written(features.feature_matrix(testtables.loans(spark, sf_dir, spread=True)))


# A fixed score without a model. Halves over a power of two are exact, so sums
# and means do not depend on the order of addition.
FIXED_SCORE = "((900 - credit_score) * 0.5e0 + ltv) / 512e0"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_loans(testtables.loans(spark, sf_dir))


def _scored_loans(loans: DataFrame) -> DataFrame:
    matrix = features.feature_matrix(loans)
    return matrix.withColumn("score", F.expr(FIXED_SCORE)).withColumn("label", F.col("is_delinquent"))


# -- sources and ingestion -------------------------------------------------------


def tape_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names seen in the lines plus variants that must not be selected."""
    names = testtables.flat_lines(spark, sf_dir).select("file").distinct()
    variants = names.select(
        F.explode(
            F.array(
                F.col("file"),
                F.regexp_replace("file", "_lld", "_LLD"),
                F.regexp_replace("file", "_lld", "_tape"),
                F.regexp_replace("file", "txt$", "TXT"),
                F.regexp_replace("file", "txt$", "csv"),
            )
        ).alias("file")
    )
    return variants.filter(tape.is_tape_name("file")).orderBy("file")


def tape_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = testtables.flat_lines(spark, sf_dir).unionByName(testtables.record_lines(spark, sf_dir))
    return tape.detect_layouts(lines)


def _typed(parsed: DataFrame, names: list[str]) -> DataFrame:
    """A few parsed columns; the text of doubles is read back as numbers."""
    numeric = set(DEFAULT.names_of("float"))
    return parsed.select("file", *[F.col(n).try_cast("double").alias(n) if n in numeric else F.col(n) for n in names])


FLAT_COLUMNS = [
    "reporting_period", "pool_prefix", "loan_id", "property_state", "orig_date", "orig_interest_rate",
    "orig_loan_amount", "credit_score", "dti", "delinquency_status", "payment_history", "current_ib_upb",
    "relief_refinance", "f90",
]
RECORD_COLUMNS = [
    "reporting_period", "pool_prefix", "loan_id", "property_state", "orig_date", "orig_interest_rate",
    "credit_score", "dti", "delinquency_status", "payment_history", "current_deferred_upb", "loan_age", "f90",
]


def parse_flat_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(tape.parse_flat(testtables.flat_lines(spark, sf_dir)), FLAT_COLUMNS)


def merge_record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(tape.parse_records(testtables.record_lines(spark, sf_dir)), RECORD_COLUMNS)


def pool_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = testtables.tape(spark, sf_dir)
    loan_id = F.when(F.col("row_key") % 3 == 0, F.concat(F.lit("A00B0"), "loan_id")).otherwise(F.col("loan_id"))
    return loans.select(loan_id.alias("loan_id")).select("loan_id", tape.pool_prefix_of("loan_id").alias("pool_prefix"))


# -- cleaning ----------------------------------------------------------------------

CLEAN_COLUMNS = [
    "loan_id", "property_state", "orig_date", "credit_score", "current_credit_score", "ltv", "dti", "orig_interest_rate",
    "delinquency_status", "current_ib_upb", "current_upb", "orig_year", "orig_quarter", "dpd_bucket", "credit_score_band",
    "ltv_bucket", "rate_bucket", "is_delinquent", "is_seriously_delinquent",
]


def clean_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(testtables.raw_tape(spark, sf_dir).drop("row_key")).select(*CLEAN_COLUMNS)


def cast_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cast_failures(testtables.raw_tape(spark, sf_dir))


def sentinel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = testtables.raw_tape(spark, sf_dir).drop("row_key")
    return clean.sentinel_counts(clean.cast_numeric(clean.trim_blanks(raw)))


def cleaning_null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.null_rates(clean.clean(testtables.raw_tape(spark, sf_dir).drop("row_key")))


# -- load ----------------------------------------------------------------------------


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = testtables.flat_lines(spark, sf_dir)
    layouts = checkpointed(tape.detect_layouts(lines))
    usable = [r["file"] for r in layouts.filter("matches_schema").select("file").collect()]
    usable_lines = lines.filter(F.col("file").isin(usable))
    counts = checkpointed(etl.load_counts(clean.clean(tape.parse_flat(usable_lines))))
    return etl.manifest(layouts, counts)


def load_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir)


def _loaded(spark: SparkSession, lines: list[DataFrame]) -> etl.LoadResult:
    """The load job from real tape files to a stored table."""
    return etl.run_load(spark, testtables.tape_folder(spark, *lines), _new_folder(spark, "loaded"))


def _all_lines(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Lines that go straight into tape files, read once and so not stored before."""
    return [lines(spark, sf_dir, placed=True) for lines in (testtables.derived_flat_lines, testtables.derived_record_lines)]


def _tapes(spark: SparkSession, sf_dir: str) -> str:
    """A folder with flat and record-type tapes and a damaged one."""
    folder = testtables.tape_folder(spark, *_all_lines(spark, sf_dir))
    testtables.tear(spark, folder)
    return folder


def load_tapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of two loads of the same tapes into one table."""
    folder, table = _tapes(spark, sf_dir), _new_folder(spark, "loaded")
    first, second = (etl.run_load(spark, folder, table).manifest.drop("size_mb").withColumn("run", F.lit(n)) for n in (1, 2))
    return first.unionByName(second)


def load_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, _all_lines(spark, sf_dir)).rejects


def load_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost casts and replaced sentinels per file and column."""
    result = _loaded(spark, [testtables.derived_flat_lines(spark, sf_dir, placed=True)])
    return result.cast_failures.select("file", F.lit("cast_failure").alias("kind"), "column_name", F.col("failures").alias("n")).unionByName(
        result.sentinels.select("file", F.lit("sentinel").alias("kind"), "column_name", F.col("replaced").alias("n")))


def manifest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.status_counts(etl.run_load(spark, _tapes(spark, sf_dir), _new_folder(spark, "loaded")).manifest)


def align_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table columns from a frame that lacks most and has one too many."""
    extra = testtables.loans(spark, sf_dir).withColumn("not_in_table", F.lit(1))
    aligned = store.align_columns(extra)
    return aligned.select("loan_id", "loan_term", "seller_name", "f90", "dti", "current_upb", "is_delinquent")


def replace_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all pools, then half of the loans of two pools again: only these
    two pools change."""
    folder = _new_folder(spark, "loans")
    loans = testtables.loans(spark, sf_dir)
    store.replace_pools(loans, folder)
    again = loans.filter(F.col("pool_prefix").isin("95DNA1", "98DNA1") & (F.col("num_borrowers") == 1.0))
    for _ in range(2):
        store.replace_pools(again, folder, rebalance=True)
    return (
        store.read_loans(spark, folder)
        .groupBy("pool_prefix")
        .agg(F.count(F.lit(1)).alias("loans"), rnd(F.sum("current_upb")).alias("total_upb"))
    )


def exported_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark, "dashboard")
    # Seven exports read the loans, which are derived once.
    loans = _written(testtables.loans(spark, sf_dir))
    export.export_dashboard(loans, folder)
    schema = portfolio.vintage_comparison(loans).schema
    return export.read_result(spark, f"{folder}/vintage_comparison", schema)


def exported_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark, "page")
    loans = _written(testtables.loans(spark, sf_dir))
    export.export_page(loans, folder)
    return export.read_result(spark, f"{folder}/geographic", portfolio.geographic(loans).schema, "json")


def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_runner.run_sql(DEMO_SQL, testtables.loans(spark, sf_dir))


# -- features ------------------------------------------------------------------------


def imputed_features(matrix: DataFrame) -> DataFrame:
    fitted = features.fit_features(matrix, "behavioral")
    return features.imputed(matrix, fitted).select("loan_id", *fitted.numeric)


def _slug(name: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in name)


def encoded_features(matrix: DataFrame, kind: str) -> DataFrame:
    """The encoded columns under plain names."""
    fitted = features.fit_features(matrix, kind)
    encoded = matrix.select("loan_id", *fitted.columns())
    return encoded.toDF("loan_id", *[_slug(n) for n in fitted.names])


def one_hot_features(matrix: DataFrame) -> DataFrame:
    fitted = features.FeatureSet((), {}, features.category_levels(matrix, MODEL_DEFAULT.categorical), MODEL_DEFAULT.binary)
    return matrix.select("loan_id", *fitted.columns()).toDF("loan_id", *[_slug(n) for n in fitted.names])


def behavioral_features(matrix: DataFrame) -> DataFrame:
    return encoded_features(matrix, "behavioral")


def scaled_features(matrix: DataFrame) -> DataFrame:
    """Standardised numbers of the training side, as the regression sees them."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    fitted = features.fit_features(matrix)
    train, _ = features.split_by_age(matrix, fitted.medians["loan_age"])
    ready = train.select("loan_id", fitted.vector().alias("features"))
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(ready)
    values = vector_to_array("scaled")
    return scaler.transform(ready).select(
        "loan_id", *[rnd(F.get(values, F.lit(i)), 5).alias(n) for i, n in enumerate(fitted.numeric)]
    )


def split_info(matrix: DataFrame) -> DataFrame:
    return features.split_info(matrix, features.median_age(matrix))


# -- metrics and gates -----------------------------------------------------------------


def _with_leak(matrix: DataFrame) -> tuple[DataFrame, list[str]]:
    fitted = features.fit_features(matrix)
    leak = (F.col("is_delinquent") * 2 + 1).alias("leaked_status")
    return matrix.select(*fitted.columns(), leak, "is_delinquent"), [*fitted.names, "leaked_status"]


def feature_correlations(matrix: DataFrame) -> DataFrame:
    encoded, names = _with_leak(matrix)
    numeric = [n for n in names if n in MODEL_DEFAULT.origination_numeric] + ["leaked_status"]
    table = scoring.feature_correlations(encoded, numeric, "is_delinquent")
    return table.select("feature", rnd("correlation", 6).alias("correlation"))


def leakage_check(matrix: DataFrame) -> DataFrame:
    encoded, names = _with_leak(matrix)
    return scoring.leakage_check(encoded, names, "is_delinquent")


def split_check(matrix: DataFrame) -> DataFrame:
    return scoring.split_check(matrix, features.median_age(matrix))


def auc(scored: DataFrame) -> DataFrame:
    return scoring.auc(scoring.score_curve(scored))


def lift_curve(scored: DataFrame) -> DataFrame:
    return scoring.lift_curve(scoring.lift_table(scored))


def _fixed_metrics(scored: DataFrame) -> DataFrame:
    """Metrics of the fixed score and of one that knows the answer."""
    out = None
    for position, (name, score) in enumerate({"fixed": F.col("score"), "oracle": F.col("label").cast("double")}.items()):
        judged = scored.select("loan_id", "label", score.alias("score"))
        area = scoring.auc(scoring.score_curve(judged)).first()["auc_roc"]
        row = scoring.classification_metrics(judged).select(
            F.lit(name).alias("model_name"), F.lit(position).alias("position"),
            F.lit(area).cast("double").alias("auc_roc"), "precision", "recall",
        )
        out = row if out is None else out.unionByName(row)
    return out


def post_training_check(scored: DataFrame) -> DataFrame:
    return scoring.post_training_check(_fixed_metrics(scored))


def best_model(scored: DataFrame) -> DataFrame:
    return scoring.best_model(_fixed_metrics(scored))


# -- models ------------------------------------------------------------------------------


def _judged(metrics: DataFrame) -> DataFrame:
    """What of a trained model every engine must agree on: the loans it was
    judged on, and that its measures are possible. The measures themselves are
    held against bounds in the tests, on loans with a planted effect."""
    counts = ["true_negatives", "false_positives", "false_negatives", "true_positives"]
    shares = [F.col(c).between(0, 1) for c in ("auc_roc", "precision", "recall", "f1_score")]
    return metrics.select(
        "model_name",
        sum((F.col(c) for c in counts[1:]), F.col(counts[0])).cast("long").alias("test_loans"),
        (F.col("false_negatives") + F.col("true_positives")).cast("long").alias("positives"),
        (shares[0] & shares[1] & shares[2] & shares[3]).alias("measures_possible"),
    )


def _origination_model(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = model_run.run_origination(_matrix(spark, sf_dir), names=(name,))
        if result.errors:
            raise RuntimeError(result.errors)
        return _judged(result.reports[name]["metrics"])

    return run


def origination_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = model_run.run_origination(_matrix(spark, sf_dir), names=("logistic_regression",))
    return result.reports["logistic_regression"]["importances"]


def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = model_run.run_origination(_matrix(spark, sf_dir), names=("logistic_regression",))
    return report.model_summary(
        *[result.reports["logistic_regression"][k] for k in ("metrics", "lift", "importances")]
    )


def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, save, load and score all loans with both: the largest difference
    between the saved and the loaded model."""
    matrix = _matrix(spark, sf_dir)
    result = model_run.run_origination(matrix, names=("logistic_regression",))
    folder = _new_folder(spark, "model")
    result.models["logistic_regression"].save(folder)
    loaded = models.TrainedModel.load(spark, folder)
    kept = result.models["logistic_regression"].score(matrix).select("loan_id", F.col("score").alias("_kept"))
    both = loaded.score(matrix).select("loan_id", "score").join(kept, "loan_id")
    return both.agg(F.count(F.lit(1)).alias("loans"), rnd(F.max(F.abs(F.col("score") - F.col("_kept"))), 6).alias("largest_difference"))


def behavioral_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the behavioral model, without what depends on its scores."""
    return model_run.run_behavioral(_matrix(spark, sf_dir)).segments.drop("position", "avg_risk_score")


# -- report ------------------------------------------------------------------------------


def _segments(scored: DataFrame) -> DataFrame:
    return scoring.rank_segments(scored)


def recommendations(loans: DataFrame) -> DataFrame:
    """Two scans of the loans: one for the cells, one for the scores, which are
    written down with the columns that segments and lift need."""
    scored = _scored_loans(loans)
    needed = scored.select("loan_id", "score", "label", *scoring.SEGMENT_INPUTS)
    written = staged(needed)
    return report.recommendations(loans, _segments(written), scoring.lift_table(written))


def recommendation_text(loans: DataFrame) -> DataFrame:
    return report.recommendation_text(recommendations(loans))


def _part_of_cells(loans: DataFrame, **chosen) -> DataFrame:
    return portfolio.filter_loans(report.cells(loans), **chosen)


def filtered_vintages(loans: DataFrame) -> DataFrame:
    return report.vintage_cells(_part_of_cells(loans, band="Good (680-719)", property_type="SF"))


def filtered_states(loans: DataFrame) -> DataFrame:
    return report.state_cells(_part_of_cells(loans, year=1998, property_type="SF"))


def filtered_cure_rate(loans: DataFrame) -> DataFrame:
    return report.cure_rate_cells(_part_of_cells(loans, year=1998, band="Good (680-719)"))


def band_ltv_heatmap(loans: DataFrame) -> DataFrame:
    labels = [label for _, _, label in DEFAULT.ltv_buckets]
    table = report.band_ltv_heatmap(loans, labels)
    return table.toDF("credit_score_band", *[_slug(label) for label in labels])


def roll_matrix(loans: DataFrame) -> DataFrame:
    table = report.roll_matrix(loans)
    return table.toDF("from_bucket", *[f"to_{c}" for c in table.columns[1:]])


def state_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in STATE_CODES])
    number = F.substring("loan_id", 7, 8).cast("int")
    code: Column = F.get(codes, number % len(STATE_CODES))
    return report.state_names(testtables.loans(spark, sf_dir).withColumn("property_state", code))


def filtered_summary(loans: DataFrame) -> DataFrame:
    return portfolio.portfolio_summary(
        portfolio.filter_loans(loans, year=1998, band="Good (680-719)", property_type="SF")
    )


def small_pools(loans: DataFrame) -> DataFrame:
    return checks.small_pools(loans, TapeConfig(min_loans_per_pool=TEST_SMALL_POOL))


QUERIES: dict[str, Query] = {
    # ingestion
    "tape_files": tape_files,
    "tape_layouts": tape_layouts,
    "parse_flat_tape": parse_flat_tape,
    "flat_rejects": _over_flat(tape.flat_rejects),
    "merge_record_types": merge_record_types,
    "record_counts": _over_records(tape.record_counts),
    "pool_prefixes": pool_prefixes,
    "sql_text": sql_text,
    # cleaning
    "clean_loans": clean_loans,
    "cast_failures": cast_failures,
    "sentinel_counts": sentinel_counts,
    "cleaning_null_rates": cleaning_null_rates,
    # load and export
    "align_columns": align_columns,
    "replace_partitions": replace_partitions,
    "load_manifest": load_manifest,
    "load_tapes": load_tapes,
    "load_rejects": load_rejects,
    "load_cleaning": load_cleaning,
    "manifest_status": manifest_status,
    "loan_detail": _over_loans(portfolio.loan_detail),
    "exported_csv": exported_csv,
    "exported_json": exported_json,
    # load validation
    "load_validation": _over_loans(checks.load_validation),
    "validation_overall": _over_loans(lambda loans: checks.overall_status(checks.load_validation(loans))),
    "vintage_coverage": _over_loans(checks.vintage_coverage),
    "small_pools": _over_loans(small_pools),
    # portfolio tables
    "null_profile": _over_loans(portfolio.null_profile),
    "portfolio_summary": _over_loans(portfolio.portfolio_summary),
    "delinquency_distribution": _over_loans(portfolio.delinquency_distribution),
    "roll_rates": _over_loans(portfolio.roll_rates),
    "risk_segmentation": _over_loans(portfolio.risk_segmentation),
    "paydown": _over_loans(portfolio.paydown),
    "vintage_comparison": _over_loans(portfolio.vintage_comparison),
    "geographic": _over_loans(portfolio.geographic),
    "site_summary": _over_loans(portfolio.site_summary),
    "executive_summary": _over_loans(portfolio.executive_summary),
    # data-quality report
    "dq_summary": _over_loans(checks.quality_summary),
    "dq_completeness": _over_loans(checks.completeness),
    "dq_validity": _over_loans(checks.validity),
    "dq_consistency": _over_loans(checks.consistency),
    "dq_dist_credit": _over_loans(checks.credit_distribution),
    "dq_dist_dpd": _over_loans(checks.dpd_distribution),
    "dq_dist_vintage": _over_loans(checks.vintage_distribution),
    "dq_pools": _over_loans(checks.pool_sizes),
    "dq_overall": _over_loans(checks.quality_status),
    # features
    "feature_matrix": _over_loans(features.feature_matrix),
    "imputed_features": _over_matrix(imputed_features),
    "one_hot_features": _over_matrix(one_hot_features),
    "behavioral_features": _over_matrix(behavioral_features),
    "scaled_features": _over_matrix(scaled_features),
    "split_info": _over_matrix(split_info),
    # gates, metrics and scores
    "class_weights": _over_matrix(scoring.class_weights),
    "target_check": _over_matrix(scoring.target_check),
    "feature_correlations": _over_matrix(feature_correlations),
    "leakage_check": _over_matrix(leakage_check),
    "split_check": _over_matrix(split_check),
    "auc": _over_scored(auc),
    "classification_metrics": _over_scored(scoring.classification_metrics),
    "lift_table": _over_scored(scoring.lift_table),
    "lift_curve": _over_scored(lift_curve),
    "score_stats": _over_scored(lambda scored: scoring.score_stats(staged(scored.select("score")))),
    "rank_segments": _over_scored(_segments),
    "post_training_check": _over_scored(post_training_check),
    "best_model": _over_scored(best_model),
    # models
    "origination_regression": _origination_model("logistic_regression"),
    "origination_forest": _origination_model("random_forest"),
    "origination_boosting": _origination_model("gradient_boosting"),
    "origination_importances": origination_importances,
    "behavioral_segments": behavioral_segments,
    "saved_model": saved_model,
    "model_summary": model_summary,
    # report and dashboard
    "vintage_extremes": _over_loans(report.vintage_extremes),
    "headline": _over_loans(report.headline),
    "dpd_chart": _over_loans(report.dpd_chart),
    "roll_matrix": _over_loans(roll_matrix),
    "cure_rate": _over_loans(report.cure_rate),
    "geo_hotspots": _over_loans(report.geo_hotspots),
    "hotspot_severity": _over_loans(report.hotspot_severity),
    "segment_page": _over_scored(lambda scored: report.segment_page(_segments(scored))),
    "segment_concentration": _over_scored(lambda scored: report.segment_concentration(_segments(scored))),
    "recommendations": _over_loans(recommendations),
    "recommendation_text": _over_loans(recommendation_text),
    "vintage_severity": _over_loans(report.vintage_severity),
    "roll_severity": _over_loans(report.roll_severity),
    "band_ltv_heatmap": _over_loans(band_ltv_heatmap),
    "dlq_by_band": _over_loans(report.dlq_by_band),
    "seasoning_curve": _over_loans(lambda loans: report.seasoning_curve(loans, TEST_ERAS)),
    "rate_by_vintage": _over_loans(report.rate_by_vintage),
    "score_by_status": _over_loans(report.score_by_status),
    "top_segments": _over_loans(report.top_segments),
    "filtered_summary": _over_loans(filtered_summary),
    "filtered_vintages": _over_loans(filtered_vintages),
    "filtered_states": _over_loans(filtered_states),
    "filtered_cure_rate": _over_loans(filtered_cure_rate),
    "state_names": state_names,
}
