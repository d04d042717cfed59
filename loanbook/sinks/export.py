"""Exported result files and reading them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanbook.operators import portfolio as P

# Dashboard extracts: file name -> aggregated table.
CSV_TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "portfolio_summary": P.portfolio_summary,
    "delinquency_by_dpd": P.delinquency_distribution,
    "roll_rates": P.roll_rates,
    "risk_segments": P.risk_segmentation,
    "vintage_comparison": P.vintage_comparison,
    "geographic": P.geographic,
}
# Portfolio page: file name -> aggregated table.
JSON_TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "summary": P.site_summary,
    "vintage": P.vintage_comparison,
    "geographic": P.geographic,
    "delinquency": P.delinquency_distribution,
    "roll_rates": P.roll_rates,
}
PAGE_SEGMENTS = 30


def write_result(df: DataFrame, path: str, fmt: str = "csv", one_file: bool = False) -> None:
    """Write a result with all tasks. ``one_file`` is for aggregated results,
    whose size does not grow with the loans."""
    if one_file:
        df = df.coalesce(1)
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def show_or_write(df: DataFrame, fmt: str = "print", path: str | None = None) -> None:
    """Send a result to the console, all rows of it, or to a CSV or JSON folder.

    The console gets one partition after the other, so the driver never holds
    more than one."""
    if fmt == "print":
        print("\t".join(df.columns))
        for row in df.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in row))
    else:
        if path is None:
            raise ValueError("csv and json need a path")
        write_result(df, path, fmt)


def export_dashboard(loans: DataFrame, folder: str) -> list[str]:
    """Six aggregated tables and the loan-level extract as CSV. The extract is
    written by all tasks in parallel."""
    for name, table in CSV_TABLES.items():
        write_result(table(loans), f"{folder}/{name}", one_file=True)
    P.loan_detail(loans).write.mode("overwrite").option("header", True).csv(f"{folder}/loans_detail")
    return [*CSV_TABLES, "loans_detail"]


def export_page(
    loans: DataFrame,
    folder: str,
    segments: DataFrame | None = None,
    evaluation: DataFrame | None = None,
) -> list[str]:
    """Summary, four tables, and when given the model evaluation and the first
    thirty risk segments, as JSON Lines."""
    written = list(JSON_TABLES)
    for name, table in JSON_TABLES.items():
        write_result(table(loans), f"{folder}/{name}", "json", one_file=True)
    if evaluation is not None:
        write_result(evaluation, f"{folder}/evaluation", "json", one_file=True)
        written.append("evaluation")
    if segments is not None:
        first = segments.filter(F.col("position") <= PAGE_SEGMENTS).orderBy("position")
        write_result(first, f"{folder}/risk_segments", "json", one_file=True)
        written.append("risk_segments")
    return written


def read_result(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """An exported result with its declared schema; nothing is inferred."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    if fmt == "json":
        return reader.json(path)
    raise ValueError(f"unknown format: {fmt}")
