"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   tables (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  comma-separated names instead of the default list

The load job is timed first, from tape text to the stored loan table; the
queries then read that table, as they would after a monthly load.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loanbook.config import DEFAULT  # noqa: E402
from loanbook.plans.etl import run_load  # noqa: E402
from loanbook.registry import QUERIES, OverLoans  # noqa: E402
from loanbook.sinks.store import read_loans, replace_pools  # noqa: E402
from loanbook.sources.testtables import loans, raw_tape  # noqa: E402

HEADLINE = [
    "null_profile", "portfolio_summary", "delinquency_distribution", "roll_rates", "risk_segmentation", "paydown",
    "vintage_comparison", "geographic", "executive_summary", "load_validation", "dq_completeness", "dq_validity",
    "dq_consistency", "feature_matrix", "imputed_features", "one_hot_features", "split_info", "leakage_check",
    "auc", "lift_table", "score_stats", "rank_segments", "recommendations", "loan_detail",
    "origination_regression", "origination_forest", "behavioral_segments",
]


def timed(action) -> float:
    started = time.time()
    action()
    return round(time.time() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    work = tempfile.mkdtemp(prefix="loanbook-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loanbook-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"{work}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    # One tape file per pool for the load job; writing them is not timed.
    raw = raw_tape(spark, sf_dir)
    text = F.concat_ws("|", *[F.col(n) for n in DEFAULT.names])
    tapes = f"{work}/tapes"
    raw.select("pool_prefix", text.alias("value")).repartition("pool_prefix").write.partitionBy("pool_prefix").text(f"{work}/parts")
    os.makedirs(tapes)
    for part in glob.glob(f"{work}/parts/pool_prefix=*/part-*"):
        pool = os.path.basename(os.path.dirname(part)).split("=")[1]
        os.link(part, f"{tapes}/{pool}_lld.txt")
    size_mb = sum(os.path.getsize(f"{tapes}/{f}") for f in os.listdir(tapes)) / 1048576

    timings: dict[str, float] = {}
    timings["load_tapes"] = timed(lambda: run_load(spark, tapes, f"{work}/loaded").overall.collect())

    stored = f"{work}/loans"
    timings["store_loans"] = timed(lambda: replace_pools(loans(spark, sf_dir), stored, rebalance=True))
    n_loans = read_loans(spark, stored).count()
    table = read_loans(spark, stored)

    def run(name: str) -> None:
        query = QUERIES[name]
        result = query.table(table) if isinstance(query, OverLoans) else query(spark, sf_dir)
        result.write.format("noop").mode("overwrite").save()

    for name in names:
        timings[name] = timed(lambda: run(name))

    print(json.dumps({
        "metric": "loan_portfolio_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "loans": n_loans,
        "tape_mb": round(size_mb, 1),
        "load_loans_per_sec": round(n_loans / timings["load_tapes"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
