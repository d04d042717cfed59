"""Rounding half to even, on the exact binary value."""

import random

from pyspark.sql import functions as F

from loanbook.functions.expressions import one_digit, pct_even


def test_shares_at_a_tie(spark):
    rows = [(1, 800), (1, 1600), (3, 800), (5, 800), (0, 7)]
    got = spark.createDataFrame(rows, "part long, whole long").select(pct_even(F.col("part"), F.col("whole"), 2)).collect()
    assert [r[0] for r in got] == [0.12, 0.06, 0.38, 0.62, 0.0]


def test_one_digit_agrees_with_exact_formatting(spark):
    rng = random.Random(1)
    values = [0.15, 0.25, 0.35, 2.4483516483516483, 0.05, 0.0, 11.14 / 4.55, 99.95] + [rng.randrange(10_000) / 100 for _ in range(2_000)] + [rng.random() * 1e6 for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", one_digit("v").alias("t")).collect()
    assert [(r.v, r.t) for r in got if r.t != f"{r.v:.1f}"] == []
