import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanbook.functions import ordered
from loanbook.functions.ordered import exact_quantiles, running_totals
from loanbook.operators.scoring import auc, lift_table, score_curve


def numbers(kind, n=20_000):
    rng = random.Random(7)
    if kind == "spread":
        return [rng.gauss(0, 1e6) for _ in range(n)]
    if kind == "hot":  # two values hold most rows, right at the median
        return [rng.choice([3.0, 3.0, 3.0, 4.0, 4.0, 4.0, rng.random() * 9]) for _ in range(n)]
    if kind == "constant":
        return [5.0] * n
    return [float(rng.randrange(50)) for _ in range(n)] + [None] * 300


@pytest.mark.parametrize("kind", ["spread", "hot", "constant", "few"])
def test_quantiles_equal_a_full_sort(spark, kind):
    values = numbers(kind)
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(6)
    probabilities = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = exact_quantiles(df, ["v"], probabilities)["v"]
    known = np.array([v for v in values if v is not None])
    for p in probabilities:
        assert got[p] == pytest.approx(float(np.quantile(known, p)), rel=1e-12, abs=1e-9)


@pytest.mark.parametrize(
    "values",
    [
        [-1.7e308, 1.7e308, 0.0, -0.0, 5e-324, 1e-300, -5e-324],
        [float("-inf"), 1.0, 2.0, 3.0, float("inf")],
        [1.0 + k * 2.0**-52 for k in range(40)] + [1e12],
        [-3.5, -3.25, -1e-9, 1e-9, 7.0, 7.0],
        [10.0**k for k in range(-300, 300)],
    ],
)
def test_quantiles_of_any_range(spark, values):
    df = spark.createDataFrame([(v, v) for v in values], "v double, w double").repartition(3)
    whole = [k / (len(values) - 1) for k in range(len(values))][:60]
    got = exact_quantiles(df, ["v", "w", "v"], whole)
    for k, p in enumerate(whole):
        low, high = sorted(values)[math.floor(p * (len(values) - 1))], sorted(values)[math.ceil(p * (len(values) - 1))]
        assert low <= got["v"][p] <= high and got["v"][p] == got["w"][p]


def test_quantiles_take_few_passes(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.lognormvariate(11, 1), rng.randrange(300, 850), round(rng.uniform(2, 9), 3)) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "balance double, score int, rate double").repartition(6)
    passes = []
    count = ordered._count_cells
    monkeypatch.setattr(ordered, "_count_cells", lambda *a: passes.append(1) or count(*a))
    got = exact_quantiles(df, df.columns, [0.05, 0.5, 0.95])
    assert len(passes) <= 4
    for i, c in enumerate(df.columns):
        for p, value in got[c].items():
            assert value == pytest.approx(float(np.quantile([r[i] for r in rows], p)), rel=1e-12)


def test_nan_is_the_largest_value(spark):
    df = spark.createDataFrame([(v,) for v in (float("nan"), 1.0, 2.0)], "v double")
    got = exact_quantiles(df, ["v"], [0.0, 0.5, 1.0])["v"]
    assert got[0.0] == 1.0 and got[0.5] == 2.0 and math.isnan(got[1.0])


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, ["v"], [0.5]) == {"v": {0.5: None}}


def test_running_totals_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.random(), rng.randrange(5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k double, w long").repartition(5)
    out = running_totals(df, [F.desc("k")], {"upto": F.col("w"), "n": F.lit(1)})
    got = [(r["upto"], r["n"]) for r in out.orderBy(F.desc("k")).collect()]
    total, expected = 0, []
    for i, (_, w) in enumerate(sorted(rows, reverse=True), 1):
        total += w
        expected.append((total, i))
    assert got == expected


def scored(spark, n=3_000, levels=7, hot=True):
    """Scores with many ties; one score holds a third of the loans."""
    rng = random.Random(11)
    rows = []
    for i in range(n):
        score = 0.75 if hot and i % 3 == 0 else rng.randrange(levels) / levels
        rows.append((f"L{rng.randrange(10**9):09d}{i}", score, int(rng.random() < 0.1 + 0.3 * score)))
    return rows, spark.createDataFrame(rows, "loan_id string, score double, label int").repartition(4)


def test_lift_equals_a_full_sort(spark):
    rows, df = scored(spark)
    got = {r["top_pct"]: tuple(r) for r in lift_table(df, (1, 5, 10, 20, 40, 100)).collect()}
    ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
    positives = sum(r[2] for r in rows)
    for pct in (1, 5, 10, 20, 40, 100):
        n = max(1, int(len(rows) * pct / 100))
        caught = sum(r[2] for r in ranked[:n])
        assert got[pct][:3] == (pct, n, caught)
        assert got[pct][3] == pytest.approx(100 * caught / positives, abs=0.051)


def test_auc_equals_all_pairs(spark):
    rows, df = scored(spark, 400)
    wins = pairs = 0.0
    for _, a, pos in rows:
        for _, b, neg in rows:
            if pos and not neg:
                pairs += 1
                wins += 1.0 if a > b else 0.5 if a == b else 0.0
    got = auc(score_curve(df)).first()[0]
    assert got == pytest.approx(wins / pairs, abs=5.1e-5)


def test_lift_of_nothing(spark):
    df = spark.createDataFrame([], "loan_id string, score double, label int")
    assert lift_table(df).count() == 0
