"""Exact order statistics and running totals without a single-task sort.

``percentile`` keeps every distinct value in one aggregation buffer and an
unpartitioned window sorts a whole table in one task; neither survives a large
table. The helpers here stay exact, keep every task bounded and go the same
way at every size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``,
    or the one its context was given."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def staged(df: DataFrame) -> DataFrame:
    """Write a large frame to the shared folder as Parquet and go on from the
    files: later passes read only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write a small frame to the shared folder and continue from there."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


# Methods beyond 8000 bytes of bytecode are never compiled by the JVM's JIT. A
# projection of ninety fields exceeds that as one method; with this limit Spark
# splits it into methods that do get compiled.
METHOD_LIMIT_CONF, METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit", "8000"
# A task writes the loans, records and rejects of a few pools. So many files may
# be open at a time; only beyond them are its wide rows sorted by folder first.
WRITERS_CONF, WRITERS = "spark.sql.maxConcurrentOutputFileWriters", "16"
# Tapes of ninety columns take a third less room than with the default.
CODEC_CONF, CODEC = "spark.sql.parquet.compression.codec", "zstd"


@contextmanager
def wide_rows(spark: SparkSession):
    """Session settings for jobs over all tape fields, put back afterwards."""
    wanted = {METHOD_LIMIT_CONF: METHOD_LIMIT, WRITERS_CONF: WRITERS, CODEC_CONF: CODEC}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def running_totals(df: DataFrame, order: Sequence[Column], totals: dict[str, Column]) -> DataFrame:
    """Add cumulative sums over a global order.

    ``order`` should be close to unique (group ties first), so that ranges
    split evenly. The input is range-partitioned, each range is summed, and
    the sums of the ranges before it are added to its own running total. The
    range a row fell into is written down before it is used twice.
    """
    columns = df.columns
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    per_range = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_range", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals]
    )
    window = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per range, as many as shuffle partitions.
    return placed.join(F.broadcast(offsets), "_range").select(
        *columns, *[(F.sum(c).over(window) + F.col(f"_before_{n}")).alias(n) for n, c in totals.items()]
    )


STEPS = 64  # cells of the first pass per unit of the signed logarithm; at most 91,000 a column
CELLS = 4096  # cells of a later pass per bracket


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, dict[float, float | None]]:
    """Linearly interpolated quantiles of several columns, ignoring NULL.

    A selection by digits: one grouped pass over all columns counts values in
    cells that keep their order, with the smallest and largest value of each.
    The cell that holds a wanted rank is cut into cells again, until it holds a
    single value. Cells of the first pass are steps of a signed logarithm, so
    two or three passes do for most columns whatever their range; what is
    shuffled and collected is bounded by the number of cells, not by rows.
    Infinities are ordinary values; NaN counts as the largest one.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    cells = _count_cells(df, [(c, None) for c in columns])
    found: dict[tuple[str, int], float] = {}
    pending: list[tuple[str, int, int, tuple[float, float]]] = []
    sizes = {}
    for column, counted in zip(columns, cells):
        size = sizes[column] = sum(n for _, n, _, _ in counted)
        ranks = {r for p in probabilities for r in _ranks(size, p)[:2]} if size else set()
        for rank in sorted(ranks):
            _settle(column, rank, rank, counted, found, pending)
    while pending:
        # Ranks that still share a cell share its count.
        brackets = list(dict.fromkeys((column, bracket) for column, _, _, bracket in pending))
        counted = dict(zip(brackets, _count_cells(df, brackets)))
        searches, pending = pending, []
        for column, rank, offset, bracket in searches:
            _settle(column, rank, offset, counted[column, bracket], found, pending)

    result: dict[str, dict[float, float | None]] = {}
    for column, size in sizes.items():
        result[column] = {}
        for p in probabilities:
            if not size:
                result[column][p] = None
                continue
            low, high, share = _ranks(size, p)
            a, b = found[column, low], found[column, high]
            result[column][p] = a if low == high or a == b else a + (b - a) * share
    return result


def _ranks(size: int, probability: float) -> tuple[int, int, float]:
    position = (size - 1) * probability
    low = math.floor(position)
    return low, math.ceil(position), position - low


def _cell(value: Column, bracket: tuple[float, float] | None) -> Column:
    """Number of the cell a value falls into; NULL outside the bracket. Never
    falls as the value grows."""
    infinite = F.abs(value) == float("inf")
    if bracket is None:
        step = F.floor(F.signum(value) * F.log1p(F.abs(value)) * STEPS)
        return F.when(F.isnan(value), 10**6).when(infinite, F.signum(value) * (10**6 - 1)).otherwise(step).cast("int")
    low, high = bracket
    # Halved where the width itself would overflow.
    scale = 0.5 if math.isinf(high - low) else 1.0
    share = (value * scale - low * scale) / F.lit(high * scale - low * scale)
    inside = F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int")
    return F.when(value.between(low, high), inside)


def _count_cells(
    df: DataFrame, brackets: Sequence[tuple[str, tuple[float, float] | None]]
) -> list[list[tuple[int, int, float, float]]]:
    """Cells of each bracket in order: (cell, rows, smallest, largest value)."""
    entries = []
    for i, (column, bracket) in enumerate(brackets):
        value = F.col(f"`{column}`").cast("double")
        entries.append(F.struct(F.lit(i).alias("i"), value.alias("v"), _cell(value, bracket).alias("cell")))
    values = df.select(F.explode(F.array(*entries)).alias("_entry")).select("_entry.*")
    counted = values.filter("cell IS NOT NULL").groupBy("i", "cell").agg(
        F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    cells: list[list[tuple[int, int, float, float]]] = [[] for _ in brackets]
    for i, cell, n, low, high in sorted(counted.filter("n > 0").collect(), key=lambda r: (r[0], r[1])):
        cells[i].append((cell, n, low, high))
    return cells


def _settle(column: str, rank: int, offset: int, cells: list, found: dict, pending: list) -> None:
    """The value of a rank where its cell holds one, else the cell to cut."""
    for _, n, low, high in cells:
        if offset < n:
            if low == high or math.isnan(high):
                found[column, rank] = low
            else:
                pending.append((column, rank, offset, (low, high)))
            return
        offset -= n
