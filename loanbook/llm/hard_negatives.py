"""Hard negatives by angular triangle filtering, with exact integer scores.

Every row stores its angles to a few reference directions. For an anchor at angle s and a row at angle t to the same
reference, the angle between the two lies between |s - t| and the smaller of s + t and 2 pi - s - t; all references
together give an interval of the cosine, and the norms turn it into bounds of the score. Rows lie in windows, runs of
rows of one label that are sorted by their nearest reference and their angle to it; a window keeps the smallest and
largest angle to each reference and norm. A window is scored in integers only if its bounds overlap what an anchor
still looks for: at least the score of the last of its positives, or the range in which its negatives must lie.

Anchors go over the rows in blocks of bounded size, one pass for each block; a pass moves no vector but those of the
block, and returns a few rows for each anchor and task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanbook.llm.common import partitions, shared_folder, staged

SCALE = 256
REFERENCES = 12  # rows whose directions angles are stored to: those with the smallest hash of the key
WINDOW = 64
BLOCK_BYTES = 16 << 20  # of anchor vectors that one pass sends to the executors
SLACK_ANGLE, SLACK_SCORE = 1e-6, 1e-9  # beyond the rounding of angles and of bounds
NO_ID = 2**63 - 1
NONE = -(2**63) + 1  # stands for no score; scores lie within 2^62


@dataclass(frozen=True)
class Rule:
    positives: int = 5
    negatives: int = 3
    least: int = 50  # percent of the positive's score that a negative must reach
    most: int = 95  # and may not exceed


# -- rows -------------------------------------------------------------------------------------------------------------


def usable_rows(rows: DataFrame, key: str, vector: str, label: Column, is_anchor: Column) -> DataFrame:
    """(rid, id, label, x, anchor, norm) of the rows that take part; rid numbers them in no order."""
    entries = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    taken = rows.select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"),
        F.when(fine, F.transform(entries, lambda c: F.floor(c * SCALE))).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    squares = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    normed = taken.filter("label IS NOT NULL AND x IS NOT NULL").withColumn("norm", F.sqrt(squares))
    return normed.filter(F.col("norm") < 2.0**31).withColumn("rid", F.monotonically_increasing_id())


def reference_directions(rows: DataFrame, size: int) -> np.ndarray:
    """Unit vectors of the ``REFERENCES`` rows with the smallest hash of their id, zero vectors aside; a lone axis where
    there are none."""
    chosen = rows.filter("norm > 0").orderBy(F.xxhash64("id"), "id", "rid").select("x").limit(REFERENCES).collect()
    out = np.zeros((max(1, len(chosen)), size))
    out[0, 0] = 1.0
    for n, row in enumerate(chosen):
        out[n, :] = 0
        out[n, :len(row["x"])] = row["x"]
    return out / np.sqrt((out**2).sum(1, keepdims=True))


def matrix_of(column: pa.ListArray, size: int) -> np.ndarray:
    """Rows as a matrix; a shorter vector is followed by zeros."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    lengths = np.diff(offsets)
    if (lengths == size).all():
        return values.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = values
    return out


def angles(vectors: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles to unit references; a zero vector has any angle, as its scores are zero."""
    cosines = (vectors.astype(np.float64) @ references.T) / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1))


def with_angles(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """Rows with their angles, in sorted order over the partitions: by label, nearest reference and angle to it."""
    size = references.shape[1]
    names = rows.columns
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", angles array<double>, near int, off double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = batch.column("norm").to_numpy(zero_copy_only=False)
            found = angles(matrix_of(batch.column("x"), size), norms, references)
            near = found.argmin(1)
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(found.ravel())), pa.array(near, pa.int32()), pa.array(found.min(1))],
                [*names, "angles", "near", "off"])

    order = ["label", "near", "off", "rid"]
    return rows.mapInArrow(run, schema).repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)


# -- one pass ---------------------------------------------------------------------------------------------------------


@dataclass
class Anchors:
    """One block of anchors, sorted by label; ``wanted`` holds the scores of its positives, falling."""

    rid: np.ndarray
    label: np.ndarray
    x: np.ndarray
    norm: np.ndarray
    angles: np.ndarray
    wanted: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.rid)

    def part(self, of: np.ndarray) -> Anchors:
        return Anchors(self.rid[of], self.label[of], self.x[of], self.norm[of], self.angles[of], None if self.wanted is None else self.wanted[of])


@dataclass
class Rows:
    """One batch of rows and its windows."""

    rid: np.ndarray
    id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    norm: np.ndarray
    angles: np.ndarray

    def windows(self) -> np.ndarray:
        """Bounds of the windows: at most ``WINDOW`` rows of one label."""
        n = len(self.rid)
        new = np.flatnonzero(np.diff(self.label)) + 1
        edges = np.concatenate([[0], new, [n]])
        cuts = [np.arange(a, b, WINDOW) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return np.concatenate([*cuts, [n]])


def score_bounds(anchors: Anchors, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the score of every anchor with any row of every window, from the windows' smallest and largest angles
    and norms; safe against the rounding of all that enters them."""
    nearest = np.zeros((len(anchors), len(low)))
    farthest = np.full((len(anchors), len(low)), np.pi)
    for r in range(anchors.angles.shape[1]):
        at = anchors.angles[:, r, None]
        a, b = low[None, :, r], high[None, :, r]
        np.maximum(nearest, np.maximum(a - at, at - b), out=nearest)
        np.minimum(farthest, np.minimum(at + b, 2 * np.pi - at - a), out=farthest)
    top = np.cos(np.maximum(nearest - SLACK_ANGLE, 0))
    bottom = np.cos(np.clip(farthest + SLACK_ANGLE, 0, np.pi))
    norm = anchors.norm[:, None]
    upper = norm * np.where(top > 0, most, least) * top
    lower = norm * np.where(bottom > 0, least, most) * bottom
    slack = 1 + SLACK_SCORE * norm * most
    return lower - slack, upper + slack


def scores(rows: np.ndarray, anchors: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer inner products (anchors by rows). Doubles are exact below 2^53; otherwise 64-bit integers, whose
    partial sums may wrap around but whose result, below 2^62, does not."""
    if largest < 2.0**52:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors @ rows.T


class Best:
    """The first ``count`` rows for each of some places: falling score, then rising id, then rid."""

    def __init__(self, places: int, count: int):
        self.score = np.full((places, count), NONE)
        self.id = np.full((places, count), NO_ID)
        self.rid = np.full((places, count), -1)

    def last(self) -> np.ndarray:
        return self.score[:, -1]

    def take(self, places: np.ndarray, score: np.ndarray, rows: Rows, of: np.ndarray) -> None:
        """Enter the rows ``of``, with their scores (places by rows, ``NONE`` where one does not count). The rows
        come in the order of ids."""
        count = self.score.shape[1]
        if score.shape[1] > count:
            # The cut score of each place: what lies above it is in, of what equals it the first ones.
            cut = np.partition(score, score.shape[1] - count, axis=1)[:, score.shape[1] - count, None]
            above = score > cut
            same = score == cut
            kept = above | (same & (np.cumsum(same, 1) + above.sum(1, keepdims=True) <= count))
            at = np.flatnonzero(kept.ravel()).reshape(len(score), count) % score.shape[1]
        else:
            at = np.broadcast_to(np.arange(score.shape[1]), score.shape)
        found = np.take_along_axis(score, at, 1)
        every = [np.concatenate(p, 1) for p in ((self.score[places], found), (self.id[places], rows.id[of][at]), (self.rid[places], rows.rid[of][at]))]
        order = np.lexsort((every[2], every[1], -every[0]), axis=1)[:, :count]
        self.score[places], self.id[places], self.rid[places] = (np.take_along_axis(e, order, 1) for e in every)

    def rows(self) -> tuple[np.ndarray, ...]:
        """Place, score, id and rid of what was found."""
        place, n = np.nonzero(self.score > NONE)
        return place, self.score[place, n], self.id[place, n], self.rid[place, n]


AT_ONCE = 1 << 20  # scores computed together


def batches_of_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Rows]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            piece = batch.slice(at, 4096)
            get = lambda n: piece.column(n).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            found = piece.column("angles")
            spread = found.values.to_numpy()[found.offsets[0].as_py():found.offsets[-1].as_py()].reshape(piece.num_rows, -1)
            ids = piece.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            yield Rows(get("rid"), ids, get("label"), matrix_of(piece.column("x"), size), get("norm"), spread)


def overlapping(rows: Rows, anchors: Anchors, wanted: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, rows, scores) to look at: for blocks of anchors, the rows of the windows that any of the block
    overlaps, in the order of ids. ``wanted`` tells from the anchors' places and the windows' labels and bounds."""
    edges = rows.windows()
    starts = edges[:-1]
    low, high = np.minimum.reduceat(rows.angles, starts), np.maximum.reduceat(rows.angles, starts)
    least, most = np.minimum.reduceat(rows.norm, starts), np.maximum.reduceat(rows.norm, starts)
    step = max(1, AT_ONCE // len(rows.rid))
    for begin in range(0, len(anchors), step):
        places = np.arange(begin, min(begin + step, len(anchors)))
        block = anchors.part(places)
        bounds = score_bounds(block, low, high, least, most)
        overlap = wanted(places, rows.label[starts], bounds)
        places = places[overlap.any(1)]
        of = np.flatnonzero(np.repeat(overlap.any(0), np.diff(edges)))
        if len(places) and len(of):
            of = of[np.lexsort((rows.rid[of], rows.id[of]))]
            x = anchors.x[places]
            yield places, of, scores(rows.x[of], x, float(anchors.norm[places].max() * rows.norm[of].max()))


def _candidates(rows: DataFrame, anchors: Anchors, look: Callable[[Iterator[Rows], Anchors], Iterator[tuple]], columns: str) -> DataFrame:
    """What every task finds for a block of anchors."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)
    size = anchors.x.shape[1]
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in look(batches_of_rows(batches, size), sent.value):
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names)

    return rows.select("rid", "id", "label", "x", "norm", "angles").mapInArrow(run, columns)


def positives_of(count: int):
    def look(batches: Iterator[Rows], anchors: Anchors) -> Iterator[tuple]:
        best = Best(len(anchors), count)
        for rows in batches:
            def wanted(places, labels, bounds):
                return (anchors.label[places, None] == labels) & (bounds[1] >= best.last()[places, None].astype(np.float64))
            for places, of, score in overlapping(rows, anchors, wanted):
                other = (anchors.label[places, None] == rows.label[of]) & (anchors.rid[places, None] != rows.rid[of])
                best.take(places, np.where(other, score, NONE), rows, of)
        place, score, ids, rid = best.rows()
        yield anchors.rid[place], score, ids, rid

    return look


def negatives_of(rule: Rule):
    def look(batches: Iterator[Rows], anchors: Anchors) -> Iterator[tuple]:
        slots = anchors.wanted.shape[1]
        best = [Best(len(anchors), rule.negatives) for _ in range(slots)]
        # Whole scores within the range; products would leave 64 bits for scores beyond 2^56, so divide exactly.
        known = anchors.wanted > NONE
        ceiling = np.array([[int(w) * rule.most // 100 for w in row] for row in anchors.wanted], dtype=np.int64).reshape(anchors.wanted.shape)
        bottom = np.array([[-(-int(w) * rule.least // 100) for w in row] for row in anchors.wanted], dtype=np.int64).reshape(anchors.wanted.shape)
        open_ = known & (bottom <= ceiling)
        for rows in batches:
            def wanted(places, labels, bounds):
                out = np.zeros(bounds[0].shape, bool)
                for slot in range(slots):
                    at_least = np.maximum(bottom[places, slot], best[slot].last()[places]).astype(np.float64)
                    out |= open_[places, slot, None] & (bounds[1] >= at_least[:, None]) & (bounds[0] <= ceiling[places, slot, None].astype(np.float64))
                return out & (anchors.label[places, None] != labels)
            for places, of, score in overlapping(rows, anchors, wanted):
                other = anchors.label[places, None] != rows.label[of]
                for slot in range(slots):
                    fits = other & open_[places, slot, None] & (score <= ceiling[places, slot, None])
                    fits &= score >= np.maximum(bottom[places, slot], best[slot].last()[places])[:, None]
                    any_ = fits.any(1)
                    if any_.any():
                        best[slot].take(places[any_], np.where(fits[any_], score[any_], NONE), rows, of)
        for slot in range(slots):
            place, score, ids, rid = best[slot].rows()
            yield anchors.rid[place], np.full(len(place), slot), score, ids, rid

    return look


# -- operator ---------------------------------------------------------------------------------------------------------


def _first(found: DataFrame, by: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def _collected(rows: DataFrame, size: int, slots: int = 0) -> Anchors:
    """One block of anchors, whose size is bounded, on the driver."""
    held = rows.orderBy("label", "rid").toArrow()
    column = lambda n: pa.concat_arrays(held.column(n).chunks) if held.num_rows else pa.array([], held.schema.field(n).type)
    get = lambda n: column(n).to_numpy(zero_copy_only=False)
    spread = np.array(column("angles").to_pylist(), np.float64).reshape(held.num_rows, -1 if held.num_rows else 1)
    wanted = None
    if slots:
        wanted = np.full((held.num_rows, slots), NONE)
        for n, listed in enumerate(column("wanted").to_pylist()):
            wanted[n, :len(listed)] = listed
    return Anchors(get("rid"), get("label"), matrix_of(column("x"), size), get("norm"), spread, wanted)


def mine(rows: DataFrame, is_anchor: Column, rule: Rule = Rule(), key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Entries become floor(256 x); a score is the integer inner product. An anchor's positives are its first other rows
    of the same label, its negatives for a positive the first rows of other labels within the rule's range of the
    positive's score; first means the higher score, then the smaller id. Rows with a null label, a null vector, or a
    null or non-finite entry take no part, and neither do rows whose integer vector is 2^31 or longer, as their scores
    could leave the range of a long. Shorter vectors are followed by zeros. A null key is no anchor unless the condition
    says so, comes last among equal scores and is returned as null (the largest long as well). Rows that repeat are rows
    of their own, so a copy of an anchor is one of its positives. Other columns are not read. Without anchors, or with
    an empty table, there are no rows."""
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    taken = staged(usable_rows(rows, key, vector, label, is_anchor), "negatives-rows")
    size = max(1, taken.agg(F.max(F.size("x"))).first()[0] or 0)
    placed = staged(with_angles(taken, reference_directions(taken, size)), "negatives-placed")
    anchors = placed.filter("anchor")
    blocks = math.ceil(anchors.count() * size * 8 / block_bytes)
    # Numbers of rows are unique, so blocks by their hash are about even.
    anchors = staged(anchors.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(max(1, blocks)))), "negatives-anchors")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    path = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in range(blocks):
        asking = anchors.filter(F.col("block") == block)
        near = _candidates(placed, _collected(asking, size), positives_of(rule.positives), "anchor bigint, score bigint, id bigint, rid bigint")
        positives = staged(_first(near, ["anchor"], rule.positives).select(
            "anchor", (F.col("rank") - 1).alias("slot"), real("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"])
        wanted = positives.groupBy(F.col("anchor").alias("rid")).agg(in_order.alias("wanted"))  # at most rule.positives each
        looking = _collected(asking.join(wanted, "rid"), size, rule.positives)
        within = _candidates(placed, looking, negatives_of(rule), "anchor bigint, slot bigint, score bigint, id bigint, rid bigint")
        first = _first(within, ["anchor", "slot"], rule.negatives).select(
            "anchor", "slot", "rank", real("id").alias("negative_id"), F.col("score").alias("negative_score"))
        named = asking.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
        first.join(positives, ["anchor", "slot"]).join(named, "anchor").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score",
        ).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
