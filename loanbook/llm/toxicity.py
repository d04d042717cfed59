"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its terms (runs of letters and digits, lower case, and their stems), hashed into a fixed number of cells. The
score is logistic in a bias, one weight per cell and the inner products of the cells' factor vectors over all pairs,
so that two terms can mean more together than apart. Terms are cut and hashed inside Spark; the machine is fitted on
a bounded sample of labelled rows (``FitSettings.rows``, chosen by a hash of the id) and every text is scored where
it lies. Only the fitted cells, at most as many as the sample's terms, are sent to the executors.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


STEM = 5


@dataclass(frozen=True)
class FitSettings:
    rows: int = 12_000  # labelled rows the machine is fitted on
    cells: int = 1 << 20
    factors: int = 4
    rounds: int = 30
    batch: int = 256
    rate: float = 0.05
    weight_decay: float = 1e-4
    least_rows: int = 4  # of the sample, that a cell must occur in to count
    least_association: float = 15.0  # chi-square of cell and label; what chance ties to the label stays below
    seed: int = 7


@dataclass
class Machine:
    """``cells`` are the fitted cells, ascending, of ``size`` ones that terms are hashed into; all others weigh nothing."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    cells: np.ndarray
    size: int

    def placed(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the fitted ones among the texts' cells, and the new offsets."""
        if not len(self.cells):
            return np.empty(0, np.int64), np.zeros_like(offsets)
        at = np.minimum(np.searchsorted(self.cells, flat), len(self.cells) - 1)
        known = self.cells[at] == flat
        return at[known], np.concatenate([[0], np.cumsum(known)])[offsets]

    def margins(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Margins of several texts; the places of their cells lie one after the other in ``flat``."""
        linear = _sums(self.weights[flat], offsets)
        vectors = self.factors[flat]
        total = _sums(vectors, offsets)
        pairs = 0.5 * ((total**2).sum(1) - _sums((vectors**2).sum(1), offsets))
        return self.bias + linear + pairs

    def scores(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(flat, offsets), -30, 30)))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over the pieces of ``values``; empty pieces give zero."""
    running = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def with_term_cells(df: DataFrame, text: str, cells: int, into: str = "_cells") -> DataFrame:
    """Add the distinct hashed terms of the whole text, ascending; none for a null or empty text.

    Terms are the words, their stems (the first ``STEM`` letters of longer words), and the stems that two or four
    different words share: a word that is new keeps its stem, and a stem that comes again says more."""
    # Each part is bound once by a lambda, so that a text is cut once wherever the plan evaluates the expression.
    bound = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    hashed = lambda kind, parts: F.transform(parts, lambda t: F.pmod(F.xxhash64(F.lit(kind), t), F.lit(cells)).cast("int"))
    stems = lambda terms: F.array_sort(F.transform(F.filter(terms, lambda t: F.length(t) > STEM), lambda t: F.substring(t, 1, STEM)))
    # In sorted order a stem of n words equals the one n - 1 places on.
    shared = lambda of, n: F.array_compact(F.zip_with(of, F.slice(of, n, F.size(of)), lambda a, b: F.when(a == b, a)))
    found = lambda terms: bound(stems(terms), lambda of: F.concat(
        hashed("_terms", terms), hashed("_stems", of), hashed("_twice", shared(of, 2)), hashed("_often", shared(of, 4))))
    terms = F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")), "")
    # A generator of one row: its result is a column that no later projection folds into a function's arguments.
    return df.drop(into).select("*", F.explode(F.array(F.array_sort(F.array_distinct(bound(terms, found))))).alias(into))


def fit(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id", settings: FitSettings = FitSettings()) -> Machine:
    """Fit on the texts of at most ``settings.rows`` labelled keys, the ones whose hashed key is smallest.

    Only keys and labels are ordered; texts are looked up for the chosen ones. A key counts once: of repeated labels
    the larger and of repeated texts the smaller one. Rows without key or label are left out. Without any usable row
    every score is one half."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("_label"))
    chosen = usable.orderBy(F.xxhash64(F.col(key), F.lit(settings.seed)), key).limit(settings.rows)
    texts = docs.select(key, F.col(text).alias("_text")).join(chosen, key)
    sample = texts.groupBy(key, "_label").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"))
    rows = with_term_cells(sample, "_text", settings.cells).select(key, "_label", "_cells").toArrow().sort_by(key)
    if rows.num_rows == 0:
        return Machine(0.0, np.empty(0), np.empty((0, settings.factors)), np.empty(0, np.int32), settings.cells)
    labels = rows.column("_label").to_numpy().astype(np.float64)
    cells = rows.column("_cells").combine_chunks()
    offsets = cells.offsets.to_numpy().astype(np.int64)
    return descend(cells.values.to_numpy(), offsets, labels, settings)


def screened(flat: np.ndarray, offsets: np.ndarray, labels: np.ndarray, settings: FitSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells that are frequent enough and associated with the label; each text's places in them, and the new offsets."""
    row = np.repeat(np.arange(len(labels)), np.diff(offsets))
    cells, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    n, positive = float(len(labels)), float(labels.sum())
    both = np.bincount(place, labels[row], minlength=len(cells))
    spread = count * (n - count) * positive * (n - positive)
    association = n * (both * n - count * positive) ** 2 / np.maximum(spread, 1.0)
    kept = (count >= settings.least_rows) & (association >= settings.least_association)
    inside = kept[place]
    lengths = np.bincount(row[inside], minlength=len(labels))
    return cells[kept], (np.cumsum(kept) - 1)[place[inside]], np.concatenate([[0], np.cumsum(lengths)])


def descend(flat: np.ndarray, offsets: np.ndarray, labels: np.ndarray, settings: FitSettings) -> Machine:
    """Mini-batch descent with moment-scaled steps on the logistic loss, over the screened cells."""
    cells, place, offsets = screened(flat, offsets, labels, settings)
    rng = np.random.default_rng(settings.seed)
    rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    own = Machine(float(np.log(rate / (1 - rate))), np.zeros(len(cells)), rng.normal(0, 0.01, (len(cells), settings.factors)), cells, settings.cells)
    parameters = np.column_stack([own.weights, own.factors])
    mean, square = np.zeros_like(parameters), np.zeros_like(parameters)
    speed = np.array([1.0] + [0.3] * settings.factors) * settings.rate
    step = 0
    for _ in range(settings.rounds):
        for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // settings.batch)):
            step += 1
            lengths = offsets[part + 1] - offsets[part]
            starts = np.concatenate([[0], np.cumsum(lengths)])
            row = np.repeat(np.arange(len(part)), lengths)
            at = place[np.repeat(offsets[part] - starts[:-1], lengths) + np.arange(starts[-1])]
            own = Machine(own.bias, parameters[:, 0], parameters[:, 1:], cells, settings.cells)
            error = (own.scores(at, starts) - labels[part]) / len(part)
            vectors = own.factors[at]
            each = np.column_stack([error[row], error[row][:, None] * (_sums(vectors, starts)[row] - vectors)])
            gradient = np.column_stack([np.bincount(at, each[:, k], len(cells)) for k in range(each.shape[1])]).astype(float)
            gradient += settings.weight_decay * parameters
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            parameters -= speed * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-5)
            own.bias -= settings.rate * error.sum()
    return Machine(own.bias, parameters[:, 0], parameters[:, 1:], cells, settings.cells)


def score(docs: DataFrame, machine: Machine, text: str = "text", into: str = "score") -> DataFrame:
    """Add the score (0 to 1) of the whole text; other columns pass through, whatever their names.

    A null or empty text has no terms and gets the score of the bias. Rows are independent: repeats, ties and empty
    tables need nothing, and a column already named like ``into`` is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    own_cells = f"_cells_{uuid.uuid4().hex}"

    @F.arrow_udf("double")
    def of_cells(column: pa.Array) -> pa.Array:
        own, scores = sent.value, []
        for at in range(0, len(column), 250):
            piece = column.slice(at, 250)
            offsets = piece.offsets.to_numpy().astype(np.int64)
            flat, starts = own.placed(piece.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0])
            scores.append(own.scores(flat, starts))
        return pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())

    # Only cells go to Python; the other columns stay where they are.
    return with_term_cells(docs.drop(into), text, machine.size, own_cells).withColumn(into, of_cells(own_cells)).drop(own_cells)
