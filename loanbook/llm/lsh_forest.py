"""Near-duplicate documents by an LSH forest of MinHash signatures, links confirmed on full sets.

Each document is the set of its distinct word shingles. Equal sets form a class, and only classes go on. A signature
holds ``SYMBOLS`` MinHash values; each of ``TREES`` orders sorts the classes by the signature read from another place on,
so that neighbours share the longest prefixes. A class is compared with its ``WIDTH`` neighbours in each order: where few
share a symbol that reaches to depth one, where many do only as deep as the order separates them. A first pass over
signatures alone finds the pairs that may be linked; full sets are then made for their classes, and each pair is confirmed
on them. Orders are dealt by ranges of whole signatures, so a crowd of near copies is many tasks.

In an order a class meets all that share a longer prefix with it than the last neighbour of its window. From the lengths
of these prefixes follows the chance that a link at the bound of similarity has been missed in all orders. Where many
texts share boilerplate the prefixes are long and the chance is too high: such classes take their sets along into passes
with fresh hash functions, until the chance is below ``MISS`` for each of them. So the number of orders grows with the
group. A link is covered as soon as it is for one of its two classes, so classes that are done leave the passes.

Classes in crowds, that is with more than ``CROWD`` similar ones after them in an order, are not paired one by one but
take part in the passes, where neighbours are compared unless they are connected already. The passes go on while they
bring links or settle classes. What then may still be missing is found exactly: among the classes that are not done, two linked ones share one
of their rarest shingles (``hidden_pairs``), and those of different components that do are compared on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanbook.llm.common import partitions, staged, words
from loanbook.llm.components import components

TREES = 12
STEP = 6  # symbols between the beginnings of two orders
SYMBOLS = TREES * STEP
WIDTH = 64
CROWD = 8
CROWD_WIDTH = 256
CROWD_STEP = 12  # fewer orders for classes that take their sets along; the passes are repeated instead
UNEQUAL = 1e-7  # chance that a pair at the bound of similarity has fewer equal symbols than are asked for
MISS = 1e-6  # chance that a link is missed, from which a class goes into no further pass
STILL = 0.8  # share of classes left, from which a pass without new links is the last one
CHUNK = 8192  # shingles hashed at once


@dataclass(frozen=True)
class Likeness:
    """Linked are two sets with ``whole`` * intersection >= ``part`` * union, shingles have ``words`` words."""

    words: int = 3
    part: int = 85
    whole: int = 100

    @property
    def least_equal(self) -> int:
        """Equal symbols that are asked of a pair: 43 of 72 for a similarity of 0.85, 38 for 0.8."""
        share, below = self.part / self.whole, 0.0
        for k in range(SYMBOLS):
            below += comb(SYMBOLS, k) * share**k * (1 - share) ** (SYMBOLS - k)
            if below > UNEQUAL:
                return k
        return SYMBOLS


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: words between ASCII blanks, A-Z lower-cased. Fewer words than a
    shingle count as one whole; without words the set is empty."""
    from xxhash import xxh3_64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < width:
        return np.array([xxh3_64_intdigest(b" ".join(found), len(found))], np.uint64)
    hashed = np.array([xxh3_64_intdigest(w) for w in found], np.uint64)
    n = len(hashed) - width + 1
    mixed = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            mixed = (mixed ^ hashed[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(shingles: np.ndarray, seed: int) -> bytes:
    """MinHash symbols of 16 bits, big endian."""
    factors = np.random.default_rng([seed, 1]).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), CHUNK):
            np.minimum(least, (shingles[None, at : at + CHUNK] * factors[:, None]).min(axis=1), out=least)
        # The smallest values have few high bits: the symbol takes bits from all over.
        least = (least ^ (least >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (least >> np.uint64(48)).astype(">u2").tobytes()


def sketched(docs: DataFrame, like: Likeness, seed: int = 0) -> DataFrame:
    """(row, doc_id, n_shingles, set_id, sig) of frames with (row, doc_id, text); an empty set has a null set_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, signs = [], [], []
            for text in batch.column("text"):
                own = shingle_set(text.as_py(), like.words)
                sizes.append(len(own))
                names.append(set_name(own))
                signs.append(signature(own, seed) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(signs, pa.binary())],
                ["row", "doc_id", "n_shingles", "set_id", "sig"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row string, doc_id long, n_shingles long, set_id binary, sig binary")


def _orders(classes: DataFrame, step: int) -> DataFrame:
    """Each class once per order: the tree, and the signature rotated to the tree's beginning."""
    rotated = F.transform(F.sequence(F.lit(0), F.lit(SYMBOLS // step - 1)), lambda t: F.struct(
        t.alias("tree"),
        F.concat(F.substring("sig", t * (2 * step) + 1, F.lit(2 * SYMBOLS)), F.substring("sig", F.lit(1), t * (2 * step))).alias("key")))
    dealt = classes.withColumn("_o", F.explode(rotated)).select("*", "_o.tree", "_o.key").drop("_o", "sig")
    n = partitions(classes.sparkSession)
    return dealt.repartitionByRange(n, "tree", "key", "set_id").sortWithinPartitions("tree", "key", "set_id")


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, SYMBOLS)


def _near(keys: np.ndarray, trees: np.ndarray, sizes: np.ndarray, by: int, like: Likeness, roots: np.ndarray | None = None) -> np.ndarray:
    """Places i for which the rows i and i + by may be linked: one order, a common first symbol, enough equal symbols,
    sizes that allow it and, where ``roots`` are given, different ones."""
    small, big = np.minimum(sizes[:-by], sizes[by:]), np.maximum(sizes[:-by], sizes[by:])
    may = (trees[:-by] == trees[by:]) & (keys[:-by, 0] == keys[by:, 0]) & (like.whole * small >= like.part * big)
    open_ = np.flatnonzero(may if roots is None else may & (roots[:-by] != roots[by:]))
    equal = np.empty(len(open_), np.int64)
    for at in range(0, len(open_), 65_536):
        i = open_[at : at + 65_536]
        equal[at : at + 65_536] = (keys[i] == keys[i + by]).sum(axis=1)
    return open_[equal >= like.least_equal]


def _shared(keys: np.ndarray, trees: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Lengths of the prefixes that the rows ``one`` and ``two`` share, 0 across orders."""
    differ = keys[one] != keys[two]
    return np.where(trees[one] != trees[two], 0, np.where(differ.any(axis=1), differ.argmax(axis=1), SYMBOLS))


class Depths:
    """Which prefixes a class must share with another to meet it, for the rows of a task in order.

    All that share a longer prefix than the neighbour ``width`` places on, on either side, lie between. At the ends of the
    task the outermost row takes the place of that neighbour, as nothing beyond it shares more; what the outermost
    rows themselves miss is not known."""

    def __init__(self, width: int):
        self.width, self.before = width, np.empty(0, np.int64)

    def met(self, keys: np.ndarray, trees: np.ndarray, names: list[bytes], last: bool = False) -> pa.RecordBatch:
        """Rows (a, b null, tree, depth) for which more than the first symbol is needed, 0 where nothing is known. Of the
        given rows the first ones, at most ``width``, were the last ones of the call before."""
        n, old = len(names), len(self.before)
        fresh = np.arange(old, n)
        before = np.concatenate([self.before, _shared(keys, trees, fresh, np.maximum(fresh - self.width, 0))])
        if old == 0 and n:
            before[0] = SYMBOLS
        done = np.arange(n if last else max(0, n - self.width))
        after = _shared(keys, trees, done, np.minimum(done + self.width, n - 1))
        if last and n:
            after[-1] = SYMBOLS
        depth = np.maximum(before[done], after) + 1
        self.before = before[-self.width :]
        told = np.flatnonzero(depth > 1)
        return pa.RecordBatch.from_arrays([
            pa.array([names[i] for i in told], pa.binary()), pa.nulls(len(told), pa.binary()), pa.array(trees[told], pa.int32()),
            pa.array(np.where(depth[told] > SYMBOLS, 0, depth[told]), pa.int32())], FOUND)


FOUND = ["a", "b", "tree", "depth"]
FOUND_TYPE = "a binary, b binary, tree int, depth int"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    nothing = pa.nulls(len(rows), pa.int32())
    return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)), nothing, nothing], FOUND)


def chances(classes: DataFrame, found: DataFrame, like: Likeness, step: int) -> DataFrame:
    """(set_id, missed): the logarithm of the chance that all orders of a pass keep a class from one that it is linked
    with at the bound of similarity.

    Orders count with each other as far as they read different symbols: of those that need at most c * step symbols,
    every c-th one, which is no better than the mean over all of them."""
    trees, share = SYMBOLS // step, like.part / like.whole
    miss = F.log(1 - F.pow(F.lit(share), F.col("depth")))
    apart = [c for c in range(1, trees + 1) if trees % c == 0]
    told = found.filter("tree IS NOT NULL").groupBy(F.col("a").alias("set_id")).agg(
        F.count(F.lit(1)).alias("told"), *[F.sum(F.when(F.col("depth").between(1, c * step), miss).otherwise(0.0)).alias(f"_{c}") for c in apart])
    rest = (trees - F.coalesce("told", F.lit(0))) * float(np.log(1 - share)) if share < 1 else F.lit(-np.inf)
    return classes.select("set_id").join(told, "set_id", "left").select(
        "set_id", F.least(*[(F.coalesce(f"_{c}", F.lit(0.0)) + rest) / c for c in apart], F.lit(0.0)).alias("missed"))


def similar_pairs(classes: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of classes that may be linked; with b and tree null, a class in a crowd, whose pairs are left out;
    with tree, what prefix a class must share with another to meet it in this order (``Depths``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, trees, sizes, names = np.empty((0, SYMBOLS), ">u2"), np.empty(0, np.int32), np.empty(0, np.int64), []
        depths = Depths(WIDTH)
        for batch in batches:
            keys = np.concatenate([keys, _symbols(batch.column("key"))])
            trees = np.concatenate([trees, batch.column("tree").to_numpy()])
            sizes = np.concatenate([sizes, batch.column("n_shingles").to_numpy()])
            names = [*names, *batch.column("set_id").to_pylist()]
            found = [(i, i + by) for by in range(1, min(WIDTH, len(names) - 1) + 1) for i in _near(keys, trees, sizes, by, like).tolist()]
            after = np.bincount([i for i, _ in found], minlength=len(names)) if found else np.zeros(len(names), np.int64)
            crowd = {x for pair in found if after[pair[0]] > CROWD for x in pair}
            rows = [(min(names[i], names[j]), max(names[i], names[j])) for i, j in found if after[i] <= CROWD] + [(names[i], None) for i in crowd]
            if rows:
                yield _found(rows)
            yield depths.met(keys, trees, names)
            keys, trees, sizes, names = keys[-WIDTH:], trees[-WIDTH:], sizes[-WIDTH:], names[-WIDTH:]
        yield depths.met(keys, trees, names, last=True)

    return _orders(classes.select("set_id", "n_shingles", "sig"), STEP).mapInArrow(run, FOUND_TYPE).distinct()


def _linked(a: np.ndarray, b: np.ndarray, like: Likeness) -> bool:
    common = len(a) + len(b) - len(np.union1d(a, b))
    return like.whole * common >= like.part * (len(a) + len(b) - common)


def confirmed_pairs(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""
    one = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_linked(np.asarray(x.values), np.asarray(y.values), like) for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def crowd_links(classes: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) of the roots of neighbours in the orders whose full sets are linked, and with tree, what prefix a
    class must share with another to meet it in this order; ``classes`` has (set_id, sig, shingles, root).

    Classes that share a root already, or were linked within the task, are not compared again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, trees, names, sets = np.empty((0, SYMBOLS), ">u2"), np.empty(0, np.int32), [], []
        roots: list[bytes] = []
        number: dict[bytes, int] = {}  # of each root
        parent: list[int] = []
        depths = Depths(CROWD_WIDTH)

        def top(x: int) -> int:
            while (up := parent[x]) != x:
                parent[x] = parent[up]
                x = up
            return x

        def numbered(root: bytes) -> int:
            if root not in number:
                number[root] = len(parent)
                parent.append(len(parent))
            return top(number[root])

        for batch in batches:
            keys = np.concatenate([keys, _symbols(batch.column("key"))])
            trees = np.concatenate([trees, batch.column("tree").to_numpy()])
            names, roots = [*names, *batch.column("set_id").to_pylist()], [*roots, *batch.column("root").to_pylist()]
            sets = [*sets, *(np.asarray(s.values) for s in batch.column("shingles"))]
            sizes = np.array([len(s) for s in sets], np.int64)
            codes = np.array([numbered(r) for r in roots], np.int64)
            rows = []
            for by in range(1, min(CROWD_WIDTH, len(names) - 1) + 1):
                for i in _near(keys, trees, sizes, by, like, codes).tolist():
                    x, y = codes[i], codes[i + by]
                    if x != y and _linked(sets[i], sets[i + by], like):
                        parent[y] = x
                        codes[codes == y] = x
                        rows.append((roots[i], roots[i + by]))
            if rows:
                yield _found(rows)
            yield depths.met(keys, trees, names)
            keys, trees, names, sets, roots = keys[-CROWD_WIDTH:], trees[-CROWD_WIDTH:], names[-CROWD_WIDTH:], sets[-CROWD_WIDTH:], roots[-CROWD_WIDTH:]
        yield depths.met(keys, trees, names, last=True)

    return _orders(classes, CROWD_STEP).mapInArrow(run, FOUND_TYPE).distinct()


def hidden_pairs(classes: DataFrame, like: Likeness) -> DataFrame:
    """All pairs (a, b) of classes with different roots that may be linked; ``classes`` has (set_id, shingles, root).

    Linked sets share at least part / whole of the larger one's shingles. So in one common order each set's first ones,
    as many as may be missing and one more, hold a common one; the order is by rarity, which leaves what many share for the end.
    Shingles of one root only are left out before the join."""
    held = staged(classes.select("set_id", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "near-held")
    rarity = staged(held.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"), (F.min("root") != F.max("root")).alias("mixed")), "near-rarity")
    first = F.col("n") - F.ceil(F.col("n") * like.part / like.whole - 1e-9).cast("int") + 1
    ranked = held.join(rarity, "shingle").groupBy("set_id", "root", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "shingle", "mixed"))).alias("by_rarity"))
    rare = ranked.select("set_id", "root", "n", F.explode(F.slice("by_rarity", F.lit(1), first)).alias("r")).filter("r.mixed")
    # Stored, so that a shingle of very many sets can be split in the join.
    rare = staged(rare.select("set_id", "root", "n", "r.shingle"), "near-rare")
    one, two = (rare.select("shingle", F.col("set_id").alias(x), F.col("root").alias(f"root_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    small, big = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return one.join(two, "shingle").filter((F.col("root_a") < F.col("root_b")) & (small * like.whole >= big * like.part)).select("a", "b").distinct()


def set_name(shingles: np.ndarray) -> bytes | None:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _full_sets(docs: DataFrame, like: Likeness) -> DataFrame:
    """The sets of (set_id, text); a text with another set, whose row only shares the id of the chosen one, goes. Where
    set_id is null, the set as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                piece = batch.slice(at, 200)
                made = [(n, shingle_set(t, like.words)) for n, t in zip(piece.column("set_id").to_pylist(), piece.column("text").to_pylist(), strict=True)]
                made = [(name, s) for n, s in made if (name := set_name(s)) and n in (None, name)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for _, s in made])]).astype(np.int32)
                values = np.concatenate([np.empty(0, np.uint64), *[s for _, s in made]]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _ in made], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["set_id", "shingles"])

    return docs.select("set_id", "text").mapInArrow(run, "set_id binary, shingles array<long>")


def _resigned(classes: DataFrame, seed: int) -> DataFrame:
    """The classes with signatures of fresh hash functions."""
    schema = classes.select("set_id", "shingles", "root", F.lit(b"").alias("sig")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = [signature(np.asarray(s.values).view(np.uint64), seed) for s in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("set_id", "shingles", "root")), pa.array(signs, pa.binary())], ["set_id", "shingles", "root", "sig"])

    return classes.select("set_id", "shingles", "root").mapInArrow(run, schema)


def _moved(roots: DataFrame, merged: DataFrame) -> DataFrame:
    """The roots (node, root) after some of them have moved to others: ``merged`` has a row for each root concerned."""
    moves = merged.select(F.col("node").alias("_old"), F.col("root").alias("_new"))
    known = roots.join(moves, F.col("root") == F.col("_old"), "left").select("node", F.coalesce("_new", "root").alias("root"))
    return known.unionByName(merged.join(roots.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, like: Likeness = Likeness(), key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per row: (row, doc_id, n_shingles, set_id, component, component_id, kept).

    ``row`` names a column that tells rows apart and is carried through; without one it is null. component names the
    component of a non-empty set, component_id is its smallest doc_id (null if it has none) and kept says that this is
    the row's own. A null, empty or blank text is linked with nothing and keeps itself. Rows with equal sets, repeated
    rows among them, are one class. Other columns are not read, so their names cannot clash."""
    given = docs.select((F.col(row).cast("string") if row else F.lit(None).cast("string")).alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = staged(sketched(given, like), "near-sketches")
    classes = sketches.filter("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    found = staged(similar_pairs(classes, like), "near-pairs")
    pairs = found.filter("b IS NOT NULL").select("a", "b")
    crowd = found.filter("b IS NULL AND tree IS NULL").select(F.col("a").alias("set_id"), F.lit(True).alias("crowd")).distinct()
    enough = float(np.log(MISS))
    # The classes that further passes are for. Pairs of crowds have not been compared yet.
    left = staged(chances(classes, found, like, STEP).join(crowd, "set_id", "left").filter(
        (F.col("missed") > enough) | F.col("crowd")).select(
        "set_id", F.when(F.col("crowd"), 0.0).otherwise(F.col("missed")).alias("missed"), F.coalesce("crowd", F.lit(False)).alias("crowd")), "near-left")

    # Full sets of the classes in question, from one row each.
    asked = left.select("set_id").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("set_id"))).distinct()
    wanted = classes.select("set_id", F.col("first").alias("_id")).join(asked, "set_id")
    texts = given.join(wanted, F.col("doc_id") == F.col("_id")).select("set_id", "text")
    # Rows without an id cannot be looked up: their sets are made anew and kept where they are asked for.
    unnamed = _full_sets(given.filter("doc_id IS NULL").select(F.lit(None).cast("binary").alias("set_id"), "text"), like).join(asked, "set_id")
    sets = staged(_full_sets(texts, like).unionByName(unnamed).dropDuplicates(["set_id"]), "near-sets")

    links = staged(confirmed_pairs(pairs, sets, like), "near-links")
    roots = staged(components(links, "a", "b"), "near-roots")
    seed, settled = 0, False
    while n := left.count():
        theirs = sets.join(left.select("set_id"), "set_id").join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        if settled:
            # Every link that is still missing is one of two classes that are not done, or covered already.
            met = confirmed_pairs(hidden_pairs(theirs, like), sets, like)
            top = theirs.select("set_id", "root")
            more = met.join(top.toDF("a", "root_a"), "a").join(top.toDF("b", "root_b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
            more, left = staged(more.distinct(), "near-links"), left.limit(0)
        else:
            seed += 1
            found = staged(crowd_links(_resigned(theirs, seed), like), "near-links")
            more = found.filter("b IS NOT NULL").select("a", "b")
            now = chances(left, found, like, CROWD_STEP).withColumnRenamed("missed", "_now")
            left = staged(left.join(now, "set_id").select("set_id", (F.col("missed") + F.col("_now")).alias("missed"), "crowd").filter(
                F.col("missed") > enough), "near-left")
            settled = more.isEmpty() and left.count() > STILL * n
        if not more.isEmpty():
            roots = staged(_moved(roots, components(more, "a", "b")), "near-roots")

    names = classes.select("set_id", "first").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("root", "set_id"))
    smallest = names.groupBy("component").agg(F.min("first").alias("component_id"))
    # Stored, so that the rows of a class with very many copies can be split in the join.
    placed = staged(names.select("set_id", "component").join(smallest, "component"), "near-placed")
    result = sketches.drop("sig").join(placed, "set_id", "left")
    own = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select("row", "doc_id", "n_shingles", "set_id", "component", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def one_of_each(docs: DataFrame, like: Likeness = Likeness(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with one of each component of near-duplicates: the one of smallest id, not null, where there is a choice.

    Rows without words are linked with nothing and all stay; a row repeated with id and text stays once."""
    named = docs.withColumn("_row", F.xxhash64(text).cast("string"))
    blank = F.size(words(F.col(text))) == 0
    found = near_duplicates(named.filter(~blank), like, key, text, "_row").select("row", F.col("doc_id").alias("_id"), "component")
    chosen = found.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "row")).alias("c")).select("c._id", F.col("c.row").alias("_of"))
    mine = (F.col(key).cast("long").eqNullSafe(F.col("_id"))) & (F.col("_row") == F.col("_of"))
    kept = named.filter(~blank).join(chosen, mine, "left_semi").dropDuplicates([key, "_row"])
    return kept.unionByName(named.filter(blank)).select(docs.columns)
