"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is a sequence of words. Of every run of ``K`` = 6 words the five inner pairs of words are hashed; the run is an
anchor when the smallest pair lies at an edge. Whether a run is an anchor depends on its own words alone, so an edit
moves no anchor outside the runs that it touches. Four empty pairs in front of the text count as smallest: the runs
that begin the text are always anchors, and texts of a few words have some too. The fingerprint keeps the
``SKETCH`` smallest anchor hashes of the whole text, and the likeness of two fingerprints is the share of common
hashes among the smallest of their union, an estimate of the overlap of the anchor sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from loanbook.llm.common import partitions, words

K = 6
SKETCH = 64
HASH_BITS = 40
SMALLEST = -(1 << 63)


def with_anchors(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add the anchors of the whole text: an array of (position, hash) in text order, positions in words from 0.

    A null, empty or blank text has none."""
    word, pair, two, four, run = (f"_{into}_{n}" for n in ("word", "pair", "two", "four", "run"))
    following = lambda a, by: F.slice(F.col(a), by + 1, F.size(a))
    zipped = (
        df.withColumn(word, F.concat(F.array(F.lit(0).cast("long")), F.transform(words(F.col(text)), lambda w: F.xxhash64(w))))
        .withColumn(pair, F.zip_with(F.slice(F.col(word), 1, F.size(word) - 1), following(word, 1), lambda a, b: F.xxhash64(a, b)))
        .withColumn(pair, F.concat(F.array_repeat(F.lit(SMALLEST).cast("long"), K - 2), F.col(pair)))
        # Smallest of two and of four neighbours; the missing ones behind the end are null, which least() skips.
        .withColumn(two, F.zip_with(F.col(pair), following(pair, 1), lambda a, b: F.least(a, b)))
        .withColumn(four, F.zip_with(F.col(two), following(two, 2), lambda a, b: F.least(a, b)))
        .withColumn(run, F.arrays_zip(
            F.sequence(F.lit(0), F.size(pair) - 1).alias("at"), F.col(pair).alias("first"), following(pair, 2).alias("middle"),
            following(pair, 4).alias("last"), F.col(four).alias("least")))
    )
    closed = F.filter(F.col(run), lambda r: r["last"].isNotNull() & ((r["last"] <= r["least"]) | (r["first"] == F.least(r["least"], r["last"]))))
    hashed = F.transform(closed, lambda r: F.struct(
        r["at"].alias("position"),
        F.shiftrightunsigned(F.xxhash64(r["first"], r["middle"], r["last"]), 64 - HASH_BITS).alias("hash")))
    return zipped.withColumn(into, hashed).drop(word, pair, two, four, run)


def sketch(anchors: Column) -> Column:
    """The smallest distinct hashes of all anchors, ascending."""
    return F.slice(F.array_sort(F.array_distinct(anchors["hash"])), 1, SKETCH)


def fingerprint(hashes: Column) -> Column:
    """The sketch as text; equal texts have equal fingerprints, a text without words has the empty one."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), HASH_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among the smallest of the union, 0 to 1; two empty sketches are alike."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, 1.0).otherwise(common / F.size(union))


def in_ranges(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, WindowSpec]:
    """Deal the rows into ranges of descending keys so that the next row of each is in its range; after the last row
    comes the first one. Returns the rows with place and copy, and the window to look ahead in.

    A null key comes last, rows of one key are ordered by text. Keys are dealt into ranges at their quantiles; besides
    its own rows a range gets a copy of the row that begins the next one, so no order over all rows is ever needed
    in one place. Only the bounds and first keys of the ranges, as many as shuffle partitions, pass the driver."""
    spark = docs.sparkSession
    n = partitions(spark)
    ids = docs.select(F.col(key).alias("k"))
    fractions = [i / n for i in range(1, n)] or [0.5]
    bounds = sorted(set(ids.agg(F.percentile_approx("k", fractions, 10_000)).first()[0] or []))
    # Two short steps instead of one over all bounds: first among every g-th bound, then among the g after it.
    g = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[g - 1 :: g]]).cast("array<bigint>")
    fine = F.array(*[F.lit(b).cast("long") for b in bounds]).cast("array<bigint>")

    def place(k: Column) -> Column:
        # Ranges count downwards, as the order does: 0 holds the largest keys, the last one the nulls as well.
        at = F.size(F.filter(coarse, lambda b: b < k)) * g
        below = at + F.size(F.filter(F.slice(fine, at + 1, g), lambda b: b < k))
        return F.when(k.isNull(), len(bounds)).otherwise(F.lit(len(bounds)) - below).cast("int")

    firsts = ids.groupBy(place(F.col("k")).alias("place")).agg(F.max("k").alias("k")).orderBy("place").collect()
    # The first key of a range goes, besides, to the range before it; that of the first range to the last one.
    keys = F.array(*[F.lit(r["k"]).cast("long") for r in firsts]).cast("array<bigint>")
    before = F.array(*[F.lit(r["place"]) for r in [*firsts[-1:], *firsts[:-1]]]).cast("array<int>")
    at = F.array_position(keys, F.col(key))
    if any(r["k"] is None for r in firsts):
        at = F.when(F.col(key).isNull(), len(firsts)).otherwise(at)
    copy = F.when(at > 0, F.struct(F.get(before, at.cast("int") - 1).alias("place"), F.lit(True).alias("copy")))
    own = F.struct(place(F.col(key)).alias("place"), F.lit(False).alias("copy"))
    dealt = docs.withColumn("_to", F.explode(F.array_compact(F.array(own, copy)))).select("*", "_to.place", "_to.copy").drop("_to")
    order = Window.partitionBy("place").orderBy("copy", F.col(key).desc_nulls_last(), F.col(text))
    return dealt, order


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, whose last third gives way to the beginning of the next text.

    Returns (key, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, anchors), one row per row.
    Null texts count as empty; repeated rows follow each other; a single row follows itself; an empty table gives an
    empty result. Other columns are not read."""
    given = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    dealt, order = in_ranges(given, key, "_text")
    dealt = with_anchors(dealt.repartition("place"), "_text", "_anchors").withColumn("_hashes", sketch(F.col("_anchors")))
    n = F.length("_text")
    tail = F.floor(n / 3).cast("int")
    following = dealt.select(
        key, "copy", "_text", "_anchors", "_hashes", F.lead("_hashes").over(order).alias("_next_hashes"),
        F.lead("_text").over(order).alias("_next"))
    edited = following.filter(~F.col("copy")).withColumn("edited", F.concat(F.substring("_text", F.lit(1), n - tail), F.substring("_next", F.lit(1), tail)))
    edited = with_anchors(edited, "edited", "_edited_anchors").withColumn("_edited_hashes", sketch(F.col("_edited_anchors")))
    return edited.select(
        key, n.cast("long").alias("n_chars"), "edited",
        fingerprint(F.col("_hashes")).alias("fingerprint"), fingerprint(F.col("_edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("_hashes"), F.col("_edited_hashes")).alias("near_edited"),
        likeness(F.col("_hashes"), F.col("_next_hashes")).alias("near_next"), F.col("_anchors").alias("anchors"))
