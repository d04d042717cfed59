"""Mixing sources to target weights from blocks of words.

The words of a source are packed into blocks of fixed length, document after document. Output shards draw how many
of their slots each source fills from a multinomial over the targets; afterwards the sums over all shards are settled
so that each source gets the slots of its target. The slots of a source run through its blocks in the order of a
pseudorandom permutation of the block indices, round after round, so a block is used floor or ceil of slots over
blocks times, at most ``max_repeats``. Slots and blocks meet in a join on (source, index): no source is gathered in
one place, and the blocks of a source with a third of all rows spread like any others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanbook.llm.common import WORD, partitions, staged, words


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[int, ...] = (5, 2, 1)  # by the rank of the source, repeating
    share: float = 1.5  # of all words
    max_repeats: int = 2
    block: int = 32  # words
    shard_slots: int = 65_536
    pack_rows: int = 100_000  # documents that one running sum covers, on average
    seed: int = 11


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def by_name() -> Window:
    """Sources by code point, null last. Windows over it see one row per source."""
    return Window.orderBy(F.col("source").isNull(), F.col("source"))


def targets(sizes: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """Target words of each source; ``sizes`` has (source, source_size), one row per source.

    Shares go by weight, stop at ``max_repeats`` times the source and the excess is shared again among the rest. In
    the order of how much a unit of weight could take, the capped sources come first; the level that the others share
    is the largest one reached on the way."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in settings.weights]), (F.row_number().over(by_name()) - 1) % len(settings.weights) + 1)
    ranked = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * float(settings.max_repeats))
    everything = Window.partitionBy()
    tightest = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").isNull(), F.col("source"))
    before = tightest.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * settings.share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_weight = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    levelled = ranked.withColumn("_level", left / open_weight)
    target = F.least(F.col("_cap"), F.max("_level").over(everything) * F.col("_weight"))
    return levelled.select("source", "source_size", target.alias("target"))


def draw_slots(sources: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """Slots of each source in each output shard: (shard, source_no, first_slot, slots), the sums settled.

    ``sources`` has (source_no, slots_due), one row per source; its numbers are sent to every shard, since a shard draws
    over all sources. Shards draw on their own from a generator seeded with their number, so reruns agree. What a source
    drew beyond its due is taken from its last shards; what is missing goes into one more shard."""
    due = sources.select("source_no", "slots_due").filter("slots_due > 0").orderBy("source_no").toPandas()
    numbers, wanted = due["source_no"].to_numpy(), due["slots_due"].to_numpy().astype(np.int64)
    total, size, seed = int(wanted.sum()), settings.shard_slots, settings.seed
    shards = -(-total // size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                drawn = np.random.default_rng([seed, int(shard)]).multinomial(min(size, total - int(shard) * size), wanted / total)
                some = drawn > 0
                yield pd.DataFrame({"shard": shard, "source_no": numbers[some], "slots": drawn[some].astype(np.int64)})

    drawn = sources.sparkSession.range(shards).mapInPandas(run, "shard long, source_no long, slots long")
    drawn = drawn.join(sources.select("source_no", "slots_due"), "source_no")
    first = F.sum("slots").over(Window.partitionBy("source_no").orderBy("shard")) - F.col("slots")
    settled = drawn.withColumn("first_slot", first).select(
        "shard", "source_no", "first_slot", F.least(F.col("slots"), F.col("slots_due") - F.col("first_slot")).alias("slots"))
    drew = drawn.groupBy("source_no").agg(F.sum("slots").alias("drew"))
    drew = sources.select("source_no", "slots_due").filter("slots_due > 0").join(drew, "source_no", "left").withColumn("first_slot", F.coalesce("drew", F.lit(0)))
    missing = drew.select(F.lit(shards).cast("long").alias("shard"), "source_no", "first_slot", (F.col("slots_due") - F.col("first_slot")).alias("slots"))
    return settled.unionByName(missing).filter("slots > 0")


def permute(index: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of 0..count-1: a balanced network over the next even number of bits, walked until the value
    lies inside. It needs no table, so no source's indices are held together."""
    count, value = count.astype(np.uint64), index.astype(np.uint64).copy()
    bits = np.ceil(np.log2(np.maximum(count, 2).astype(np.float64) + 0.5)).astype(np.uint64)
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key, todo = key.astype(np.int64).view(np.uint64), np.arange(len(value))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = value[todo] >> h, value[todo] & m
            for turn in range(4):
                mixed = (right + np.uint64(0x9E3779B97F4A7C15) * np.uint64(turn + 1)) ^ k
                mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(31))) & m)
            value[todo] = (left << h) | right
            todo = todo[value[todo] >= count[todo]]
    return value.astype(np.int64)


def permuted(index: Column, count: Column, key: Column) -> Column:
    def run(index: pd.Series, count: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), count.to_numpy(), key.to_numpy()))

    return F.pandas_udf(run, "long")(index, count, key)


def pack(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """Place every row in its source: adds first_word, the position of its first word.

    ``docs`` has source, doc_id, size and tie, which orders rows that agree in id and size. The order within a source
    is (bucket of the hashed id, id, size, tie), summed inside the buckets, whose number follows the rows, and over the
    buckets' totals."""
    buckets = max(docs.count() // settings.pack_rows, partitions(docs.sparkSession))
    placed = docs.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", F.lit(settings.seed)), F.lit(buckets)).cast("int"))
    totals = placed.groupBy("source", "_bucket").agg(F.sum("size").alias("_total"))
    earlier = Window.unboundedPreceding, -1
    start = F.coalesce(F.sum("_total").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(*earlier)), F.lit(0))
    starts = totals.select(F.col("source").alias("_source"), F.col("_bucket").alias("_in"), start.alias("_start"))
    inside = F.sum("size").over(Window.partitionBy("source", "_bucket").orderBy("doc_id", "size", "tie").rowsBetween(*earlier))
    return (
        placed.withColumn("_inside", F.coalesce(inside, F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_in")))
        .withColumn("first_word", F.col("_start") + F.col("_inside"))
        .drop("_source", "_in", "_start", "_inside", "_bucket")
    )


def fill(rows: DataFrame, settings: MixSettings = MixSettings()) -> tuple[DataFrame, DataFrame]:
    """Fill the slots of a mix.

    ``rows`` is a stored frame with (row, doc_id, source, size, tie). Returns the sources (source, source_size, target)
    and the filled slots, one row per piece of a document in a slot: (shard, slot, source_no, index, round, row,
    word_from, word_to), word_to exclusive."""
    block = settings.block
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = (
        targets(sizes, settings)
        .withColumn("source_no", F.row_number().over(by_name()).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("slots_due", F.least(F.round(F.col("target") / block).cast("long"), F.col("blocks") * settings.max_repeats))
    )
    sources = staged(sources, "mix-sources")
    counts = sources.select("source_no", "blocks").filter("blocks > 0")

    drawn = draw_slots(sources, settings).join(counts, "source_no")
    # By number, so that the few draws are not put together in one task before their many slots are unfolded.
    drawn = drawn.repartition(partitions(rows.sparkSession), "shard", "source_no")
    number = drawn.select("shard", "source_no", "blocks", F.explode(F.sequence("first_slot", F.col("first_slot") + F.col("slots") - 1)).alias("slot"))
    number = number.withColumn("round", F.floor(F.col("slot") / F.col("blocks")).cast("long"))
    key = F.xxhash64("source_no", "round", F.lit(settings.seed))
    slots = number.select("shard", "slot", "source_no", "round", permuted(F.pmod("slot", "blocks"), F.col("blocks"), key).alias("index"))

    names = sources.select(F.col("source").alias("_source"), "source_no")
    placed = pack(rows.filter("size > 0"), settings).join(names, F.col("source").eqNullSafe(F.col("_source")))
    first, size = F.col("first_word"), F.col("size")
    touched = placed.select("row", "source_no", "first_word", "size", F.explode(F.sequence(F.floor(first / block), F.floor((first + size - 1) / block))).alias("index"))
    blocks = touched.select(
        "row", "source_no", "index",
        F.greatest(F.lit(0).cast("long"), F.col("index") * block - first).alias("word_from"),
        F.least(size, (F.col("index") + 1) * block - first).alias("word_to"))
    # Unfolded slots are far more than the few draws that the planner judges their size by: never broadcast them.
    return sources.select("source", "source_size", "target"), slots.hint("merge").join(blocks, ["source_no", "index"])


def mix(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """Words the mix takes from each document: (doc_id, source, size, source_size, target, taken), one row per row.

    A null source is a source of its own and comes last; a null or empty text has size 0 and nothing is taken from it;
    repeated rows are packed one after the other; an empty table gives an empty result. Only doc_id, source and text
    are read, so other columns cannot clash."""
    rows = _numbered(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
    sources, filled = fill(rows, settings)
    taken = filled.groupBy("row").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    return _with_sources(rows.join(taken, "row", "left"), sources).select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """The mixed text itself, in the columns of ``docs``: one row per document and round in which blocks of it are used.

    The text is whole where all blocks of the document are used in that round; else the used words, in order and with
    single spaces between them, and n_chars, if there is such a column, is counted anew."""
    names = docs.columns
    size = word_count(F.col("text"))
    rows = _numbered(docs.withColumns({"_size": size, "_tie": F.xxhash64("text")}))
    _, filled = fill(rows.select("row", "doc_id", "source", F.col("_size").alias("size"), F.col("_tie").alias("tie")), settings)
    used = filled.groupBy("row", "round").agg(
        F.sum(F.col("word_to") - F.col("word_from")).alias("_used"),
        F.array_sort(F.collect_list(F.struct("word_from", "word_to"))).alias("_pieces"))
    part = F.flatten(F.transform("_pieces", lambda p: F.slice(F.col("_words"), p["word_from"].cast("int") + 1, (p["word_to"] - p["word_from"]).cast("int"))))
    joined = rows.join(used, "row").withColumn("_words", F.when(F.col("_used") < F.col("_size"), words(F.col("text"))))
    text = F.when(F.col("_used") == F.col("_size"), F.col("text")).otherwise(F.array_join(part, " "))
    result = joined.withColumn("text", text)
    if "n_chars" in names:
        result = result.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return result.select(names)


def _numbered(rows: DataFrame) -> DataFrame:
    """Store the rows with a number each; the stored numbers stay whatever happens to the tasks that gave them."""
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    theirs = sources.withColumnRenamed("source", "_source")
    return rows.join(theirs, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
