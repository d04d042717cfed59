"""Fixity audit of WARC replicas by Merkle trees.

A replica is a set of files of records, each at an offset. The leaves of a tree are the digests of the records; a node
covers a range of offsets of one file and hashes its children in order; ranges grow by ``FAN`` per level up to the file,
and one root covers all files. Two replicas are compared from the root down: a level is joined only below nodes that
differ, so an intact replica costs one comparison and a damaged record the path to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanbook.llm.common import staged

RANGE = 1 << 16  # bytes that a node above the leaves covers
FAN = 16
LEVELS = 4  # up to 256 MB; above them lies the file
FILE_KEYS = 1000  # consecutive keys whose records share a file


def record_text(key: Column, url: Column, payload: Column) -> Column:
    """A WARC response record: header, blank line, payload, two line ends."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def catalogue(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", held=None) -> DataFrame:
    """Records in files: (file, offset, length, key, digest).

    Files hold ``FILE_KEYS`` consecutive keys in order, records of one key by digest; offsets are running sums in a
    file. A null key goes into a file of its own, null urls and payloads count as empty. ``held`` gives what a replica
    has in a record's place, from (key, record); null is nothing, and such places are left out."""
    record = record_text(F.col(key), F.col(url), F.col(payload))
    made = pages.select(F.col(key).alias("key"), record.alias("record")).select(
        F.floor(F.col("key") / FILE_KEYS).cast("long").alias("file"), "key", F.octet_length("record").cast("long").alias("length"),
        F.sha2("record", 256).alias("_own"), F.sha2(held(F.col("key"), F.col("record")) if held else F.col("record"), 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("key", "_own").rowsBetween(Window.unboundedPreceding, -1)
    placed = made.select("file", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"), "length", "key", "digest")
    return placed.filter("digest IS NOT NULL")


def write_files(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write the records as WARC files, one for each ``FILE_KEYS`` consecutive keys, in the order of the catalogue."""
    record = record_text(F.col(key), F.col(url), F.col(payload))
    rows = pages.select(F.floor(F.col(key) / FILE_KEYS).cast("long").alias("file"), F.col(key).alias("key"), record.alias("record"))
    ordered = rows.withColumn("_own", F.sha2("record", 256)).repartition("file").sortWithinPartitions("file", "key", "_own")
    # The writer ends every row with a line feed, which is the last character of a record.
    ordered.select("file", F.substring("record", F.lit(1), F.length("record") - 1).alias("value")).write.partitionBy("file").text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue of WARC files as they are: (file, offset, length, key, digest), from each record's own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, at = [], 0
                while at < len(content):
                    body = content.index(b"\r\n\r\n", at) + 4
                    head = content[at:body]
                    end = body + int(re.search(rb"Content-Length: (\d+)", head)[1]) + 4
                    named = re.search(rb"<urn:page:(-?\d*)>", head)[1]
                    rows.append((file, at, end - at, int(named) if named else None, hashlib.sha256(content[at:end]).hexdigest()))
                    at = end
                columns = list(zip(*rows, strict=True)) or [[] for _ in range(5)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["file", "offset", "length", "key", "digest"]
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select(F.col("file").cast("long").alias("file"), "content")
    return whole.mapInArrow(run, "file long, offset long, length long, key long, digest string")


def level(children: DataFrame, width: int) -> DataFrame:
    """(file, node, digest) of nodes that cover ``width`` bytes, or width children; ``children`` has (file, at, digest)."""
    return children.groupBy("file", F.floor(F.col("at") / width).cast("long").alias("node")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda c: F.concat_ws(":", c["at"], c["digest"])), ","), 256).alias("digest"))


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels of the tree over (file, offset, digest), leaves first; the last two are the files and the root.

    A node gathers what starts in its range: at most ``RANGE`` bytes of records, then ``FAN`` nodes, then the ranges of a
    file, then the files of a block of 1,000."""
    levels = [records.select("file", F.col("offset").alias("at"), "digest")]
    for n in range(LEVELS):
        nodes = staged(level(levels[-1], RANGE if n == 0 else FAN), "merkle")
        levels.append(nodes.withColumnRenamed("node", "at"))
    files = level(levels[-1], 1 << 62).select(F.lit(0).cast("long").alias("file"), F.coalesce(F.col("file"), F.lit(-1)).alias("at"), "digest")
    return [*levels, staged(files, "merkle")]


def root(levels: list[DataFrame]) -> str:
    """The root digest: files in blocks, then the blocks."""
    blocks = level(levels[-1], 1_000).withColumnRenamed("node", "at")
    return level(blocks, 1 << 62).first()["digest"] if not levels[-1].isEmpty() else ""


def differing(a: DataFrame, b: DataFrame, below: DataFrame | None, width: int) -> DataFrame:
    """(file, at, digest_a, digest_b) of the nodes that differ, null where one side has none; only below ``below``."""
    def inside(side: DataFrame, name: str) -> DataFrame:
        side = side.select("file", "at", F.col("digest").alias(name))
        if below is None:
            return side
        parents = below.select(F.col("file").alias("_file"), F.col("at").alias("_at"))
        return side.join(parents, F.col("file").eqNullSafe(F.col("_file")) & (F.floor(F.col("at") / width) == F.col("_at")), "left_semi")

    theirs = inside(b, "digest_b").select(F.col("file").alias("_f"), F.col("at").alias("_a"), "digest_b")
    met = inside(a, "digest_a").join(theirs, F.col("file").eqNullSafe(F.col("_f")) & (F.col("at") == F.col("_a")), "full")
    found = met.filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    return found.select(F.coalesce("file", "_f").alias("file"), F.coalesce("at", "_a").alias("at"), "digest_a", "digest_b")


def audit(good: DataFrame, copy: DataFrame) -> DataFrame:
    """Records of two replicas that differ: (file, offset, fault, digest, copy_digest).

    Both have (file, offset, digest) with one record per place. fault is ``altered``, ``missing`` in the copy, or
    ``extra`` in it. Equal replicas, empty ones among them, give no rows after one comparison of the roots."""
    mine, theirs = tree(good), tree(copy)
    schema = "file long, offset long, fault string, digest string, copy_digest string"
    if root(mine) == root(theirs):
        return good.sparkSession.createDataFrame([], schema)
    files = differing(mine[-1], theirs[-1], None, 0)
    # A file is the node 0 of the widest range of itself.
    below = files.select(F.when(F.col("at") >= 0, F.col("at")).alias("file"), F.lit(0).cast("long").alias("at"))
    for n in range(LEVELS, -1, -1):
        below = staged(differing(mine[n], theirs[n], below, 1 << 62 if n == LEVELS else FAN if n else RANGE), "merkle-differing")
    fault = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("altered")
    return below.select("file", F.col("at").alias("offset"), fault.alias("fault"), F.col("digest_a").alias("digest"), F.col("digest_b").alias("copy_digest"))
