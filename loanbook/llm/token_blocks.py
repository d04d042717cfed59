"""Token ids in patched frame-of-reference files, as a Spark data source.

A file holds the ids of its documents one after the other, cut into blocks of ``BLOCK`` ids. A block stores its smallest
id, and the distance of every id from it in as many bits as the ``WIDTH_SHARE`` part of the block needs. The few ids
that need more are exceptions: their low bits stay in place, their positions and high bits follow the packed part.
An index at the end of the file gives the start of every block and the length of every document, so that any stretch of
ids is read from its blocks alone.

Writing commits as Spark tasks do: each attempt writes a file of its own name, and only the files of successful
attempts are entered in the list that readers go by. A lost executor costs its unfinished files.

Layout, all numbers little-endian::

    file   = "PFR1", blocks, index, index start (uint64), "PFR1"
    block  = smallest id (uint32), bits (uint8), exceptions (uint8), packed distances, positions (uint8 each),
             high bits (uint32 each)
    index  = blocks, documents, ids (uint64 each), block starts (uint64 each), documents: null mark (uint8 each),
             key (int64 each), number of ids (uint64 each)
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from loanbook.llm.bpe import PLAIN_LIMIT, byte_symbols, plain_pattern

BLOCK = 256
WIDTH_SHARE = 0.96  # of a block's ids that fit its width without an exception
MARK = b"PFR1"
HEAD = np.dtype([("low", "<u4"), ("bits", "u1"), ("exceptions", "u1")])
LISTING = "_files.json"
AT_ONCE = 2048  # blocks packed or unpacked together
REMEMBERED = 400_000  # words with their ids, for each Python worker
REMEMBERED_LENGTH = 40


# -- blocks -----------------------------------------------------------------------------------------------------------


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each number below 2^32; doubles hold them exactly."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def packed(ids: np.ndarray) -> list[bytes]:
    """The blocks of the ids; a last short one is filled up with its own smallest id."""
    if not len(ids):
        return []
    whole = -(-len(ids) // BLOCK) * BLOCK
    ids = ids.astype(np.uint32)
    rest = len(ids) % BLOCK
    if rest:
        ids = np.concatenate([ids, np.full(whole - len(ids), ids[-rest:].min(), np.uint32)])
    blocks = ids.reshape(-1, BLOCK)
    low = blocks.min(1)
    distance = blocks - low[:, None]
    length = bit_lengths(distance)
    width = np.sort(length, 1)[:, int(np.ceil(WIDTH_SHARE * BLOCK)) - 1]
    beyond = length > width[:, None]
    # Exceptions of all blocks, one after the other.
    block, at = np.nonzero(beyond)
    ends = np.cumsum(beyond.sum(1))
    begins = ends - beyond.sum(1)
    high = (distance[block, at].astype(np.uint64) >> width[block].astype(np.uint64)).astype("<u4").tobytes()
    places = at.astype(np.uint8).tobytes()
    heads = np.empty(len(blocks), HEAD)
    heads["low"], heads["bits"], heads["exceptions"] = low, width, ends - begins
    front = heads.tobytes()
    bodies: list[bytes] = [b""] * len(blocks)
    for bits in map(int, np.unique(width)):
        of = np.flatnonzero(width == bits)
        held = 16 if bits <= 16 else 32
        low_bits = distance[of].astype(f">u{held // 8}")  # takes the lowest bits
        flags = np.unpackbits(low_bits.view(np.uint8), axis=1).reshape(-1, BLOCK, held)[:, :, held - bits:]
        body, size = np.packbits(flags.reshape(len(of), -1), axis=1).tobytes(), BLOCK * bits // 8
        for row, n in enumerate(of.tolist()):
            bodies[n] = body[row * size:(row + 1) * size]
    size = HEAD.itemsize
    return [
        front[n * size:(n + 1) * size] + body + places[a:b] + high[4 * a:4 * b]
        for n, (body, a, b) in enumerate(zip(bodies, begins.tolist(), ends.tolist(), strict=True))]


def unpacked(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at these places of ``raw``, fillings included."""
    data = np.frombuffer(raw, np.uint8)
    heads = data[starts[:, None] + np.arange(HEAD.itemsize)].copy().view(HEAD)[:, 0]
    out = np.empty((len(starts), BLOCK), np.uint32)
    for bits in map(int, np.unique(heads["bits"])):
        of = np.flatnonzero(heads["bits"] == bits)
        body = data[(starts[of] + HEAD.itemsize)[:, None] + np.arange(BLOCK * bits // 8)]
        held = 16 if bits <= 16 else 32
        flags = np.zeros((len(of), BLOCK, held), np.uint8)
        flags[:, :, held - bits:] = np.unpackbits(body, axis=1).reshape(len(of), BLOCK, bits)
        out[of] = np.packbits(flags.reshape(len(of), -1), axis=1).view(f">u{held // 8}")
    count = heads["exceptions"].astype(np.int64)
    block = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    begin = (starts + HEAD.itemsize + BLOCK // 8 * heads["bits"].astype(np.int64))[block]
    places = data[begin + nth]
    high = data[(begin + count[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    out[block, places] |= high << heads["bits"][block].astype(np.uint32)
    return (out + heads["low"][:, None]).ravel()


# -- files ------------------------------------------------------------------------------------------------------------


def file_system(path: str):
    """The file system of a path or URI, and the path inside it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:"):])
    return fs.LocalFileSystem(), path


class FileWriter:
    """Writes one file; holds a few blocks of ids and eight to seventeen bytes for each block and document."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.starts: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.put(MARK)

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, keys: pa.Array, ids: pa.Array) -> None:
        """Documents of one batch; a document without ids counts as one of length zero."""
        self.nulls.append(keys.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        self.keys.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.lengths.append(np.nan_to_num(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False)).astype("<u8"))
        values = ids.flatten().to_numpy(zero_copy_only=False)
        self.waiting.append(values)
        self.n_waiting += len(values)
        self.n_ids += len(values)
        if self.n_waiting >= AT_ONCE * BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate([np.empty(0, np.uint32), *self.waiting]).astype(np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for begin in range(0, whole, AT_ONCE * BLOCK):
            blocks = packed(ids[begin:min(begin + AT_ONCE * BLOCK, whole)])
            sizes = np.array([len(b) for b in blocks], np.uint64)
            self.starts.append(self.at + np.cumsum(sizes) - sizes)
            self.put(b"".join(blocks))
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[int, int]:
        """Documents and ids of the file."""
        self.flush(True)
        starts, keys, nulls, lengths = (
            np.concatenate([np.empty(0, kind), *parts]).astype(kind)
            for kind, parts in (("<u8", self.starts), ("<i8", self.keys), ("u1", self.nulls), ("<u8", self.lengths)))
        begin = self.at
        self.put(struct.pack("<QQQ", len(starts), len(keys), self.n_ids))
        for part in (starts, nulls, keys, lengths):
            self.put(part.tobytes())
        self.put(struct.pack("<Q", begin) + MARK)
        return len(keys), self.n_ids


class FileReader:
    """Reads one file by its index."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(stream.size() - 8 - len(MARK))
        tail = stream.read(8 + len(MARK))
        if tail[8:] != MARK:
            raise ValueError("not a file of token blocks, or a truncated one")
        begin = struct.unpack("<Q", tail[:8])[0]
        stream.seek(begin)
        raw = stream.read(stream.size() - 8 - len(MARK) - begin)
        n_blocks, n_docs, self.n_ids = struct.unpack_from("<QQQ", raw)
        starts = np.frombuffer(raw, "<u8", n_blocks, 24)
        self.bounds = np.concatenate([starts, [begin]]).astype(np.int64)
        at = 24 + 8 * n_blocks
        self.nulls = np.frombuffer(raw, "u1", n_docs, at).astype(bool)
        self.keys = np.frombuffer(raw, "<i8", n_docs, at + n_docs)
        self.ends = np.cumsum(np.frombuffer(raw, "<u8", n_docs, at + 9 * n_docs).astype(np.int64))

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids from ``first`` up to ``end``, from their blocks alone."""
        end = min(end, self.n_ids)
        if first >= end:
            return np.empty(0, np.uint32)
        a, b = first // BLOCK, -(-end // BLOCK)
        self.stream.seek(int(self.bounds[a]))
        raw = self.stream.read(int(self.bounds[b] - self.bounds[a]))
        parts = [unpacked(raw, self.bounds[n:min(n + AT_ONCE, b)] - self.bounds[a]) for n in range(a, b, AT_ONCE)]
        return np.concatenate(parts)[first - a * BLOCK:end - a * BLOCK]


# -- data source ------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    place: int
    name: str
    documents: int
    ids: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        name = f"part-{place:06d}-{uuid.uuid4().hex}.pfr"
        with system.open_output_stream(f"{folder}/{name}") as stream:
            file = FileWriter(stream)
            for batch in iterator:
                file.add(batch.column(0), batch.column(1))
            documents, ids = file.close()
        return Written(place, name, documents, ids)

    def commit(self, messages: list[Written | None]) -> None:
        """Enter the files, in the order of the partitions; a folder that was written before is only replaced on demand."""
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        known = listing(self.path)
        if known and not self.overwrite:
            first = known[-1]["place"] + 1
        else:
            known, first = [], 0
        done = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        known += [{"place": first + m.place, "name": m.name, "documents": m.documents, "ids": m.ids} for m in done]
        with system.open_output_stream(f"{folder}/{LISTING}") as stream:
            stream.write(json.dumps(known).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Unlisted files are never read."""


@dataclass
class Part(InputPartition):
    """Documents of a file, as their range in its index, and the ids of all files before it."""

    name: str
    before: int


def listing(path: str) -> list[dict]:
    system, folder = file_system(path)
    from pyarrow import fs

    if system.get_file_info(f"{folder}/{LISTING}").type != fs.FileType.File:
        return []
    with system.open_input_stream(f"{folder}/{LISTING}") as stream:
        return json.loads(stream.read())


class Reader(DataSourceReader):
    def __init__(self, path: str, schema, first: int, end: int | None):
        self.path, self.first, self.end = path, first, end
        self.as_bytes = schema["ids"].dataType.typeName() == "binary"

    def partitions(self) -> list[Part]:
        """One for each file that holds something of the wanted stretch."""
        parts, before = [], 0
        for file in listing(self.path):
            after = before + file["ids"]
            whole = self.end is None and self.first == 0
            if whole or (after > self.first and (self.end is None or before < self.end)):
                parts.append(Part(file["name"], before))
            before = after
        return parts or [Part("", 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, folder = file_system(self.path)
        with system.open_input_file(f"{folder}/{partition.name}") as stream:
            file = FileReader(stream)
            starts = np.concatenate([[0], file.ends[:-1]]).astype(np.int64) if len(file.ends) else np.empty(0, np.int64)
            low = max(0, self.first - partition.before)
            high = file.n_ids if self.end is None else min(file.n_ids, self.end - partition.before)
            if self.first == 0 and self.end is None:
                of = np.arange(len(starts))
            else:  # documents with an id in the stretch, cut to it
                of = np.flatnonzero((file.ends > low) & (starts < high) & (file.ends > starts))
            begins, ends = np.maximum(starts[of], low), np.minimum(file.ends[of], high)
            # As many documents at a time as hold about the ids of the blocks unpacked together.
            cuts = np.flatnonzero(np.diff(begins // (AT_ONCE * BLOCK), prepend=-1, append=-1)) if len(of) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield self.batch(file, partition, of[a:b], begins[a:b], ends[a:b])

    def batch(self, file: FileReader, partition: Part, of: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        ids = file.ids(int(begins[0]), int(ends[-1]))
        offsets = np.append(begins, ends[-1]) - begins[0]
        keys = pa.array(file.keys[of], pa.int64(), mask=file.nulls[of])
        if self.as_bytes:
            raw = ids.astype("<u4").tobytes()
            column = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer((offsets * 4).astype(np.int32).tobytes()), pa.py_buffer(raw)])
        else:
            column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([keys, pa.array(partition.before + begins), column], ["doc_id", "start", "ids"])


class TokenBlocks(DataSource):
    """``format("token_blocks")``: read with the options ``first`` and ``end``, positions over all files in order."""

    @classmethod
    def name(cls) -> str:
        return "token_blocks"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, ids array<int>"

    def reader(self, schema) -> Reader:
        end = self.options.get("end")
        return Reader(self.options["path"], schema, int(self.options.get("first", 0)), None if end is None else int(end))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


# -- operators --------------------------------------------------------------------------------------------------------


class LibraryWords(dict):
    """The tokenizers library with a bounded memory of words; one for each Python worker.

    Texts in the plain code points are cut by the tokenizer's own pattern and a word that is not remembered goes to the
    library's model. Other texts, and ones that may hold special tokens, go to the library whole."""

    loaded: dict[str, LibraryWords] = {}

    @classmethod
    def load(cls, path: str) -> LibraryWords:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        # What the plain path reproduces: lower case, then words by a pattern that drops the rest, then bytes.
        self.plain = (
            [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"])
        if self.plain:
            self.find = re.compile(plain_pattern(steps[0]["pattern"]["Regex"])).findall
        self.beyond = re.compile(f"[^\\0-{chr(ord(PLAIN_LIMIT) - 1)}]").search
        self.bytes = dict(enumerate(byte_symbols()))

    def __missing__(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
        ids = array("i", [t.id for t in self.tokenize(shown)]).tobytes()
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, as the bytes of 32-bit numbers."""
        if not self.plain or "<|" in text or self.beyond(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.find(text.lower())))


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of the whole text and the end id. A null or empty text has the end id alone."""
    last = np.array([end_id], np.int32).tobytes()
    schema = docs.select(F.col(key).cast("long").alias("doc_id"), F.array().cast("array<int>").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LibraryWords.load(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                piece = batch.slice(at, 250)
                found = [model.ids(v or "") + last for v in piece.column(1).to_pylist()]
                offsets = np.cumsum([0, *[len(f) // 4 for f in found]]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([piece.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def write_documents(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the ids to files in ascending order of the key, nulls first.

    The rows of one key, or of none, are ordered by a hash of their text and then by the text, so that they spread over
    files and repeated runs agree; repeated rows are all kept. Other columns are not read, whatever their names. There
    are as many files as the input has splits, so they follow its volume, and an empty table gives empty files."""
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = plain.repartitionByRange(max(1, plain.rdd.getNumPartitions()), *order).sortWithinPartitions(*order, "text")
    docs.sparkSession.dataSource.register(TokenBlocks)
    encoded(ranged, tokenizer_path, end_id).write.format(TokenBlocks.name()).mode("overwrite").save(path)


def read_documents(spark: SparkSession, path: str, first: int = 0, end: int | None = None, as_bytes: bool = False) -> DataFrame:
    """(doc_id, start, ids) of the files, in any order; ``start`` counts the ids of all documents before.

    With ``first`` or ``end`` only the ids at these positions, cut from their documents; then documents without any id
    in the stretch are left out. ``as_bytes`` gives ids as little-endian unsigned 32-bit numbers."""
    spark.dataSource.register(TokenBlocks)
    reader = spark.read.format(TokenBlocks.name()).option("first", first)
    if end is not None:
        reader = reader.option("end", end)
    if as_bytes:
        reader = reader.schema("doc_id bigint, start bigint, ids binary")
    return reader.load(path)
