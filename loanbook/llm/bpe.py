"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

The last token of the encoding of every prefix is unique. For each end position an automaton over the vocabulary
lists all tokens that are a suffix of the prefix; the one that can follow the last token of the remaining shorter
prefix is stored, and the stored tokens are followed back from the end. Two tokens can follow each other when
undoing their merges, the later one first, never shows a merge across their border that would have come earlier.
The time is linear in the word, however long it is; words that were met before come from a bounded memory.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED_WORDS = 600_000
REMEMBERED_PAIRS = 1_000_000
REMEMBERED_LENGTH = 40
# A text below this code point is in normal form, keeps below it (or leaves the letters) when lowered, and is split by a
# pattern with written-out classes as by the tokenizer (checked in the tests). Other texts go through the tokenizer's
# own normalizer and splitter.
PLAIN_LIMIT = "\u0180"
# Code points that a final symbol is shifted by: "x" at the end of a word is another symbol than "x" inside it.
FINAL = 0x10000


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the
    others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {b: chr(b) for b in own}
    for b in range(256):
        symbols.setdefault(b, chr(256 + len(symbols) - len(own)))
    return [symbols[b] for b in range(256)]


def plain_pattern(pattern: str) -> str:
    """The pattern with its letter and number properties written out for the code points below the limit."""
    below = [chr(c) for c in range(ord(PLAIN_LIMIT))]
    letters, numbers = ("".join(c for c in below if unicodedata.category(c)[0] == kind) for kind in "LN")
    blank = "".join(c for c in below if c.isspace() and c not in "\x1c\x1d\x1e\x1f")
    pattern = pattern.replace(r"\s", blank)
    return pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]").replace(r"\p{L}", letters).replace(r"\p{N}", numbers)


class WordBpe:
    """A word-end BPE tokenizer read from a tokenizers file; one for each Python worker."""

    loaded: dict[str, WordBpe] = {}

    @classmethod
    def load(cls, path: str) -> WordBpe:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.end = spec["model"]["end_of_word_suffix"]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = re.compile(plain_pattern(pattern)).findall
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.content = {i: t for t, i in (vocab | self.special).items()}
        self.symbols = byte_symbols()

        # Symbols come first in the order of making, then the merged tokens in the order of their merges.
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        merged = {a + b for a, b in merges}
        base = [t for t in vocab if t not in merged]
        self.id = [vocab[t] for t in base] + [vocab[a + b] for a, b in merges]
        order = {t: n for n, t in enumerate(base + [a + b for a, b in merges])}
        self.parts = [None] * len(base) + [(order[a], order[b]) for a, b in merges]
        self.merge = {pair: n + len(base) for n, pair in enumerate(self.parts[len(base):])}
        self.shown = [self.closed(t) for t in order]
        self.size = [len(t) for t in self.shown]
        self.automaton = ahocorasick.Automaton()
        for n, shown in enumerate(self.shown):
            if n < len(base) or self.follows(*self.parts[n], n):
                self.automaton.add_word(shown, n)
        self.automaton.make_automaton()
        self.beyond = re.compile(f"[^\\0-{chr(ord(PLAIN_LIMIT) - 1)}]").search
        self.known = Known(self.word)
        self.pairs: dict[tuple[int, int], bool] = {}

    def closed(self, token: str) -> str:
        """The token with its word end folded into its last symbol."""
        if self.end and token.endswith(self.end):
            return token[: -len(self.end) - 1] + chr(ord(token[-len(self.end) - 1]) + FINAL)
        return token

    def follows(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Do the two tokens stay apart? Only merges made before ``before`` are looked at, so that a token's own
        parts can be asked too."""
        parts, merge = self.parts, self.merge
        while merge.get((left, right), before) >= before:
            if parts[left] is None and parts[right] is None:
                return True
            if left > right:  # the left one was made later: take its last merge back
                before = min(before, left)
                left = parts[left][1]
            else:  # of two equal merges the left one comes first
                before = min(before, right + 1)
                right = parts[right][0]
        return False

    def word(self, word: str) -> bytes:
        """Ids of one word, as the bytes of 32-bit numbers."""
        symbols = self.symbols
        return self.prefixes("".join([symbols[b] for b in word.encode("utf-8")]))

    def prefixes(self, shown: str) -> bytes:
        if self.end:
            shown = shown[:-1] + chr(ord(shown[-1]) + FINAL)
        last = [-1] * (len(shown) + 1)  # the last token of each prefix
        size, pairs = self.size, self.pairs
        if len(pairs) >= REMEMBERED_PAIRS:
            pairs.clear()
        for at, token in self.automaton.iter(shown):
            end = at + 1
            if last[end] < 0:
                start = end - size[token]
                if start:
                    pair = (last[start], token)
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = self.follows(*pair)
                    if not fits:
                        continue
                last[end] = token
        ids, end = [], len(shown)
        while end:
            token = last[end]
            ids.append(self.id[token])
            end -= size[token]
        return array("i", reversed(ids)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if self.special_split and "<|" in text:
            pieces = self.special_split(text)
            parts = [array("i", [self.special[p]]).tobytes() if n % 2 else self.plain(p) for n, p in enumerate(pieces)]
            return np.frombuffer(b"".join(parts), dtype=np.int32)
        return np.frombuffer(self.plain(text), dtype=np.int32)

    def plain(self, text: str) -> bytes:
        if not self.beyond(text):
            return b"".join(map(self.known.__getitem__, self.find(text.lower())))
        text = self.normalizer.normalize_str(text)
        return b"".join([self.prefixes(shown) for shown, _ in self.splitter.pre_tokenize_str(text)])

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.content.__getitem__, ids.tolist()))


class Known(dict):
    """Answers that were given before, as many as fit."""

    def __init__(self, answer):
        super().__init__()
        self.answer = answer

    def __missing__(self, word: str) -> bytes:
        found = self.answer(word)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = found
        return found


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of the whole text as an array column.

    A null or empty text has no ids. Rows are independent, so repeated rows, ties and empty tables need nothing;
    the other columns pass through untouched, and a column already named like ``ids`` is replaced."""
    return _mapped(docs, text, ids, "array<int>", lambda model, column: _lists([model.encode(v or "") for v in column.to_pylist()]), tokenizer_path)


def decode(docs: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of the ids; null ids give an empty text."""
    return _mapped(docs, ids, text, "string", lambda model, column: _texts(model, column), tokenizer_path)


def _mapped(docs: DataFrame, source: str, target: str, kind: str, work, path: str) -> DataFrame:
    given = docs.drop(target) if target != source else docs
    schema = given.withColumn(target, F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = WordBpe.load(path)
        for batch in batches:
            for part in range(0, batch.num_rows, 500):  # the ids of a few texts at a time
                piece = batch.slice(part, 500)
                found = work(model, piece.column(source))
                yield pa.RecordBatch.from_arrays([*piece.columns, found], [*piece.schema.names, target])

    return given.mapInArrow(run, schema)


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(found) + 1, dtype=np.int32)
    np.cumsum([len(f) for f in found], out=offsets[1:])
    flat = np.concatenate([np.empty(0, np.int32), *found])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _texts(model: WordBpe, column: pa.ListArray) -> pa.Array:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return pa.array([model.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
