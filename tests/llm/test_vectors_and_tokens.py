"""Hard negatives, whitening and token files against brute force and exact round trips."""

import io
import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loanbook.llm import hard_negatives, queries, token_blocks, whitening
from loanbook.llm.common import shared_folder
from tests.conftest import SMALL

NAN, INF = float("nan"), float("inf")
CLASHING = ("rid", "x", "norm", "angles", "near", "off", "block", "anchor", "score", "_x", "_w", "_key", "n", "slot", "id", "start", "ids")


def vectors(spark, rows):
    """Rows of (vec_id, embedding, label) with columns whose names the operators use themselves."""
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return frame.withColumns({c: F.lit("clash") for c in CLASHING})


# --- hard negatives --------------------------------------------------------------------------------------------------


def brute_negatives(rows, rule=hard_negatives.Rule()):
    """Rows (vec_id, vector, label), anchors where vec_id is divisible by 50."""
    taken = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in rows
             if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    late = lambda i: (i is None, i or 0)
    out = []
    for a, (i, x, label) in enumerate(taken):
        if i is None or i % 50:
            continue
        dots = sorted(((-sum(p * q for p, q in zip(x, y)), late(j), j, m) for b, (j, y, m) in enumerate(taken) if b != a), key=lambda d: d[:2])
        for score, _, j, _ in [d for d in dots if d[3] == label][:rule.positives]:
            fits = [d for d in dots if d[3] != label and rule.least * -score <= 100 * -d[0] <= rule.most * -score]
            out += [(i, j, rank, d[2], -score, -d[0]) for rank, d in enumerate(fits[:rule.negatives], 1)]
    return sorted(out, key=str)


def mined(frame, **settings_):
    return sorted((tuple(r) for r in hard_negatives.mine(frame, F.col("vec_id") % 50 == 0, **settings_).collect()), key=str)


def test_hard_negatives_equal_brute_force_on_ties_repeats_and_faults(spark):
    rng = np.random.default_rng(3)
    rows = [(n, rng.normal(0, 0.3, 8).round(1).tolist(), int(rng.integers(0, 3))) for n in range(260)]
    hot = rows[50][1]
    rows += [(300 + n, hot, n % 2) for n in range(130)]  # one vector in a third of the rows
    rows += [(400, None, 1), (401, [0.1] * 8, None), (402, [NAN] * 8, 1), (403, [INF] + [0.0] * 7, 2), (404, [None] + [0.5] * 7, 1),
             (450, [0.0] * 8, 1), (451, [0.0] * 8, 2), (None, hot, 1), (None, hot, 2), (50, hot, rows[50][2]), (452, [0.5, 0.5], 1), (453, [], 0)]
    assert mined(vectors(spark, rows)) == brute_negatives(rows)


def test_hard_negatives_in_several_blocks_of_anchors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (4, 12))
    rows = [(n, (centres[n % 4] + rng.normal(0, 0.2, 12)).tolist(), n % 5) for n in range(800)]
    assert mined(vectors(spark, rows), block_bytes=4 * 12 * 8) == brute_negatives(rows)


def test_bounds_hold_and_leave_windows_out():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 300, (6, 16))
    x = np.floor(np.repeat(centres, 128, 0) + rng.normal(0, 20, (768, 16))).astype(np.int64)
    norm = np.sqrt((x.astype(float) ** 2).sum(1))
    references = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    spread = hard_negatives.angles(x, norm, references)
    rows = hard_negatives.Rows(np.arange(768), np.arange(768), np.repeat(np.arange(6), 128), x, norm, spread)
    edges = rows.windows()
    assert np.diff(edges).max() == hard_negatives.WINDOW and len(edges) == 13
    anchors = hard_negatives.Anchors(np.arange(0, 768, 32), rows.label[::32], x[::32], norm[::32], spread[::32])
    starts = edges[:-1]
    low, high = np.minimum.reduceat(spread, starts), np.maximum.reduceat(spread, starts)
    lower, upper = hard_negatives.score_bounds(anchors, low, high, np.minimum.reduceat(norm, starts), np.maximum.reduceat(norm, starts))
    exact = x[::32] @ x.T
    for w, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        assert (lower[:, w] <= exact[:, a:b].min(1)).all() and (exact[:, a:b].max(1) <= upper[:, w]).all()
    fifth = np.sort(exact, 1)[:, -6]
    assert (upper < fifth[:, None]).mean() > 0.5  # most windows need no integer score


def test_scores_beyond_doubles_are_exact():
    a = np.array([[2**30 + 1, 2**30 - 1]], dtype=np.int64)
    b = np.array([[2**30 + 3, -(2**30) + 7]], dtype=np.int64)
    assert hard_negatives.scores(b, a, 2.0**61)[0, 0] == sum(int(p) * int(q) for p, q in zip(a[0], b[0]))


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(50, [1.0, 2.0], 1)], [(50, None, None)], [(50, [1e30], 1), (51, [1.0], 1)]])
def test_hard_negatives_of_small_tables(spark, rows):
    found = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0)
    assert found.collect() == []
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


# --- whitening -------------------------------------------------------------------------------------------------------


def integers(rows):
    size = max((len(v) for _, v in rows if v), default=0)
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return [i for i, _ in fine], [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] + [100000] * (size - len(v)) for _, v in fine]


def check_whitening(spark, rows, components=8):
    ids, x = integers(rows)
    n, size = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(size)]
    centred = np.array([[float(Fraction(r[d] * n - sums[d], n)) for d in range(size)] for r in x])
    spread = centred.T @ centred / n
    values, axes = np.linalg.eigh(spread)
    values, axes = values[::-1], axes[:, ::-1]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in CLASHING})
    found = whitening.whiten(frame, components=components).collect()
    kept = min(components, size)
    assert len(found) == n * kept and {r.n for r in found} == {n}
    deviations = sorted(sum((r[d] * n - sums[d]) ** 2 for d in range(size)) for r in x)
    assert sorted(r.deviation for r in found if r.component == 1) == deviations
    for k in range(kept):
        part = sorted((r for r in found if r.component == k + 1), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation))
        if values[k] <= 1e-9 * max(values[0], 1e-300):
            assert all(r.whitened is None for r in part)
            continue
        assert all(abs(r.explained - values[k] / values.sum()) <= 1e-9 * r.explained for r in part)
        order = sorted(range(n), key=lambda a: (ids[a] is None, ids[a] or 0, sum((x[a][d] * n - sums[d]) ** 2 for d in range(size))))
        mine = np.array([r.whitened for r in part])
        theirs = (centred @ axes[:, k] / math.sqrt(values[k]))[order]
        apart = min([abs(values[k] - v) for m, v in enumerate(values) if m != k], default=values[k]) / values[0]
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-11 / max(apart, 1e-12) + 1e-12
    errors = {r.identity_error for r in found}
    assert len(errors) == 1 and all(e is None or e < 1e-9 for e in errors)
    return found


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(n, (rng.normal(0, 1, 6) * [3, 2, 1, 0.5, 0.2, 0.1]).tolist()) for n in range(300)]
    rows += [(None, [1.0] * 6), (7, rows[7][1]), (8, [2.0, 1.0]), (900, None), (901, [NAN] * 6), (902, [None] + [1.0] * 5), (903, [-INF] + [1.0] * 5)]
    check_whitening(spark, rows, components=4)


def test_whitening_of_few_rows_and_constant_dimensions(spark):
    check_whitening(spark, [(1, [1.0, 2.0, 5.0]), (2, [2.0, 4.0, 5.0]), (3, [3.0, 5.0, 5.0])])
    one = check_whitening(spark, [(1, [0.25, -0.5])])
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in one} == {(None, None, None, 0)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_whitening_without_usable_rows(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame).collect() == []


def test_deviation_is_exact_or_null(spark):
    far = [(n, [2.0**16 * (n % 2), 1.0]) for n in range(40)]
    check_whitening(spark, far)
    frame = spark.createDataFrame([(n, [2.0**39 * (n % 2), 1.0]) for n in range(40)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(frame).collect()} == {None}


SPECTRA = {
    "spread": np.linspace(1, 2, 24), "all equal": np.ones(16), "pairs": np.repeat(np.arange(1.0, 9), 2),
    "close": np.concatenate([1 + 1e-9 * np.arange(10), np.linspace(2, 3, 10)]),
    "closer than single precision squared": np.concatenate([1 + 1e-13 * np.arange(6), [5.0, 7.0]]),
    "graded": 10.0 ** np.linspace(-10, 3, 20), "rank one": np.array([0.0] * 7 + [4.0]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_refined_eigenvectors_are_right_beyond_double_precision(name):
    values = SPECTRA[name]
    turn, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(len(values), len(values))))
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found = whitening.eigenpairs(matrix)
    exact = matrix.astype(np.longdouble)
    assert np.abs(exact @ found.vectors - found.vectors * found.values).max() < 1e-17 * np.abs(matrix).max()
    assert np.abs(found.vectors.T @ found.vectors - np.eye(len(values))).max() < 1e-17
    assert (np.diff(found.values) <= 0).all()
    single = np.linalg.eigh(matrix.astype(np.float32))[1].astype(np.longdouble)
    assert np.abs(exact @ single - single * found.values[::-1]).max() > 1e-9 * np.abs(matrix).max() or name == "all equal"


# --- token files -----------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 700), st.integers(0, 32), st.floats(0, 0.3), st.integers(0, 2**31))
def test_blocks_round_trip(length, bits, share, seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 1 << bits, length, dtype=np.uint64).astype(np.uint32)
    odd = rng.random(length) < share
    ids[odd] = rng.integers(0, 1 << 32, int(odd.sum()), dtype=np.uint64)
    blocks = token_blocks.packed(ids)
    sizes = np.array([len(b) for b in blocks], np.int64)
    assert len(blocks) == -(-length // token_blocks.BLOCK)
    if length:
        assert (token_blocks.unpacked(b"".join(blocks), np.cumsum(sizes) - sizes)[:length] == ids).all()


def test_outliers_are_exceptions_and_do_not_widen_a_block():
    ids = np.arange(1000, 1000 + token_blocks.BLOCK, dtype=np.uint32)
    ids[[5, 90]] = 4_000_000_000
    block = token_blocks.packed(ids)[0]
    low, bits, exceptions = np.frombuffer(block, token_blocks.HEAD, 1)[0]
    assert (low, bits, exceptions) == (1000, 8, 2)
    assert len(block) == token_blocks.HEAD.itemsize + 8 * token_blocks.BLOCK // 8 + 2 + 8


class Opened(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_file_reads_any_stretch_from_its_blocks():
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 50000, n).tolist() for n in (0, 5, 300, 0, 1, 128, 2000)]
    stream = io.BytesIO()
    file = token_blocks.FileWriter(stream)
    file.add(pa.array([1, None, 3, 4, 5, 6, 7], pa.int64()), pa.array(ids, pa.list_(pa.int32())))
    assert file.close() == (7, 2434)
    held = token_blocks.FileReader(Opened(stream.getvalue()))
    flat = [i for part in ids for i in part]
    for first, end in ((0, 2434), (0, 1), (127, 129), (400, 1700), (2433, 9999), (50, 50)):
        assert held.ids(first, end).tolist() == flat[first:end]
    assert held.ends.tolist() == np.cumsum([len(p) for p in ids]).tolist() and held.nulls.tolist() == [False, True] + [False] * 5
    with pytest.raises(ValueError):
        token_blocks.FileReader(Opened(stream.getvalue()[:-3]))


TEXTS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "One"), (4, "One"), (None, "one two three"), (6, "Ünïcode 💡 words 12 and so on"), (7, "a b " * 5000),
    (-5, "x\x1cy z\x85w　v u"), (9, "<|endoftext|> it's <|"), (10, "Σας ΟΔΟΣ. e ́a İstanbul ﬁ"), (11, "q" * 20000), (None, None), (4, "Two, other"),
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_documents_round_trip(spark, library):
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)
    path = f"{shared_folder(spark)}/test-token-files"
    token_blocks.write_documents(frame, path, queries.tokenizer_path())
    back = sorted(token_blocks.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id, tuple(r.ids)) for r in back), key=str) == sorted(((i, tuple(library(t))) for i, t in TEXTS), key=str)
    keys = [r.doc_id for r in back]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    total = 0
    for r in back:
        assert r.start == total
        total += len(r.ids)
    flat = [i for r in back for i in r.ids]
    part = sorted(token_blocks.read_documents(spark, path, first=100, end=12000).collect(), key=lambda r: r.start)
    assert [i for r in part for i in r.ids] == flat[100:12000] and part[0].start == 100
    as_bytes = {r.start: bytes(r.ids) for r in token_blocks.read_documents(spark, path, as_bytes=True).collect()}
    assert as_bytes == {r.start: np.array(r.ids, "<u4").tobytes() for r in back}
    # Written again, the files say the same; another folder is empty.
    token_blocks.write_documents(frame, path, queries.tokenizer_path())
    assert sorted(token_blocks.read_documents(spark, path).collect(), key=lambda r: r.start) == back
    token_blocks.write_documents(frame.limit(0), f"{path}-empty", queries.tokenizer_path())
    assert token_blocks.read_documents(spark, f"{path}-empty").collect() == []


def test_files_of_failed_attempts_are_not_read(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.dataSource.register(token_blocks.TokenBlocks)
    spark.createDataFrame([(1, [5, 6])], "doc_id long, ids array<int>").write.format("token_blocks").mode("append").save(path)
    (tmp_path / "files" / "part-000000-lost.pfr").write_bytes(b"half a file")
    spark.createDataFrame([(2, [7]), (3, None)], "doc_id long, ids array<int>").coalesce(1).write.format("token_blocks").mode("append").save(path)
    rows = sorted(token_blocks.read_documents(spark, path).collect(), key=lambda r: (r.start, r.doc_id))
    assert [tuple(r) for r in rows] == [(1, 0, [5, 6]), (2, 2, [7]), (3, 3, [])]


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    words = token_blocks.LibraryWords(public_tokenizers.path("byte_bpe_50k.json"))
    assert not words.plain and token_blocks.LibraryWords(queries.tokenizer_path()).plain
    for text in ("a b  c", "", "it's  so"):
        assert words.ids(text) == words.whole(text)


def test_forgotten_words_are_encoded_again(monkeypatch, library):
    monkeypatch.setattr(token_blocks, "REMEMBERED", 3)
    words = token_blocks.LibraryWords(queries.tokenizer_path())
    text = "one two three four one Two é1 " * 3 + "x" * 50
    assert [*np.frombuffer(words.ids(text), np.int32).tolist(), 2] == library(text) and len(words) <= 3


def test_token_query_counts_and_sums(spark, library):
    found = {r.doc_id: r for r in queries.op13_token_blocks(spark, SMALL).collect()}
    start = 0
    for row in sorted(spark.read.parquet(f"{SMALL}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = library(row.text)
        expected = (row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert tuple(found[row.doc_id]) == expected
        start += len(ids)


def test_whitening_query_is_white_and_explains_by_falling_shares(spark):
    rows = queries.op12_whitening(spark, SMALL).collect()
    shares = {r.component: r.explained for r in rows}
    assert sorted(shares) == list(range(1, 9)) and [shares[k] for k in range(1, 9)] == sorted(shares.values(), reverse=True)
    assert max(r.identity_error for r in rows) < 1e-10
    placed = {}
    for r in rows:
        placed.setdefault(r.component, []).append(r.whitened)
    assert np.abs(np.cov(np.array([placed[k] for k in range(1, 9)]), bias=True) - np.eye(8)).max() < 1e-10
