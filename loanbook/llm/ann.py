"""Nearest neighbours by a forest of hash prefixes.

Every vector gets one long hash string per tree, the signs of its products with random directions; in a tree vectors
lie sorted by it. A query descends to the longest prefix that it shares with others and then ascends in all trees at
once, depth by depth, until the prefixes of that depth hold enough candidates. How many are enough is fitted: a bounded
sample of queries is compared with all vectors, and the number is the least one at which the forest finds the wanted
share of their true neighbours. Trees are dealt in blocks of bounded size by prefix; a query goes to the blocks that its
prefix covers and scans the matching run of the sorted block.

Equal vectors are one entry with their smallest ids, so that a vector with a third of all rows is no larger than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanbook.llm.common import staged


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 24
    bits: int = 32
    block: int = 4096  # entries that a block holds about; larger ones are split
    sample: int = 128  # queries compared with everything to fit the number of candidates
    recall: float = 0.96  # wanted on the sample
    seed: int = 5


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision; each depends on its two vectors alone, not on the others in the block."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def hashes(rows: np.ndarray, settings: ForestSettings) -> np.ndarray:
    """One number per row and tree whose bits are the hash string, first symbol highest."""
    directions = np.random.default_rng([settings.seed, rows.shape[1]]).normal(size=(settings.trees * settings.bits, rows.shape[1]))
    signs = (rows @ directions.T > 0).reshape(len(rows), settings.trees, settings.bits)
    return signs @ (1 << np.arange(settings.bits - 1, -1, -1, dtype=np.int64))


def entries(vectors: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """Usable vectors, equal ones together: (entry, dim, vec, ids); entry is the smallest id, ids the ``most`` smallest.

    Rows beyond the most smallest ids of a vector are dropped before the shuffle; no answer can need them."""
    v = F.col(vector).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(finite & F.exists(v, lambda x: x != 0))
    named = usable.select(F.col(key).cast("long").alias("id"), v.alias("vec")).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("_n") <= most)
    return first.groupBy("h1", "h2").agg(F.min("id").alias("entry"), F.min_by("vec", "id").alias("vec"), F.array_sort(F.collect_list("id")).alias("ids")).select(
        "entry", "h1", "h2", F.size("vec").alias("dim"), "vec", "ids")


def _hashed(index: DataFrame, settings: ForestSettings) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, part in frame.groupby("dim"):
                yield part.assign(hashes=list(hashes(_matrix(part["vec"]), settings)))

    return index.mapInPandas(run, index.withColumn("hashes", F.array().cast("array<long>")).schema)


def _true_neighbours(index: DataFrame, sample: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest entries of each sampled query among all entries, by brute force in blocks."""
    by_dim = {dim: (part["entry"].to_numpy(), _matrix(part["vec"])) for dim, part in sample.groupby("dim")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                if dim not in by_dim:
                    continue
                queries, rows = by_dim[dim]
                own, entry = _unit(_matrix(part["vec"])), part["entry"].to_numpy()
                for q, row in zip(queries, _unit(rows), strict=True):
                    near = own @ row
                    near[entry == q] = -2
                    best = np.argsort(-near)[:k]
                    best = best[near[best] > -2]
                    yield pd.DataFrame({"query": q, "entry": entry[best], "score": near[best], "hashes": list(part["hashes"].to_numpy()[best])})

    near = index.mapInPandas(run, "query long, entry long, score double, hashes array<long>")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))
    return near.withColumn("_r", rank).filter(F.col("_r") <= k).toPandas()


def _depth_counts(index: DataFrame, depth: int, settings: ForestSettings) -> DataFrame:
    """(dim, tree, depth, prefix, n) for all depths from 0 on: counted once at the deepest, then rolled up."""
    deepest = index.select("dim", F.posexplode("hashes").alias("tree", "hash")).groupBy("dim", "tree", F.shiftright("hash", settings.bits - depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    deepest = staged(deepest, "ann-cells")
    unfolded = deepest.select("dim", "tree", "cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    return unfolded.groupBy("dim", "tree", "depth", F.expr(f"shiftright(cell, {depth} - depth)").alias("prefix")).agg(F.sum("n").alias("n"))


def _reach(queries: DataFrame, counts: DataFrame, depth: int, settings: ForestSettings) -> DataFrame:
    """(entry, depth, held): how many candidates the prefixes of a query hold at each depth, over all trees."""
    asked = queries.select("entry", "dim", F.posexplode("hashes").alias("tree", "hash")).select(
        "entry", "dim", "tree", "hash", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    asked = asked.withColumn("prefix", F.expr(f"shiftright(hash, {settings.bits} - depth)"))
    return asked.join(counts, ["dim", "tree", "depth", "prefix"]).groupBy("entry", "depth").agg(F.sum("n").alias("held"))


def fitted_candidates(index: DataFrame, queries: DataFrame, counts: DataFrame, depth: int, k: int, settings: ForestSettings) -> int:
    """The least number of candidates at which the sampled queries find the wanted share of their neighbours."""
    chosen = queries.orderBy(F.xxhash64("entry", F.lit(settings.seed)), "entry").limit(settings.sample)
    sample = staged(chosen, "ann-sample")
    local = sample.select("entry", "dim", "vec", "hashes").toPandas()
    if local.empty:
        return 1
    truth = _true_neighbours(index, local, k)
    held = _reach(sample, counts, depth, settings).toPandas()
    own = dict(zip(local["entry"], local["hashes"], strict=True))
    # Depth at which the forest meets a true neighbour: the longest common prefix over all trees.
    met: dict[int, list[int]] = {}
    for query, theirs in zip(truth["query"], truth["hashes"], strict=True):
        apart = [int(x).bit_length() for x in np.bitwise_xor(np.asarray(own[query]), np.asarray(theirs))]
        met.setdefault(query, []).append(settings.bits - min(apart))
    levels = {q: part.sort_values("depth", ascending=False) for q, part in held.groupby("entry")}

    def recall(candidates: int) -> float:
        shares = []
        for q, found in met.items():
            enough = levels[q]["depth"][levels[q]["held"] >= candidates]
            at = enough.iloc[0] if len(enough) else 0
            shares.append(np.mean([m >= at for m in found]))
        return float(np.mean(shares)) if shares else 1.0

    for candidates in sorted({int(h) for h in held["held"]}):
        if recall(candidates) >= settings.recall:
            return candidates
    return int(held["held"].max())


def nearest(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", settings: ForestSettings = ForestSettings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row that ``is_query`` (a column) marks.

    Nearest is the largest cosine, ties go to the smaller id. Rows with a null id take no part, nor do vectors that are
    null, empty, zero or hold a null or non-finite component; vectors of different length are not compared. Repeated
    rows are further candidates with the same id and are asked once per row. Other columns are not read."""
    index = staged(_hashed(entries(vectors, key, vector, k + 1), settings), "ann-index")
    asking = staged(
        vectors.filter(is_query).filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
        .select("query_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
        .join(index.select("h1", "h2", "entry", "vec", "ids"), ["h1", "h2"]).select("query_id", "entry", "ids"), "ann-asking")
    queries = staged(index.join(asking.select("entry").distinct(), "entry").select("entry", "dim", "vec", "hashes"), "ann-queries")

    total = max(1, index.count())
    bits = settings.bits
    depth = min(bits - 1, max(1, int(np.log2(total)) - 3))
    counts = staged(_depth_counts(index, depth, settings), "ann-counts")
    wanted = fitted_candidates(index, queries, counts, depth, k, settings)
    reach = _reach(queries, counts, depth, settings).filter(F.col("held") >= wanted).groupBy("entry").agg(F.max("depth").alias("depth"))
    placed = queries.join(reach, "entry", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))

    # Blocks: the entries of a tree under one prefix, split by a hash of the entry where there are many.
    at = max(0, min(depth, int(np.log2(max(1, total / settings.block)))))
    cells = counts.filter(F.col("depth") == at).select("dim", "tree", F.col("prefix").alias("cell"), F.ceil(F.col("n") / settings.block).cast("int").alias("parts"))
    stored = index.select("entry", "dim", "vec", F.posexplode("hashes").alias("tree", "hash")).withColumn("cell", F.shiftright("hash", bits - at))
    stored = stored.join(cells, ["dim", "tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int"))
    asked = placed.select("entry", "dim", "vec", "depth", F.posexplode("hashes").alias("tree", "hash"))
    low = F.expr(f"shiftleft(shiftright(hash, {bits} - least(depth, {at})), {at} - least(depth, {at}))")
    high = low + F.expr(f"shiftleft(1L, {at} - least(depth, {at}))") - 1
    asked = asked.withColumn("cell", F.explode(F.sequence(low, high))).join(cells, ["dim", "tree", "cell"])
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def search(key, block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if block.empty or asked.empty:
            return pd.DataFrame({"query": [], "entry": [], "score": []})
        block = block.sort_values("hash")
        order, entry, rows = block["hash"].to_numpy(), block["entry"].to_numpy(), _matrix(block["vec"])
        out = []
        for query, vec, own, depth in zip(asked["entry"], asked["vec"], asked["hash"], asked["depth"], strict=True):
            first = (own >> (bits - depth)) << (bits - depth)
            a, b = np.searchsorted(order, [first, first + (1 << (bits - depth))])
            near = cosines(rows[a:b], np.asarray(vec))
            near[entry[a:b] == query] = -np.inf
            best = np.lexsort((entry[a:b], -near))[:k]
            best = best[np.isfinite(near[best])]
            out.append(pd.DataFrame({"query": query, "entry": entry[a:b][best], "score": near[best]}))
        return pd.concat(out)

    blocks = ["dim", "tree", "cell", "part"]
    found = (
        stored.select(*blocks, "entry", "vec", "hash").groupBy(*blocks)
        .cogroup(asked.select(*blocks, "entry", "vec", "hash", "depth").groupBy(*blocks))
        .applyInPandas(search, "query long, entry long, score double")
        .dropDuplicates(["query", "entry"])
    )
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))
    best = found.withColumn("_r", rank).filter(F.col("_r") <= k).join(index.select("entry", "ids"), "entry")
    per_entry = best.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near"))

    # The other rows of the query's own vector come with the cosine of the vector with itself.
    same = queries.select("entry", _self_cosine()("vec").alias("same"))
    joined = asking.join(same, "entry").join(per_entry.withColumnRenamed("query", "entry"), "entry", "left")
    flat = lambda p: F.transform(p["ids"], lambda i: F.struct((-p["score"]).alias("far"), i.alias("vec_id")))
    own = F.transform("ids", lambda i: F.struct((-F.col("same")).alias("far"), i.alias("vec_id")))
    others = F.coalesce(F.flatten(F.transform("near", flat)), F.slice(own, 1, 0))
    listed = F.slice(F.array_sort(F.concat(F.filter(own, lambda x: x["vec_id"] != F.col("query_id")), others)), 1, k)
    answers = joined.select("query_id", F.posexplode(listed).alias("at", "x"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def _self_cosine():
    def run(vec: pd.Series) -> pd.Series:
        return pd.Series([float(cosines(np.asarray(v)[None, :], np.asarray(v))[0]) for v in vec])

    run.__annotations__ = {"vec": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")
