"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanbook.llm.common import staged


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a link; the root is the smallest node of its component.

    Each turn hangs the larger neighbours of a node, and then its smaller ones, on the smallest of them. A turn is two
    aggregations to a minimum and two joins with one row per node on one side, so that the many links of a hub may be
    split over tasks; nothing is gathered. Turns are logarithmic in the diameter; each is stored in the shared folder."""
    edges = staged(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        turned = staged(small.select("e.*").filter("u != v").distinct(), "links")
        if _content(turned) == _content(edges):
            break
        edges = turned
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())


def _content(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
