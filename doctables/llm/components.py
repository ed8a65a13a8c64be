"""Connected components of a graph given as edges, by joins and sums only.

Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in
MapReduce and Beyond" (2014): every node points its larger neighbours, then its smaller ones, at its
smallest. No component is gathered anywhere, minima are combined before each shuffle, and a node
with very many neighbours is a large side of a plain join, which adaptive execution splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b, never null): root is the smallest node
    of its component by the order of the column's type. Each round is stored in ``folder``."""
    pairs = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct(), folder, f"{name}-edges")
    round_no, before = 0, None
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # u > v
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(
            least.select(F.col("u").alias("b"), F.col("m").alias("a"))).distinct()
        pairs = written(small, folder, f"{name}-{round_no}")
        # The sum of hashes says whether the set of edges has changed.
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        round_no += 1
        if now == before:
            break
        before = now
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
