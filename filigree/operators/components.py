"""Connected components over any number of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.sources.scratch import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches, for nodes other than roots.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each keeps the components, and a few of them turn
    each component into a star (logarithmically many, until nothing changes). Edges are stored between rounds; only two sums
    reach the driver.
    """
    stars = stored(_distinct(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "edges")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = _distinct(both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        old, stars = stars, stored(_distinct(small), "edges")
        discard(old)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("u") != F.col("v")).distinct()
