"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every node either hangs on one smaller node only, or has nodes hanging on it only."""
    end = lambda c, hangs: F.struct(F.col(c).alias("node"), F.lit(hangs).alias("hangs"), F.lit(1 - hangs).alias("holds"))
    ends = edges.select(F.explode(F.array(end("hi", 1), end("lo", 0))).alias("e")).select("e.*")
    ends = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return ends.where("hangs + holds > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, root: for every node of `links` (a, b), the smallest node reachable.

    Each round hangs every node's larger neighbours, then the node itself, onto its smallest neighbour, until only stars
    are left: these are the components. Rounds grow with the logarithm of the longest path. Minima are pre-aggregated,
    so a node with very many links is no hot group; each round is written to the shared folder.
    """
    pairs = links.where(F.col("a") != F.col("b"))
    edges = materialize(pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    while not _stars(edges):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
        large = large.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        hung = small.where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = materialize(hung.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
