"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that each node of an edge reaches, itself included.

    Alternating large and small stars: every node hands its larger neighbours, then its smaller
    ones, to the smallest node it sees, until every node has one neighbour or is a centre of such.
    Edges that are so from the start take no round.  The rounds grow with the logarithm of the
    longest chain.  Only minima are aggregated, so a node with very many neighbours is combined
    before its shuffle, and its edges meet a single row in a join that adaptive execution can
    split.  Edges with a null end and loops are left out; no edges give no rows.
    """
    ends = edges.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b")
    )
    now = ends.where("_a IS NOT NULL AND _b IS NOT NULL AND u <> v").select("u", "v").distinct()
    now = stage(now, "edges")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # a pair comes twice here if two neighbours have the same smallest node; the end of the round has each once
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end u of edges (u, v), which are all different, is in one edge and is no other's smaller end."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("times")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("times"))
    )
    ends = ends.groupBy("node").agg(F.sum("times").alias("edges"), F.min("times").alias("least"))
    return ends.where("edges > 1 OR (edges = 1 AND least = 0)").isEmpty()
