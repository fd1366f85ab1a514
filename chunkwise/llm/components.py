"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links a node's smaller neighbours and the node itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node either has one smaller neighbour or is one, but not both."""
    ends = edges.select("u", F.lit(1).alias("leaf"), F.lit(0).alias("hub")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("leaf"), F.lit(1).alias("hub")).distinct())
    found = ends.groupBy("u").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub"))
    return found.where("leaf > 1 or (leaf > 0 and hub > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(u, component) for each node of ``links`` (u, v) but the least of each component, which is the component's name.

    Rounds run until all components are stars, about the logarithm of the
    longest path; each is written to the shared folder, nothing is collected.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars(edges):
        edges = written(_small(_large(edges)), "links")
    return edges.select("u", F.col("v").alias("component"))
