"""Connected components of a link table by alternating stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage


#: the neighbours of a node are dealt to this many parts
PARTS = 32


def _with_least(rows: DataFrame) -> DataFrame:
    """``u, v`` and the least ``m`` of ``u`` and all its ``v``.

    A hub meets its neighbours in parts, each of which learns the least node of all parts.
    """
    rows = rows.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    parts = rows.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.least(F.col("u"), F.min("m")).alias("m"))
    return rows.join(parts.select("u", "part").join(least, "u"), ["u", "part"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the least node of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its lesser neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _with_least(down).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v"))


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node has two parents, or is both parent and child."""
    ends = edges.select("u", F.lit(1).alias("parents"), F.lit(0).alias("children"))
    ends = ends.unionAll(edges.select("v", F.lit(0), F.lit(1))).groupBy("u")
    ends = ends.agg(F.sum("parents").alias("parents"), F.max("children").alias("children"))
    return not ends.where("parents > 1 OR parents > 0 AND children > 0").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) of every node with a link; ``edges`` has ``u, v``.

    A hub with very many links is dealt in parts; nothing gathers a neighbourhood.
    Each round is written to the shared folder, which cuts lineage, and rounds end when all links
    go from a node to its root.  Their number grows with the logarithm of the longest path.
    """
    edges = stage(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while _unsettled(edges):
        edges = stage(_small_star(_large_star(edges)).distinct(), "stars")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
