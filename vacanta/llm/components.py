"""Connected components of a link table, by alternating large and small stars.

Every round replaces links by links to the smallest neighbour, which halves the depth of the trees
about each time, and is written to the shared folder, so that no lineage grows and a lost executor
costs no more than its tasks. Aggregation is partial before every shuffle, and its result is staged, so
that a hot node's links meet only in a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.sources.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node, and no other, to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(stage(lowest, "lowest"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    lowest = stage(down.groupBy("a").agg(F.min("b").alias("m")), "lowest")
    moved = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node but the centres has one link, and that to a centre."""
    several = edges.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low < high")
    inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return several.select("a").limit(1).unionAll(inner.select("a").limit(1)).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component): every linked id with the smallest id that it can reach.

    ``links`` has the columns a and b. Ids without links are not in the result; loops are ignored.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")

    while not _are_stars(edges):
        edges = stage(_small_star(stage(_large_star(edges), "links")), "links")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
