"""Classes of linked items by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources.tables import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours above it (large star) or not above it (small star) to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, class): the least node of each node's component, for ``links`` (a, b).

    Two star operations a round until nothing changes; the number of rounds grows with the logarithm
    of the longest path. Neighbours are only aggregated to a minimum, never gathered, so a class may
    hold any share of all nodes. Links of a node to itself and nulls are ignored.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut_lineage(edges)
    mark = None
    while True:
        edges = cut_lineage(_star(_star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("class"))).distinct()
