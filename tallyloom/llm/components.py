"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node and a join, so a hub with very many neighbours
is pre-aggregated and its join side split; no neighbour list is gathered. The
loop ends when a step changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.scale import cut_lineage, discard


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """``edges`` are (u, v) with u > v. Points the larger (or the smaller and own) neighbours of each node at its least one."""
    if larger:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; the root is the least node of its component.

    Self links, repeated links and nulls are allowed and say nothing.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("__a"), F.col(b).alias("__b"))
    edges = edges.filter("__a is not null and __b is not null and u <> v").select("u", "v").distinct()
    mark = before = None
    while True:
        edges = cut_lineage(_star(_star(edges, True), False), "components")
        if before is not None:
            discard(before)
        before = edges
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        mark = now
