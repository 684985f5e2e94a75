"""Connected components by alternating large-star and small-star.

Each round rewrites the edge list; after O(log^2 n) rounds every node points at
the smallest node of its component.  Neighbour minima are partial aggregates and
the joins are plain equi-joins, so a hub that touches a third of all edges is
pre-aggregated on one side and split by the skew join on the other.  Edges stay
in written tables; the driver sees a count and a checksum per round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaframe.llm.common import stage, workdir


def _minima(directed: DataFrame) -> DataFrame:
    return directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_minima(both), "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    minima = _minima(down)
    moved = down.join(minima, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(minima.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) of every node of an edge (u, v) of longs; `component`
    is the smallest node reachable.  Self-edges and null ends are ignored."""
    path = workdir(edges.sparkSession, "components")
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                  f"{path}/start")
    seen = None
    for i in range(max_rounds):
        edges = stage(small_star(large_star(edges)), f"{path}/round-{i:03d}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")
