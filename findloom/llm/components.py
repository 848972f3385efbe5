"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a map-side combined minimum and a join on the vertex; a vertex with very many links is
split by the adaptive skew join. Links are never gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.llm.scratch import Scratch


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """Point the greater (large) or the other (small) neighbours of each vertex at its least one."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    keep = F.col("v") > F.col("u") if large else F.lit(True)
    linked = arcs.filter(keep).join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.union(least.filter("u != m").select("u", F.col("m").alias("v")))
    return linked.distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)`` for every id in ``links(a, b)``; component is the smallest id reachable."""
    arcs = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "arcs")
    state = None
    while True:
        both = arcs.union(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = scratch.keep(_star(both, large=True), "large")
        down = wide.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        fresh = scratch.keep(_star(down, large=False), "small")
        total = fresh.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(wide, arcs)
        arcs = fresh
        if state == tuple(total):
            break
        state = tuple(total)
    return arcs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(arcs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
