"""Connected components of links in tables, by alternating star contractions. No link and no component is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.llm.common import written


def stars(edges: DataFrame) -> DataFrame:
    """u, v with v the smallest node that u is connected to, for every u that isn't the smallest itself; by
    alternating large-star and small-star steps until nothing changes."""
    edges, mark = written(edges), None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = written(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges
        mark = now


def least(star: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """The node column and component_id, the least `first` of its component, for all nodes (node column, first)."""
    linked = star.union(star.select("v", "v").distinct()).select(F.col("u").alias(node), F.col("v").alias("root"))
    member = linked.join(nodes.select(node, "first"), node)
    low = member.groupBy("root").agg(F.min("first").alias("least"))
    return nodes.join(member.join(low, "root").select(node, "least"), node, "left").select(node, F.coalesce("least", "first").alias("component_id"))
