"""Connected components of an edge list, by alternating large-star and small-star steps.

Each step is one aggregation (combined before the shuffle) and one equi-join that Spark may
split where a node has very many edges; each round is written to the shared folder, so the
plan stays short and a lost executor repeats one round at most. The number of rounds grows
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm.shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: link every larger neighbour of a node to the least node around. Small: the smaller ones and the node itself."""
    low = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = edges.join(low, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b), root the least node reachable."""
    held = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        now = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        held = stored(_star(stored(_star(both, True), "large"), False), "small")
    else:
        raise RuntimeError("components did not settle")
    nodes = held.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
