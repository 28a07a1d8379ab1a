"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is two shuffles over the edges and is cut with a reliable checkpoint; no node's neighbours are gathered in one
place, so a hub costs its degree in rows, not in one task's memory. The number of rounds grows with the logarithm
of the components' size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours of u at the least node m beside u: the larger ones (large star), or the smaller ones and u itself."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = near.join(least, "u")
    if large:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of an edge (u, v); root is the least node of the component.

    edges: two columns of one orderable type without nulls. Loops, repeated and reversed edges do no harm; a node with
    only a loop is its own root. No edges give no rows.
    """
    nodes = edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v"))
    loops = nodes.where(F.col("u") == F.col("v")).select(F.col("u").alias("node"), F.col("u").alias("root"))
    stars = checkpointed(nodes.where(F.col("u") != F.col("v")).distinct())
    mark = None
    while True:
        stars = checkpointed(_star(_star(stars, True), False))
        seen = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return found.union(roots).union(loops).groupBy("node").agg(F.min("root").alias("root"))
