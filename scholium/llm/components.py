"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of the node and its neighbours.

    The large star links only neighbours above the node, the small star the node and those below it. Edges are
    (u, v) with u < v. The minimum is a pre-aggregated group-by joined back, so one node with very many
    neighbours is a skewed join of two plain tables, which adaptive execution splits, not one task's list.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "components-least")
        out = both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v")
    else:
        down = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # each node with its smaller neighbours
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "components-least")
        joined = down.join(least, "u").select(F.col("m").alias("u"), "v")
        out = joined.union(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the smallest node reachable.

    Each round writes its edges to the shared folder. The rounds end when every edge leads from a component's
    smallest node, which the unchanged sum over edges shows; their number grows with the logarithm of the
    longest path.
    """
    ordered = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v")
    now, before = materialize(ordered.distinct(), "components"), None
    while True:
        state = now.agg(
            F.count("*").alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))").alias("s")
        ).first()
        if tuple(state) == before or not state["n"]:
            break
        before = tuple(state)
        now = materialize(_star(_star(now, True), False), "components")
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return roots.union(now.select(F.col("v").alias("node"), F.col("u").alias("component")))
