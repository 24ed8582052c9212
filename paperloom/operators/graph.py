"""Connected components over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut_lineage


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, root): the least node of each component.

    ``nodes`` has the column ``node``, ``edges`` the columns a and b. Every round takes the least root among the
    neighbours and then the root of that root, so long chains shrink by a factor; a node with very many neighbours only
    sends a minimum through the map-side aggregation. Nothing is collected but the question whether anything changed.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut_lineage(nodes.select(F.col(node).alias("n"), F.col(node).alias("root")))
    while True:
        low = both.join(state.select(F.col("n").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
        fresh = state.join(low.withColumnRenamed("a", "n"), "n", "left").select("n", "root", F.least("root", F.coalesce("low", "root")).alias("next"))
        jump = state.select(F.col("n").alias("next"), F.col("root").alias("far"))
        after = cut_lineage(fresh.join(jump, "next", "left").select("n", "root", F.least("next", F.coalesce("far", "next")).alias("next")))
        if after.where("root != next").limit(1).count() == 0:
            return after.select(F.col("n").alias(node), "root")
        state = after.select("n", F.col("next").alias("root"))
