"""Connected components by alternating large-star and small-star steps, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, component for the nodes of edges (a, b), of any one ordered type: component is the least node that is connected with it.

    Nulls and loops are left out. Each round hangs the larger neighbours of a node, then its smaller ones, on its least neighbour; the rounds
    grow with the logarithm of the number of nodes. The links are written in each round and never gathered.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct(), "links")
    for _ in range(ROUNDS):
        centres = links.select(F.col("to").alias("node")).distinct()
        if links.join(centres, "node", "left_semi").isEmpty() and links.groupBy("node").count().where("count > 1").isEmpty():
            break  # every node hangs on one centre, and no centre hangs on another
        both = links.unionByName(links.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("least"))
        large = both.join(least, "node").where("to > node").select(F.col("to").alias("node"), F.col("least").alias("to"))
        least = large.groupBy("node").agg(F.min("to").alias("least"))
        small = large.join(least, "node")
        small = small.where("to <> least").select(F.col("to").alias("node"), F.col("least").alias("to")).unionByName(least.select("node", F.col("least").alias("to"))).distinct()
        links = cut(small, "links")
    else:
        raise RuntimeError("components did not settle")
    return links.select("node", F.col("to").alias("component")).unionByName(links.select(F.col("to").alias("node"), F.col("to").alias("component")).distinct())
