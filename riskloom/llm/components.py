"""Connected components by alternating large-star and small-star.

Both steps keep the components and move every node closer to the smallest node
of its component. Minima are aggregated before they are shuffled and joined back,
so a node with very many neighbours is never gathered in one task. Each round is
written to the shared folder. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import scratch, stored
from riskloom.operators.joins import many_to_one


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of node and neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return many_to_one(both, least, ["u"], "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = many_to_one(down, least, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node on an edge.

    ``edges`` has whole-number columns ``u`` and ``v``; direction, repetition and
    links of a node with itself don't matter. No edges give an empty result.
    """
    with scratch(edges.sparkSession):
        now = stored(
            edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
            "links",
        )
        mark = None
        while True:
            state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
            if not state["n"] or tuple(state) == mark:
                break
            mark = tuple(state)
            now = stored(_small_star(_large_star(now)), "links")
        roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
        return stored(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "roots", leave=True)
