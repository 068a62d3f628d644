"""Connected components over an edge table, by alternating large-star and small-star steps.

Every step is a ``groupBy(node).min`` (with map-side partial aggregation) joined back to
the edges, so a node of huge degree is never gathered in one task; Spark may split the
join's skewed side. Nodes, edges and labels stay distributed; only one convergence count
per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of an edge; component is its smallest node.

    Edges are undirected; loops and repeats are allowed and give no extra rows. An empty
    edge table gives an empty result. Rows with a null end are no edges.
    """
    now = edges.where(f"{left} IS NOT NULL AND {right} IS NOT NULL")
    now = cut_lineage(now.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b").distinct())
    state = _signature(now)
    if state[0]:
        for _ in range(max_rounds):
            now = cut_lineage(_small_star(_large_star(now).where("a <> b").distinct()).distinct())
            before, state = state, _signature(now)
            if before == state:
                break
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)
