"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.store import dropped, stored


def _starred(edges: DataFrame) -> DataFrame:
    """One round: each node's larger, then its smaller neighbours move to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("least", "a"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("least"))
    small = large.join(least, "a")
    return (
        small.select("a", F.col("least").alias("b"))
        .unionByName(small.where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b")))
        .distinct()
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the component's least node) of each node that has an edge.

    ``edges`` has columns ``a`` and ``b`` of one orderable type. Repeated edges, loops and
    edges given either way round are fine; an edge with a null end links nothing; no edges
    give no rows. Stars are drawn alternately over larger and smaller neighbours, so the
    number of rounds follows the logarithm of the longest path; every round is aggregates and
    joins of the edge table, cut off by a written table.
    """
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    for _ in range(rounds):
        after = stored(_starred(edges), "stars")
        dropped(edges)
        edges = after
        # Done when every component is a star: no root hangs from another node.
        if edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                roots.select("node", F.col("node").alias("root"))
            )
    raise RuntimeError(f"components not settled after {rounds} rounds")
