"""Connected components of an edge table by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a", "a").cast("long"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, root): root is the smallest vertex of the component; only vertices with an edge are listed.

    edges has columns a and b of one ordered type. Self-loops and repeats are harmless; an empty table gives none.
    Each round aggregates with map-side minima and joins them back, so a hub's edges need no single task.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e, "edges")
    state = _state(e)
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u moves to the smallest vertex around u.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the smaller neighbours of u, and u, move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = cut(small.distinct(), "edges")
        if (now := _state(e)) == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
