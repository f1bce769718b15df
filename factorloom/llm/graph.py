"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

MOST_ROUNDS = 60


def _settled(e: DataFrame) -> bool:
    """Has every vertex that points anywhere one edge, and does none of them get pointed at?"""
    if not e.groupBy("a").count().where("count > 1").isEmpty():
        return False
    return e.select(F.col("b").alias("a")).distinct().join(e.select("a"), "a", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every vertex of edges (a, b), c being the smallest vertex of its component.

    Each step is a grouped minimum, which sums map-side, and a join back, which AQE splits at a vertex with very many edges. Every
    round is written to the shared folder, so plans stay short and a lost executor costs one round. Loops, repeated edges and null ends are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    for _ in range(MOST_ROUNDS):
        if _settled(e):
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # one row per edge: a larger neighbour moves to the smallest vertex around; written, as it is read twice
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(parent.select("a", F.col("m").alias("b")))
        e = materialize(small.distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("v"), F.col("b").alias("c")).unionByName(e.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct())
