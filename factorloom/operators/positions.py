"""Full orderings of unbounded groups, built from distributed ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distribution import attach, join_on, value_ranks


def positions(df: DataFrame, keys: list[str], score: str, tie: str, name: str = "pos0") -> DataFrame:
    """0-based place of every row by (score descending, tie ascending), and the group size `n`.

    tie is a unique number per row; rows of one score are ranked by it with the same cell method, so even a score that a third of all rows share is spread
    out. Rows without a score come last; a null key is a group of its own. The caller's columns stay as they are.
    """
    by_score = value_ranks(df, keys, score).select(*keys, score, (F.col("n") - F.col("less") - F.col("cnt")).alias("_above"))
    by_tie = value_ranks(df, [*keys, score], tie).select(*keys, score, tie, F.col("less").alias("_before"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(score).alias("_scored"))
    j = attach(join_on(join_on(df, by_score, [*keys, score], "left"), by_tie, [*keys, score, tie], "left"), sizes, keys)
    return j.withColumn(name, F.coalesce("_above", "_scored") + F.coalesce("_before", F.lit(0))).drop("_above", "_before", "_scored")
