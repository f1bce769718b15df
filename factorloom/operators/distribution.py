"""Exact ranks and percentiles of unbounded groups, without sorting a group in one task.

A group's values are first reduced to (value, count), so ties, however heavy, are one row. The distinct values of all
groups are then dealt out by range: a cell is one range partition of (keys, value), and its borders come from a sample of the values
themselves, so close values with one far outlier spread as evenly as any others. The dealt rows are written once, so
a recomputed task sees the same cells. Cell totals give each cell its offset, and only the values inside one cell are ever
sorted together. Values keep their type, and a null group key is a group of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Distinct values that one cell should hold.
CELL_ROWS = 500_000
#: Written statistics of at most so many bytes are broadcast.
SMALL_BYTES = 32 << 20


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys come from the left side."""
    other = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    cond = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    return left.join(other, cond, how).drop(*[f"_on_{k}" for k in keys])


def value_ranks(df: DataFrame, keys: list[str], value: str, cell_rows: int | None = None) -> DataFrame:
    """(keys, value, cnt, less, n): rows per value, rows strictly below it, rows in the group; null values are left out.

    Without keys the whole table is one group.
    """
    counts = materialize(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt")), "value-counts")
    return counted_ranks(counts, keys, value, cell_rows)


def counted_ranks(counts: DataFrame, keys: list[str], value: str, cell_rows: int | None = None) -> DataFrame:
    """The same from a written table of (keys, value, cnt), other columns kept out. Values that all fit one cell are not dealt out: no group can be larger."""
    spark, total, cell_rows = counts.sparkSession, counts.count(), cell_rows or CELL_ROWS
    if total <= cell_rows:
        one = Window.partitionBy(*(keys or [F.lit(0)]))
        below = F.sum("cnt").over(one.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
        return counts.select(*keys, value, "cnt", F.coalesce(below, F.lit(0)).alias("less"), F.sum("cnt").over(one).alias("n"))
    cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / cell_rows))
    dealt = counts.repartitionByRange(cells, *keys, value).withColumn("_cell", F.spark_partition_id())
    dealt = materialize(dealt, "value-cells")
    group = keys or [F.lit(0)]
    # one row per group and cell: at most `cells` rows in any window
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*keys, "_cell").agg(F.sum("cnt").alias("_m"))
        .withColumns({"_off": F.coalesce(F.sum("_m").over(before), F.lit(0)), "n": F.sum("_m").over(Window.partitionBy(*group))}).drop("_m")
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_in", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    return join_on(ranked, offsets, [*keys, "_cell"]).select(*keys, value, "cnt", (F.col("_off") + F.col("_in")).alias("less"), "n")


def average_rank() -> Column:
    """Average rank (1-based) of a value from value_ranks columns."""
    return F.col("less") + (F.col("cnt") + 1) / 2.0


def rank_table(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, value, name, name_n): average rank per distinct value and the group size."""
    return value_ranks(df, keys, value).select(*keys, value, average_rank().alias(name), F.col("n").alias(f"{name}_n"))


def with_average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Attach the average rank, null for a null value; the rank table has one row per value, so skewed values split under AQE."""
    return join_on(df, rank_table(df, keys, value, name), [*keys, value], "left")


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles per group: one row of keys plus one column per point."""
    return interpolated(value_ranks(df.withColumn(value, F.col(value).cast("double")), keys, value), keys, value, points)


def interpolated(r: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """The percentiles that value_ranks or counted_ranks imply."""

    def value_at(index: Column) -> Column:
        return F.max(F.when((F.col("less") <= index) & (index < F.col("less") + F.col("cnt")), F.col(value)))

    aggs = []
    for name, p in points.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        aggs += [
            value_at(F.floor(pos)).alias(f"_lo_{name}"), value_at(F.ceil(pos)).alias(f"_hi_{name}"),
            F.max(pos - F.floor(pos)).alias(f"_f_{name}"),
        ]
    out = r.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in points
        ],
    )


def attach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left", small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Join group statistics back onto the rows, null keys included.

    The statistics are written out first, which is one row per group, and counted. If those rows, at 16 bytes a column, stay
    below `small_bytes`, they are broadcast, so the rows are not shuffled by a key that a few buckets dominate; more
    than that takes the shuffle join, where AQE splits hot keys.
    """
    table = materialize(stats, "group-stats")
    small = table.count() * 16 * len(table.columns) <= small_bytes
    return join_on(df, F.broadcast(table) if small else table, keys, how)
