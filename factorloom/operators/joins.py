"""As-of, nth-bar, and symbol-fallback joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import col

#: Rows that one task should make of the rows it was given.
TASK_ROWS = 1_000_000


def base_symbol(ticker) -> Column:
    return F.upper(F.trim(F.split_part(col(ticker), F.lit("."), F.lit(1))))


def spread(df: DataFrame, each: int, task_rows: int | None = None) -> DataFrame:
    """Rows dealt out evenly, ahead of a step that makes `each` rows of every one: no task then makes more than about `task_rows`.

    A narrow table is few bytes and so one scan task, however many rows it turns into.
    """
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(few, math.ceil(df.count() * each / (task_rows or TASK_ROWS))))


def newest_per_day(df: DataFrame, key: str, day: str, order: str, value: str) -> DataFrame:
    """One row per (key, day): the value with the largest order column. Combines on the map side."""
    return df.groupBy(key, day).agg(F.max_by(value, order).alias(value))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, value: str) -> DataFrame:
    """Newest right row with right_day <= left_day per key; right holds one row per (key, day).

    Both sides are reduced to one row per (key, day) before the ordered pass, so a key's window is
    bounded by the calendar; the result is joined back on the day.
    """
    probes = left.select(key, F.col(left_day).alias("_d"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).distinct()
    facts = right.select(key, F.col(right_day).alias("_d"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy("_d", "_side").rowsBetween(Window.unboundedPreceding, 0)
    fact = F.when(F.col("_side") == 0, F.struct(F.col("_d").alias(right_day), F.col("_v").alias(value)))
    hit = probes.unionByName(facts).withColumn("_hit", F.last(fact, ignorenulls=True).over(w)).where("_side = 1")
    found = hit.select(key, F.col("_d").alias(left_day), F.col(f"_hit.{right_day}").alias(right_day), F.col(f"_hit.{value}").alias(value))
    return left.join(found, [key, left_day], "left")


def numbered_bars(bars: DataFrame, key: str = "sid", day: str = "d") -> DataFrame:
    return bars.withColumn("bar_no", F.row_number().over(Window.partitionBy(key).orderBy(day)))


def entry_bar(anchors: DataFrame, bars: DataFrame, key: str = "sid", anchor: str = "anchor", day: str = "d") -> DataFrame:
    """(key, anchor, bar_no): number of the first bar on or after each anchor date; none past the last bar."""
    nb = numbered_bars(bars, key, day)
    probes = anchors.select(key, F.col(anchor).alias("_d"), F.lit(0).alias("_side"), F.lit(None).cast("int").alias("bar_no")).distinct()
    facts = nb.select(key, F.col(day).alias("_d"), F.lit(1).alias("_side"), F.col("bar_no"))
    w = Window.partitionBy(key).orderBy("_d", "_side").rowsBetween(0, Window.unboundedFollowing)
    first = F.first("bar_no", ignorenulls=True).over(w)
    return probes.unionByName(facts).withColumn("bar_no", first).where("_side = 0").select(key, F.col("_d").alias(anchor), "bar_no")


def offset_prices(signals: DataFrame, bars: DataFrame, offsets: list[int], key: str = "sid", anchor: str = "anchor") -> DataFrame:
    """Close of the k-th bar after the entry bar, for each offset; missing past the end of the series."""
    at = entry_bar(signals, bars, key, anchor)
    wanted = signals.join(at, [key, anchor]).withColumn("k", F.explode(F.array(*map(F.lit, offsets)))).withColumn("bar_no", F.col("bar_no") + F.col("k"))
    return wanted.join(numbered_bars(bars, key).select(key, "bar_no", F.col("close").alias("price")), [key, "bar_no"], "left")


def bulk_index(bulk: DataFrame, symbol: str = "symbol") -> DataFrame:
    """(key, row id): each symbol, plus each base that exactly one suffixed symbol has and no symbol equals."""
    rows = bulk.select(F.upper(F.trim(col(symbol))).alias("sym"), "row_id").where("sym <> ''")
    exact = rows.groupBy("sym").agg(F.max("row_id").alias("row_id"))
    bases = exact.where(F.contains("sym", F.lit("."))).groupBy(base_symbol("sym").alias("key")).agg(
        F.count(F.lit(1)).alias("k"), F.max("row_id").alias("row_id")
    ).where("k = 1").drop("k")
    own = exact.withColumnRenamed("sym", "key")
    return own.unionByName(bases.join(own.select("key"), "key", "left_anti"))


def fallback_join(universe: DataFrame, bulk: DataFrame, ticker: str = "ticker", symbol: str = "symbol") -> DataFrame:
    """Exact symbol first; a symbol without suffix may serve a ticker whose base no other ticker shares."""
    rows = bulk.select(F.upper(F.trim(col(symbol))).alias("sym"), "row_id").where("sym <> ''")
    one = rows.groupBy("sym").agg(F.min("row_id").alias("row_id"))
    shared = universe.groupBy(base_symbol(ticker).alias("base")).agg(F.count(F.lit(1)).alias("sharing"))
    u = universe.withColumn("base", base_symbol(ticker)).join(shared, "base")
    exact = one.select(F.col("sym").alias(ticker), F.col("row_id").alias("exact_id"))
    bare = one.where(~F.contains("sym", F.lit("."))).select(F.col("sym").alias("base"), F.col("row_id").alias("base_id"))
    j = u.join(exact, ticker, "left").join(bare, "base", "left")
    return j.withColumn("row_id", F.coalesce("exact_id", F.when(F.col("sharing") == 1, F.col("base_id"))))


def symbol_candidates(universe: DataFrame, ticker: str = "ticker") -> DataFrame:
    """(ticker, symbol, prio): the ticker itself, then its base symbol."""
    both = F.array_distinct(F.array(col(ticker), base_symbol(ticker)))
    return universe.select("*", F.posexplode(both).alias("prio", "symbol"))


def newest_by_candidate(universe: DataFrame, facts: DataFrame, order: list, n: int = 1) -> DataFrame:
    """Newest n fact rows of the first candidate symbol that has any; names without facts stay, with nulls.

    Facts per symbol are cut to n rows before the candidates meet them.
    """
    w = Window.partitionBy("symbol").orderBy(*order)
    top = facts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    j = symbol_candidates(universe).join(top, "symbol")
    best = j.groupBy("ticker").agg(F.min("prio").alias("prio"))
    return universe.join(j.join(best, ["ticker", "prio"]).drop("prio", *[x for x in universe.columns if x != "ticker"]), "ticker", "left")
