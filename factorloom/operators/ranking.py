"""Top-k, caps, rotation and bucket lists. Order is always score descending, then ticker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def order_by_score(score: str = "final_score") -> list:
    return [F.desc(score), F.asc("ticker")]


def top_per(df: DataFrame, keys: list[str], n: int, score: str = "final_score", name: str = "pos") -> DataFrame:
    """Top n per key; the rank filter runs before the shuffle too, so a hot key ships n rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order_by_score(score))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def top_overall(df: DataFrame, n: int, score: str = "final_score", name: str = "pos") -> DataFrame:
    """Top n of everything: sort-limit first (n rows per task), positions on the n survivors."""
    best = df.orderBy(*order_by_score(score)).limit(n)
    return best.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order_by_score(score))))


def list_buckets(entries: DataFrame, n: int = 20) -> DataFrame:
    """The published lists as one long table: bucket, pos and the entry columns."""
    markets = top_per(entries, ["market"], n).withColumn("bucket", F.concat(F.lit("top_buys_"), F.lower("market")))
    us = entries.where("market = 'USA' AND cap_tier IN ('mid', 'small')")
    tiers = top_per(us, ["cap_tier"], n).withColumn("bucket", F.concat("cap_tier", F.lit("_caps")))
    overall = top_overall(entries, n).withColumn("bucket", F.lit("top_buys"))
    return reduce(DataFrame.unionByName, [overall, markets, tiers])


def sector_cap(df: DataFrame, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Flag the n best per sector (within keys) as primary, the rest as overflow.

    The rows handed in are a published list, so a sector holds no more rows than the list does.
    """
    w = Window.partitionBy(*keys, "sector").orderBy(*order_by_score())
    return df.withColumn("slot", F.when(F.row_number().over(w) <= n, "primary").otherwise("overflow"))


def cooled_top_n(entries: DataFrame, state: DataFrame, n: int, max_tenure: int, keys: list[str], exempt: Column | None = None) -> DataFrame:
    """Top n per key skipping over-tenured names; rows carry action selected / cooldown and `added`.

    A cooled name is an event only when it ranks before the n-th selected one, so per key at most
    n eligible and the cooled rows ahead of them matter.
    """
    j = entries.join(state, "ticker", "left").withColumn("tenure", F.coalesce("tenure", F.lit(0)))
    if exempt is not None:
        j = j.withColumn("tenure", F.when(exempt, 0).otherwise(F.col("tenure")))
    cooled = F.col("tenure") >= max_tenure
    picked = top_per(j.where(~cooled), keys, n).withColumn("action", F.lit("selected"))
    here = F.struct((-F.col("final_score")).alias("s"), F.col("ticker").alias("t"))
    ends = picked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.max(here).alias("_last"))
    out = j.where(cooled).join(ends, keys, "left")
    ahead = F.coalesce((F.col("_k") < n) | (here < F.col("_last")), F.lit(True))
    events = out.where(ahead).drop("_k", "_last").withColumns({"action": F.lit("cooldown"), "pos": F.lit(None).cast("int")})
    both = picked.unionByName(events.select(*picked.columns))
    return both.withColumn("added", (F.col("action") == "selected") & (F.col("tenure") == 0))


def update_tenure(state: DataFrame, rotation: DataFrame) -> DataFrame:
    """Selected names gain a run, cooled ones restart at 0, all others drop out."""
    moves = rotation.select("ticker", "action").distinct()
    j = state.join(moves, "ticker", "full")
    new = F.when(F.col("action") == "cooldown", 0).when(F.col("action") == "selected", F.coalesce("tenure", F.lit(0)) + 1)
    return j.where("action IS NOT NULL").select("ticker", new.alias("tenure"))


def round_robin(df: DataFrame, group: str, cap: int) -> DataFrame:
    """Take one name per group in turn, groups and names in order, up to cap names."""
    w = Window.partitionBy(group).orderBy("ticker")
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).orderBy("rn", group).limit(cap)


def first_bucket_wins(lists: DataFrame, priority: list[str]) -> DataFrame:
    """One row per ticker, from the first bucket in priority order that holds it."""
    p = F.array_position(F.array(*[F.lit(b) for b in priority]), F.col("bucket"))
    w = Window.partitionBy("ticker").orderBy("prio", "pos")
    return lists.withColumn("prio", p).where("prio > 0").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "prio")


def overlap(df: DataFrame, a: str, b: str, n: int, keys: list[str]) -> DataFrame:
    """Share of names in both top-n lists per key; null below n rows."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ta = top_per(both, keys, n, a, "pa").select(*keys, "ticker")
    tb = top_per(both, keys, n, b, "pb").select(*keys, "ticker")
    hits = ta.join(tb, [*keys, "ticker"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
    size = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return size.join(hits, keys, "left").withColumn("overlap", F.when(F.col("n_rows") >= n, F.coalesce("hits", F.lit(0)) / n))
