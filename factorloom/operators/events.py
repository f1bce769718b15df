"""Aggregates over transactions, filings, estimates and articles, one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import consensus
from ..functions.common import ratio
from ..views import count_when


def newest_n(df: DataFrame, keys: list[str], order: list, n: int, name: str = "rn") -> DataFrame:
    """Newest n rows per key; Spark keeps only n rows per key and partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def pivot_newest(df: DataFrame, key: str, order: list, value: str, n: int, extra: str | None = None) -> DataFrame:
    """(key, e0 .. e{n-1}, k): the n newest values side by side, and how many there are."""
    top = newest_n(df, [key], order, n)
    aggs = [F.max(F.when(F.col("rn") == i + 1, F.col(value))).alias(f"e{i}") for i in range(n)]
    if extra:
        aggs.append(F.max(F.when(F.col("rn") == 1, F.col(extra))).alias(extra))
    return top.groupBy(key).agg(*aggs, F.count(F.lit(1)).alias("k"))


def estimate_revision(estimates: DataFrame, key: str = "pid") -> DataFrame:
    """Newest against third-newest estimate, with the newest analyst count."""
    p = pivot_newest(estimates, key, [F.desc("yr")], "est", 4, "n")
    base = F.abs(F.col("e2"))
    pct = F.when((F.col("k") >= 3) & (base >= 1e-6), (F.col("e0") - F.col("e2")) / base)
    return p.withColumn("revision_pct", pct)


def estimate_velocity(estimates: DataFrame, key: str = "pid") -> DataFrame:
    p = pivot_newest(estimates, key, [F.desc("yr")], "est", 4, "n")
    return p.withColumn("revision_velocity", F.when(F.col("k") >= 4, consensus.revision_velocity("e0", "e1", "e2", "e3", "n")))


def earnings_surprise(reports: DataFrame, key: str, as_of) -> DataFrame:
    """Newest past report with both figures: surprise percent and days since."""
    ok = reports.where(
        F.col("eps_actual").isNotNull() & F.col("eps_est").isNotNull() & (F.abs("eps_est") > 1e-6) & (F.col("d") <= F.lit(as_of))
    )
    top = newest_n(ok, [key], [F.desc("d")], 1)
    return top.select(
        key, ((F.col("eps_actual") - F.col("eps_est")) / F.abs("eps_est")).alias("surprise_pct"),
        F.datediff(F.lit(as_of), "d").alias("days_since"),
    )


def npr_spike(tx: DataFrame, key: str = "pid", baseline: int = 4) -> DataFrame:
    """Net-purchase ratio of the newest quarter against the mean of the quarters before it that had trades."""
    q = (
        tx.where(F.col("code").isin("P", "S")).groupBy(key, F.to_date(F.date_trunc("quarter", "d")).alias("q"))
        .agg(count_when(F.col("code") == "P").alias("acq"), count_when(F.col("code") == "S").alias("disp"))
    )
    w = Window.partitionBy(key).orderBy(F.desc("q"))
    npr = ratio("acq", F.col("acq") + F.col("disp"))
    r = q.withColumn("npr", npr).withColumns({
        "rn": F.row_number().over(w),
        "base": F.avg("npr").over(w.rowsBetween(1, baseline)),
    }).where("rn = 1")
    return r.select(key, "q", "npr", (F.col("npr") - F.coalesce("base", "npr")).alias("spike"), "acq", "disp")


def congress_summary(tx: DataFrame, key: str, lookback: int) -> DataFrame:
    """Purchases, sales, net, recency and sorted distinct members per key.

    Rows are first reduced to (key, member, type): the member list is bounded by the chamber's size.
    """
    kind = F.lower("type")
    side = F.when(kind.contains("purchase") | kind.contains("buy"), "P").when(kind.contains("sale") | kind.contains("sold") | kind.contains("sell"), "S")
    per = (
        tx.where(F.col("age") <= lookback).withColumn("side", side).where("side IS NOT NULL")
        .groupBy(key, "member", "side").agg(F.count(F.lit(1)).alias("k"), F.min("age").alias("age"))
    )
    s = per.groupBy(key).agg(
        F.sum(F.when(F.col("side") == "P", F.col("k")).otherwise(0)).alias("purchases"),
        F.sum(F.when(F.col("side") == "S", F.col("k")).otherwise(0)).alias("sales"),
        F.min("age").alias("recency_days"), F.array_sort(F.collect_set("member")).alias("members"),
    )
    return s.withColumn("net", F.col("purchases") - F.col("sales"))


def ttm_pair(statements: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Trailing and prior sums of each field from eight clean quarters, else from two annual rows.

    Quarters count only with all fields present, and only when each of the seven gaps is a quarter long.
    """
    valid = statements
    for f in ["filing_date", *fields]:
        valid = valid.where(F.col(f).isNotNull())
    w = Window.partitionBy(key).orderBy(F.desc("d"))
    top = valid.withColumn("rn", F.row_number().over(w)).withColumn("gap", F.datediff(F.lag("d").over(w), "d")).where("rn <= 8")

    def span(lo, hi, f):
        return F.sum(F.when(F.col("rn").between(lo, hi), F.col(f)))

    quarterly = top.groupBy(key).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(F.when((F.col("rn") > 1) & F.col("gap").between(70, 110), 1).otherwise(0)).alias("good_gaps"),
        *[span(1, 4, f).alias(f"q_now_{f}") for f in fields], *[span(5, 8, f).alias(f"q_prior_{f}") for f in fields],
    )
    years = valid.groupBy(key, F.year("d").alias("yr")).agg(*[F.sum(f).alias(f) for f in fields])
    annual = newest_n(years, [key], [F.desc("yr")], 2).groupBy(key).agg(
        *[F.max(F.when(F.col("rn") == 1, F.col(f))).alias(f"a_now_{f}") for f in fields],
        *[F.max(F.when(F.col("rn") == 2, F.col(f))).alias(f"a_prior_{f}") for f in fields],
    )
    both = quarterly.join(annual, key, "full")
    clean = (F.col("k") == 8) & (F.col("good_gaps") == 7)
    return both.withColumn("clean", F.coalesce(clean, F.lit(False)))


def news_sentiment(articles: DataFrame, key: str = "uid", half_life: float = 5.0) -> DataFrame:
    """Half-life weighted sentiment in [0, 1]; without a directional article the score is 0."""
    per = articles.groupBy(key, "age", "sentiment").agg(F.count(F.lit(1)).alias("k"))
    w = F.exp(-F.greatest(F.col("age"), F.lit(0)) * F.log(F.lit(2.0)) / half_life) * F.col("k")
    v = F.when(F.col("sentiment") == "Positive", 1.0).when(F.col("sentiment") == "Negative", -1.0).otherwise(0.0)
    s = per.groupBy(key).agg(
        F.sum(v * w).alias("vw"), F.sum(w).alias("ww"), F.max((v != 0).cast("int")).alias("directional"),
        F.sum(F.when(F.col("age") <= 7, F.col("k")).otherwise(0)).alias("n_recent"), F.sum("k").alias("n_articles"),
    )
    return s.withColumn("sentiment", F.when(F.col("directional") == 1, (ratio("vw", "ww") + 1.0) / 2.0).otherwise(0.0))
