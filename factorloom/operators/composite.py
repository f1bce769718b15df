"""Weighting and composite scores on long (name, factor, score) rows."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import REGION_MARKET, market_mask, pillar_table
from ..functions import regime
from ..functions.common import ratio
from .xs import neutralise


def per_name(keys=("ticker",)):
    """One name's factors: as many rows as there are factors."""
    return Window.partitionBy(*keys)


def renormalise_available(long: DataFrame, weight: str = "weight", score: str = "score", key: str = "ticker") -> DataFrame:
    """Spread the weight of missing factors over the present ones; nothing present means uniform."""
    w = per_name((key,))
    avail = F.when(F.col(score).isNotNull(), F.col(weight)).otherwise(0.0)
    total = F.sum(avail).over(w)
    even = 1.0 / F.count(F.lit(1)).over(w)
    return long.withColumn("eff_weight", F.when(total <= 1e-9, even).otherwise(F.try_divide(avail, total)))


def redistribute_dead(long: DataFrame, weights: DataFrame, score: str = "norm") -> DataFrame:
    """(factor, weight, eff_weight): a factor that is zero for the whole universe gives its weight to the live ones.

    Runs on one row per factor; the rounding residue goes to the largest live weight.
    """
    live = long.groupBy("factor").agg((F.max(F.abs(F.coalesce(F.col(score), F.lit(0.0)))) > 0).alias("live"))
    j = weights.join(live, "factor", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    whole = Window.partitionBy(F.lit(0))
    lw = F.when(F.col("live"), F.col("weight")).otherwise(0.0)
    j = j.withColumns({"lt": F.sum(lw).over(whole), "all_w": F.sum("weight").over(whole)})
    grown = F.round(lw + (F.col("all_w") - F.col("lt")) * F.try_divide(lw, F.col("lt")), 6)
    j = j.withColumn("g", F.when(F.col("lt") <= 0, F.col("weight")).otherwise(grown))
    first = F.row_number().over(whole.orderBy(F.desc("g"), "factor"))
    j = j.withColumns({"rest": 1.0 - F.sum("g").over(whole), "pick": first})
    return j.select("factor", "weight", "live", F.when(F.col("pick") == 1, F.col("g") + F.col("rest")).otherwise(F.col("g")).alias("eff_weight"))


def market_weights(weights: DataFrame, mask: DataFrame) -> DataFrame:
    """(market, factor, weight): zero outside the market's mask, renormalised inside it."""
    markets = mask.select("market").distinct()
    grid = weights.withColumn("market", F.explode(F.array(*[F.lit(m) for m in REGION_MARKET.values()]))).join(markets, "market", "left_semi")
    inside = mask.withColumn("inside", F.lit(True))
    j = grid.join(inside, ["market", "factor"], "left")
    w = F.when(F.coalesce("inside", F.lit(False)), F.col("weight")).otherwise(0.0)
    return j.withColumn("weight", F.try_divide(w, F.sum(w).over(Window.partitionBy("market")))).select("market", "factor", "weight")


def weighted_mean(long: DataFrame, keys: list[str], score: str, weight: str = "weight") -> DataFrame:
    """Weighted mean over present scores, with the share of weight that was present."""
    w = F.when(F.col(score).isNotNull(), F.col(weight)).otherwise(0.0)
    out = long.groupBy(*keys).agg(F.sum(F.col(score) * F.col(weight)).alias("_ws"), F.sum(w).alias("_w"), F.sum(weight).alias("_all"))
    return out.select(
        *keys, ratio("_ws", "_w").alias("composite"), ratio("_w", "_all").alias("coverage"),
    )


def monitored(long: DataFrame, weights: DataFrame, value: str = "neutral", low: float = 0.5) -> DataFrame:
    m = weighted_mean(long.join(weights, "factor"), ["ticker", "market"], value)
    return m.withColumns({"composite": F.coalesce("composite", F.lit(0.0)), "low_coverage": F.col("coverage") < low})


def coverage_penalised(long: DataFrame, weights: DataFrame, full: float = 0.70, low: float = 0.40) -> DataFrame:
    """Mean score scaled down below 70 % weight coverage; ordered by the result."""
    m = weighted_mean(long.join(weights, "factor"), ["ticker"], "score")
    raw = F.coalesce("composite", F.lit(0.0))
    return m.select(
        "ticker", raw.alias("raw_composite"), "coverage",
        (raw * F.least(F.lit(1.0), F.col("coverage") / full)).alias("composite"), (F.col("coverage") < low).alias("low_coverage"),
    )


def traded(norm: DataFrame, weights: DataFrame, entries: DataFrame, vix: Column, momentum_multiplier: Column) -> DataFrame:
    """Traded composite: available weights x normalised factor, then regime, momentum state and quality gate."""
    long = renormalise_available(norm.join(weights, "factor"))
    raw = long.groupBy("ticker").agg(F.sum(F.col("eff_weight") * F.col("norm")).alias("raw_score"))
    j = raw.join(entries, "ticker")
    score = F.col("raw_score") * regime.vol_multiplier(vix) * momentum_multiplier * regime.quality_gate("quality_raw")
    return j.withColumn("final_score", score).withColumn("badge", regime.badge(F.round("final_score", 6)))


def pillar_scores(inputs: DataFrame, factors: list[str], surge_weight: float = 0.5, surge_from: float = 0.80) -> DataFrame:
    """Three-pillar score with null reweighting inside and across pillars.

    inputs: ticker, market, region, sector, cap_tier, quality_raw and the factor columns.
    """
    ids = ["ticker", "market", "region", "sector", "cap_tier", "quality_raw"]
    long = inputs.unpivot(ids, factors, "factor", "score")
    spec = pillar_table(inputs.sparkSession)
    rows = long.join(F.broadcast(spec), ["region", "factor"])  # 27 literal rows
    neutral = neutralise(rows, zero_is_dead=F.col("zero_is_dead"))
    has = F.col("neutral").isNotNull()
    p = neutral.groupBy("ticker", "market", "region", "quality_raw", "pillar", "pillar_weight").agg(
        ratio(F.sum(F.col("neutral") * F.col("weight")), F.sum(F.when(has, F.col("weight")))).alias("value"),
        F.sum(F.when(has, F.col("weight")).otherwise(0.0)).alias("present"),
    )
    part = {k: F.max(F.when(F.col("pillar") == k, F.col("value"))).alias(k) for k in ("fundamental", "consensus", "alternative")}
    s = p.groupBy("ticker", "market", "region", "quality_raw").agg(
        *part.values(), F.sum("present").alias("coverage"),
        ratio(F.sum(F.col("pillar_weight") * F.col("value")), F.sum(F.when(F.col("value").isNotNull(), F.col("pillar_weight")))).alias("base"),
    )
    surge = surge_weight * F.greatest(F.lit(0.0), F.col("alternative") - surge_from) * F.greatest(F.lit(0.0), F.col("fundamental") - 0.5)
    lifted = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("base") + surge))
    known = F.col("alternative").isNotNull() & F.col("fundamental").isNotNull()
    final = F.when((F.col("region") == "US") & known, lifted).otherwise(F.col("base"))
    return s.withColumns({
        "final_score": final * regime.quality_gate("quality_raw"),
        "low_coverage": (F.col("coverage") < 0.5) | F.col("base").isNull(),
    })


def contributions(long: DataFrame, weights: DataFrame) -> DataFrame:
    """(ticker, factor, score, contribution, unavailable) for every positively weighted factor."""
    j = long.join(weights, "factor").where(F.col("weight") > 0)
    return j.withColumns({
        "contribution": F.col("weight") * F.coalesce("score", F.lit(0.0)), "unavailable": F.col("score").isNull(),
    })


def wide_sum(columns: dict[str, float]) -> Column:
    """Fixed weighted sum over wide columns, missing read as 0."""
    return reduce(add, [F.coalesce(F.col(f), F.lit(0.0)) * w for f, w in columns.items()])


__all__ = ["market_mask"]
