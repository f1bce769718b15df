"""Position sizing over (date, pool) groups of at most a few dozen names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TARGET_VOL
from ..functions.common import lookup, ratio
from ..functions.regime import sizing_regime
from .distribution import attach

MAX_POSITION = 0.10
MAX_SECTOR = 0.30


def _over(keys: list[str]):
    return Window.partitionBy(*keys)


def equal_anchors(df: DataFrame, keys: list[str], floor: float = 10e9) -> DataFrame:
    """Equal weight for every name above the cap floor; the count is a grouped aggregate joined back."""
    large = df.where(F.col("market_cap") > floor)
    n = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return attach(large, n, keys, "inner").withColumn("weight", 1.0 / F.col("n"))


def score_proportional(df: DataFrame, keys: list[str], score: str = "final_score", cap: float = MAX_POSITION) -> DataFrame:
    """Share of the positive scores, clipped at the position limit and renormalised; no score means equal."""
    w = _over(keys)
    x = F.greatest(F.lit(0.0), F.coalesce(F.col(score), F.lit(0.0)))
    raw = df.withColumns({"_x": x, "_t": F.sum(x).over(w), "_n": F.count(F.lit(1)).over(w)})
    clipped = raw.withColumn("_c", F.least(F.lit(cap), F.try_divide(F.col("_x"), F.col("_t"))))
    out = F.when(F.col("_t") <= 0, 1.0 / F.col("_n")).otherwise(F.try_divide(F.col("_c"), F.sum("_c").over(w)))
    return clipped.withColumn("weight", out).drop("_x", "_t", "_n", "_c")


def inverse_vol(variances: DataFrame, keys: list[str], var: str = "cov") -> DataFrame:
    inv = 1.0 / F.greatest(F.lit(1e-8), F.sqrt(F.col(var)))
    return variances.withColumn("weight", inv / F.sum(inv).over(_over(keys)))


def cap_sectors(df: DataFrame, keys: list[str], weight: str = "weight", cap: float = MAX_SECTOR) -> DataFrame:
    """Scale a sector down proportionally where it exceeds the cap."""
    total = F.sum(weight).over(_over([*keys, "sector"]))
    return df.withColumn(weight, F.when(total > cap + 1e-8, F.col(weight) * cap / total).otherwise(F.col(weight)))


def adv_ceiling(adv, book, ceiling: float, share: float = 0.03) -> Column:
    """Position ceiling from 3 % of dollar volume over the book; unknown volume keeps the ceiling."""
    a, b = F.col(adv), book
    ok = (a > 0) & (b > 0)
    return F.when(ok, F.least(F.lit(ceiling), share * a / b)).otherwise(F.lit(ceiling))


def cap_liquidity(df: DataFrame, keys: list[str], book: Column, ceiling: float = MAX_POSITION, weight: str = "weight") -> DataFrame:
    capped = F.when(F.col("adv") > 0, F.least(F.col(weight), adv_ceiling("adv", book, ceiling))).otherwise(F.col(weight))
    c = df.withColumn("_w", capped)
    total = F.sum("_w").over(_over(keys))
    return c.withColumn(weight, F.when(total > 1e-8, F.col("_w") / total).otherwise(F.col("_w"))).drop("_w")


def portfolio_vol(weights: DataFrame, cov: DataFrame, keys: list[str]) -> DataFrame:
    """sqrt(w'Cw) per group, from the long covariance and the weights joined once per side."""
    i = weights.select(*keys, F.col("slot").alias("i"), F.col("weight").alias("wi"))
    j = weights.select(*keys, F.col("slot").alias("j"), F.col("weight").alias("wj"))
    x = i.join(cov, [k for k in [*keys, "i"] if k in cov.columns or k == "i"]).join(j, [*keys, "j"])
    return x.groupBy(*keys).agg(F.sqrt(F.sum(F.col("wi") * F.col("wj") * F.col("cov")) + 1e-10).alias("vol"))


def target_volatility(weights: DataFrame, vol: DataFrame, keys: list[str], vix: str = "vix") -> DataFrame:
    """Scale down to the regime's volatility target; never up."""
    target = lookup(TARGET_VOL, sizing_regime(vix))
    j = weights.join(vol, keys, "left")
    scale = F.when(F.col("vol") > 1e-8, F.least(F.lit(1.0), ratio(target, "vol"))).otherwise(1.0)
    return j.withColumn("weight", F.col("weight") * scale)
