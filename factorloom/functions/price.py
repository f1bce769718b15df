"""Price, volume and exit-level expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import band_score, clip, col, num, ratio, unit


def momentum(ret_12_1, bench_ret=None) -> Column:
    """Excess 12-1 return clipped to +-60 %; no history is a dead signal (0)."""
    r = num(ret_12_1)
    excess = r - (num(bench_ret) if bench_ret is not None else F.lit(0.0))
    return F.coalesce(band_score(excess, 0.60), F.lit(0.0))


def volume_attention(spike) -> Column:
    """(spike - 1) / 4 in [0, 1]; flat or missing volume is 0."""
    return F.coalesce(unit((num(spike) - 1.0) / 4.0), F.lit(0.0))


def upside(target, price) -> Column:
    """Upside to a target, +-50 % onto [0, 1]; missing or zero input stays missing (signed)."""
    t, p = num(target), num(price)
    return F.when((t != 0) & (p != 0), band_score((t - p) / p, 0.50))


def dcf_upside(value, price) -> Column:
    v, p = num(value), num(price)
    return F.when((v > 0) & (p > 0), band_score((v - p) / p, 0.50))


def bench_regime(ret_12_1, ret_63) -> Column:
    """Benchmark state from its long and its three-month return."""
    r12, r63 = col(ret_12_1), col(ret_63)
    return (
        F.when(r63 < -0.20, "BEAR_CRASH")
        .when(r63 < -0.10, "BEAR_MOMENTUM")
        .when(r12 < -0.15, "BEAR_TREND")
        .when(r12 > 0.30, "BULL_STRONG")
        .otherwise("NORMAL")
    )


# Composite multiplier per benchmark state.
MOMENTUM_MULTIPLIER = {
    "BEAR_CRASH": 0.30, "BEAR_MOMENTUM": 0.55, "BEAR_TREND": 0.70, "BULL_STRONG": 0.95, "NORMAL": 1.00,
}


def stop_floor(price, atr, multiplier: float = 2.5) -> Column:
    return F.when(col(price) != 0, F.when(col(atr) != 0, col(price) - multiplier * col(atr)))


def target_signal(price, target, threshold: float = 0.05) -> Column:
    """struct(upside_pct, take_profit_alert)"""
    p, t = col(price), col(target)
    up = F.when((t > 0) & (p > 0), (t - p) / p)
    return F.struct(
        (up * 100).alias("upside_pct"),
        F.coalesce((up >= 0) & (up <= threshold), F.lit(False)).alias("take_profit_alert"),
    )


def breakout_target(price, target, atr, rsi, vwap_ratio) -> Column:
    """target + 1.5 ATR once price is through it on accumulation, else missing."""
    go = (col(target) != 0) & (col(price) > col(target)) & (col(rsi) > 50.0) & (col(vwap_ratio) > 1.0)
    return F.when(go, col(target) + 1.5 * F.coalesce(col(atr), F.lit(0.0)))


def exit_anchors(price, target, atr, rsi, vwap_ratio) -> Column:
    """One struct with floor, target signal and extension."""
    signal = target_signal(price, target)
    extended = breakout_target(price, target, atr, rsi, vwap_ratio)
    return F.struct(
        col(atr).alias("atr_14"),
        stop_floor(price, atr).alias("batch_floor"),
        signal["upside_pct"].alias("upside_pct"),
        signal["take_profit_alert"].alias("take_profit_alert"),
        extended.isNotNull().alias("breakout_extension"),
        extended.alias("extended_target"),
    )


def rsi_from_averages(avg_gain, avg_loss) -> Column:
    g, l = col(avg_gain), col(avg_loss)
    return (
        F.when((g == 0) & (l == 0), 50.0)
        .when(l == 0, 100.0)
        .otherwise(100.0 - 100.0 / (1.0 + F.try_divide(g, l)))
    )


def rsi_reversion(rsi) -> Column:
    """Overbought scores low, oversold scores high."""
    return 0.5 + (50.0 - col(rsi)) / 100.0


def adx_score(adx) -> Column:
    return F.coalesce(clip(adx, 0.0, 50.0) / 50.0, F.lit(0.0))


def illiquidity_shock(today, median) -> Column:
    """Price impact today against its recent median: below 1 is 0, 3 or more is 1."""
    shock = ratio(today, median)
    return F.when(shock >= 1.0, F.least(F.lit(1.0), (shock - 1.0) / 2.0)).otherwise(0.0)
