"""Volatility regime, gates and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col


def badge(score) -> Column:
    return F.when(col(score) >= 0.80, "HIGH BUY").when(col(score) >= 0.60, "TACTICAL BUY").otherwise("WATCHLIST")


def cap_tier(cap) -> Column:
    c = col(cap)
    return F.when(c >= 10e9, "large").when(c >= 2e9, "mid").otherwise("small")


def cap_tier_guarded(cap, current) -> Column:
    """Keep the current tier where the cap is implausibly low."""
    return F.when(F.coalesce(col(cap), F.lit(0.0)) <= 500e6, col(current)).otherwise(cap_tier(cap))


def cap_bracket(cap) -> Column:
    """Sizing bracket; anything under $300 M has none."""
    c = col(cap)
    return F.when(c > 10e9, "large").when(c >= 2e9, "mid").when(c >= 300e6, "small")


def vol_multiplier(vix) -> Column:
    v = col(vix)
    return F.when(v >= 40, 0.20).when(v >= 30, 0.50).when(v >= 20, 0.80).when(v >= 0, 1.0).otherwise(1.0)


def regime(vix) -> Column:
    v = col(vix)
    return (
        F.when(v.isNull() | F.isnan(v.cast("double")) | (v < 0), "UNKNOWN")
        .when(v >= 30, "CAPITULATION").when(v >= 20, "BEAR").otherwise("NORMAL")
    )


def regime_multiplier(vix) -> Column:
    r = regime(vix)
    return F.when(r == "CAPITULATION", 0.50).when(r == "BEAR", 0.80).when(r == "NORMAL", 1.0)


def sizing_regime(vix) -> Column:
    v = col(vix)
    return F.when(v >= 30, "panic").when(v >= 20, "bear").otherwise("normal")


def strategy_label(vix) -> Column:
    r = regime(vix)
    return (
        F.when(r == "CAPITULATION", "CAPITULATION DISTRESSED REGIME / HIGH-QUALITY ANCHORS ONLY")
        .when(r == "BEAR", "DEFENSIVE / GRADUATED POSITIONING ACTIVATED")
        .when(r == "NORMAL", "NORMAL / FULL POSITIONING")
    )


def market_state(vix, index_ret, tech_ret) -> Column:
    """Ladder from volatility and the three-month returns of two indices."""
    v, a = col(vix), col(index_ret)
    b = F.coalesce(col(tech_ret), a)
    return (
        F.when(v.isNull() | (v < 0), "NEUTRAL")
        .when(v >= 30, "CAPITULATION")
        .when(a.isNull(), F.when(v >= 20, "BEAR").otherwise("NEUTRAL"))
        .when((v < 14) & (a >= 0.08) & (b >= 0.08), "EUPHORIA")
        .when((v >= 20) | (a <= -0.05), "BEAR")
        .when(a >= 0.02, "BULL")
        .otherwise("NEUTRAL")
    )


def quality_gate(points, missing_multiplier: float = 0.375) -> Column:
    p = col(points)
    return F.when(p.isNull(), missing_multiplier).when(p < 3, 0.0).when(p < 6, 0.6).otherwise(1.0)


def survives_capitulation(beta, debt_to_equity, quality) -> Column:
    """Low beta, and either little debt or high quality."""
    calm = F.coalesce(col(beta) <= 1.2, F.lit(True))
    sound = F.coalesce(col(debt_to_equity) <= 0.30, F.lit(False)) | (F.coalesce(col(quality), F.lit(0.0)) >= 0.70)
    return calm & sound


def is_extended(return_5d, tier) -> Column:
    limit = F.when(F.lower(F.trim(F.coalesce(col(tier), F.lit("large")))).isin("small", "mid"), 0.18).otherwise(0.10)
    return F.coalesce(col(return_5d) >= limit, F.lit(False))


def target_passed(target, price) -> Column:
    return F.coalesce((col(target) > 0) & (col(price) > 0) & (col(target) < col(price)), F.lit(False))


def catalyst_stale(surprise_pct, days) -> Column:
    return F.coalesce((col(surprise_pct) > 0) & (col(days) > 60), F.lit(False))
