"""Scores from insider, congress and institutional data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_double, clip, col, log_saturation, lookup, ratio, recency_decay, unit, zero_if_null


def ceo_multiplier(ceo_usd, cap, pay=None) -> Column:
    """Bonus for a chief executive's own purchase, in basis points of the market cap."""
    usd, c = col(ceo_usd), col(cap)
    bps = F.when(c > 0, usd / c * 10000)
    top = F.lit(1.15)
    if pay is not None:
        top = F.when(usd < 0.5 * col(pay), 1.10).otherwise(1.15)
    no_cap = F.when(usd >= 50000, 1.10).otherwise(1.0)
    return (
        F.when((usd <= 0) | usd.isNull(), 1.0)
        .when(bps < 0.5, 1.0).when(bps < 1.0, 1.05).when(bps < 5.0, 1.10)
        .when(bps.isNotNull(), top).otherwise(no_cap)
    )


def conviction(usd, cap, age_days, ceo_usd=None, pay=None) -> Column:
    """Log-scaled purchases per market cap, lifted by the CEO, faded with age; no purchase is 0."""
    u, c = col(usd), col(cap)
    share = F.when((u > 0) & (c > 0), u / c)
    base = 0.30 + 0.60 * log_saturation(share * 10000, 100)
    if ceo_usd is not None:
        mult = ceo_multiplier(ceo_usd, cap, pay)
        base = F.when(mult > 1.0, F.least(F.lit(0.95), base * mult)).otherwise(base)
    faded = recency_decay(base, F.coalesce(col(age_days), F.lit(0)))
    return F.when(share.isNotNull(), faded).otherwise(0.0)


def insider_value(usd, cap, age_days) -> Column:
    """Older form of conviction without the CEO lift."""
    return conviction(usd, cap, age_days)


def breadth(buyers, sellers, buy_age_days) -> Column:
    """Share of distinct buyers among distinct traders, scaled by how many traded."""
    total = col(buyers) + col(sellers)
    base = 0.7 * ratio(buyers, total) + 0.3 * log_saturation(as_double(total), 10)
    faded = F.when(col(buy_age_days).isNotNull(), recency_decay(base, buy_age_days)).otherwise(base)
    return F.when(total > 0, faded).otherwise(0.0)


def residual(breadth_score, conviction_score, r: float = 0.547) -> Column:
    return unit(col(breadth_score) - r * col(conviction_score))


def insider_alpha(conv, residual_breadth, n30, n31_180, csuite_usd, total_usd) -> Column:
    """Conviction, breadth and purchase velocity with a C-suite tilt."""
    late = zero_if_null(n31_180)
    base = F.greatest(F.lit(1.0), late * 30.0 / 150.0)
    velocity = log_saturation(zero_if_null(n30) / base, 5)
    total = zero_if_null(total_usd)
    tilt = F.when(
        total > 0,
        F.least(F.lit(1.0), 0.5 + 0.5 * F.try_divide(F.greatest(F.lit(0.0), zero_if_null(csuite_usd)), total)),
    ).otherwise(0.5)
    raw = 0.55 * zero_if_null(conv) + 0.30 * zero_if_null(residual_breadth) + 0.15 * (0.6 * velocity + 0.4 * tilt)
    return F.when(zero_if_null(n30) + late > 0, unit(raw)).otherwise(0.0)


def log_scale_by_tier(usd, cap, tier, ceilings: dict) -> Column:
    """ln(1+usd/cap) against the tier's ceiling; unusable input is missing."""
    top = lookup(ceilings, tier)
    ok = (col(usd) > 0) & (col(cap) > 0)
    return F.when(ok & top.isNotNull(), F.least(F.log1p(col(usd) / F.nullif(col(cap), F.lit(0.0))) / F.log1p(top), F.lit(1.0)))


def filing_count(n) -> Column:
    x = as_double(n)
    return F.when(x > 0, F.least(F.lit(0.90), F.log1p(x) / F.log1p(F.lit(200.0)))).otherwise(0.0)


def congress(purchases, sales, age_days) -> Column:
    """Net buying, faded with age; traded nothing is 0.5, no record at all is 0."""
    p, s = as_double(purchases), as_double(sales)
    base = ((p - s) / (p + s + 1.0) + 1.0) / 2.0
    faded = F.when(col(age_days).isNotNull(), recency_decay(base, age_days)).otherwise(base)
    return F.when(p.isNull(), 0.0).when(p + s == 0, 0.5).otherwise(faded)


def congress_surge(n30, n180) -> Column:
    surge = zero_if_null(n30) / F.greatest(F.lit(1.0), zero_if_null(n180) * 30.0 / 180.0)
    return F.when(surge > 1.0, 1.0 + 0.25 * F.least(F.lit(1.0), (surge - 1.0) / 2.0)).otherwise(1.0)


def _net_positions(inc, red) -> Column:
    i, r = zero_if_null(inc), zero_if_null(red)
    return (i - r) / F.greatest(F.lit(1.0), i + r)


def flow_13f(holders, holders_change, inc, red, own_change) -> Column:
    """Quarter-on-quarter institutional flow around 0.5; no summary row stays missing."""
    ih = zero_if_null(holders)
    change = F.coalesce(clip(10.0 * F.try_divide(zero_if_null(holders_change), ih), -1.0, 1.0), F.lit(0.0))
    score = (
        0.5 + 0.2 * F.when(ih > 0, change).otherwise(0.0) + 0.2 * _net_positions(inc, red)
        + 0.1 * clip(zero_if_null(own_change), -5.0, 5.0) / 5.0
    )
    return F.when(col(holders).isNotNull(), unit(score))


def concentration_13f(own_pct, holders, inc, red) -> Column:
    own = 0.4 * clip(zero_if_null(own_pct), 0.0, 80.0) / 80.0
    many = 0.3 * log_saturation(F.greatest(F.lit(0.0), zero_if_null(holders)), 500)
    net = 0.3 * (0.5 + 0.5 * _net_positions(inc, red))
    return F.when(col(holders).isNotNull(), unit(own + many + net))


def dividend_sustain(dividend_yield, payout, fcf, paid) -> Column:
    """Non-payers are 0; a payer with incomplete data stays missing."""
    y, po, f, d = (as_double(x) for x in (dividend_yield, payout, fcf, paid))
    cash = F.abs(zero_if_null(d))
    nothing_known = y.isNull() & po.isNull() & f.isNull() & d.isNull()
    non_payer = (zero_if_null(y) <= 0) & (cash <= 0)
    incomplete = y.isNull() | po.isNull() | f.isNull() | d.isNull() | (cash <= 0)
    score = (
        0.45 * (1.0 - unit(F.abs(po - 0.45) / 0.55))
        + 0.35 * clip(F.try_divide(f, cash) - 1.0, 0.0, 2.0) / 2.0
        + 0.20 * clip(y, 0.0, 0.08) / 0.08
    )
    return F.when(nothing_known, None).when(non_payer, 0.0).when(incomplete, None).otherwise(unit(score))


def whale_signal(flow, npr_spike) -> Column:
    return (zero_if_null(flow) >= 0.80) | (zero_if_null(npr_spike) >= 0.30)
