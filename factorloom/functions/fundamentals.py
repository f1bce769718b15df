"""Scores from ratios and statements."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import band_score, clip, col, num, unit


def _flag(condition) -> Column:
    return F.when(condition, 1).otherwise(0)


def derived_roa(roa, margin, turnover) -> Column:
    """Return on assets, else margin x turnover."""
    return F.coalesce(num(roa), num(margin) * num(turnover))


def quality_points(roa, opm, de, cr, gpm, npm, turnover=None) -> Column:
    """Eight pass/fail points; missing inputs simply earn nothing."""
    r = derived_roa(roa, npm, turnover) if turnover is not None else num(roa)
    d = num(de)
    tests = [
        r > 0, r > 0.05, num(opm) > 0, (d >= 0) & (d < 1.0), (d >= 0) & (d < 0.5),
        num(cr) > 1.5, num(gpm) > 0.30, num(npm) > 0.05,
    ]
    return reduce(add, [_flag(t) for t in tests])


def quality_score(points) -> Column:
    return col(points) / 8.0


def fcf_yield(fcf, ev) -> Column:
    f, e = num(fcf), num(ev)
    return F.when((f > 0) & (e > 0), clip(f / e, 0.0, 0.20) / 0.20).otherwise(0.0)


def pb_value(bvps, price) -> Column:
    b, p = num(bvps), num(price)
    pb = F.when((b > 0) & (p > 0), p / b)
    bonus = F.when(pb < 1.0, 0.10).otherwise(0.0)
    score = F.least(F.lit(1.0), 1.0 - (clip(pb, 0.5, 3.0) - 0.5) / 2.5 + bonus)
    return F.when(pb.isNotNull(), score).otherwise(0.0)


def roic_quality(roe, roce=None) -> Column:
    e = num(roe)
    blend = e
    if roce is not None:
        c = num(roce)
        blend = F.when(c > 0, (e + c) / 2.0).otherwise(e)
    return F.when(e > 0, clip(blend, 0.0, 0.50) / 0.50).otherwise(0.0)


def dupont_quality(roa, npm, turnover, de) -> Column:
    """Weighted profitability and leverage parts, renormalised over the parts present."""
    r, m, d = derived_roa(roa, npm, turnover), num(npm), num(de)
    # The ladder reads top down, so a negative ratio misses the first rung and lands on the second.
    leverage = (
        F.when((d >= 0) & (d < 0.5), 1.0)
        .when(d < 1.0, 0.6)
        .when(d < 2.0, 0.2)
        .when(d.isNotNull(), 0.0)
    )
    parts = [
        (0.5, (clip(r, -0.10, 0.20) + 0.10) / 0.30),
        (0.3, (clip(m, -0.10, 0.25) + 0.10) / 0.35),
        (0.2, leverage),
    ]
    total = reduce(add, [F.when(c.isNotNull(), w).otherwise(0.0) for w, c in parts])
    score = reduce(add, [F.coalesce(w * c, F.lit(0.0)) for w, c in parts])
    return F.coalesce(unit(F.try_divide(score, total)), F.lit(0.0))


def margin_expansion(now, prior) -> Column:
    return 0.5 + clip(col(now) - col(prior), -0.10, 0.10) / 0.20


def growth_score(now, prior, band: float) -> Column:
    """Signed growth on a positive base only."""
    n, p = num(now), num(prior)
    return F.when(p > 0, 0.5 + clip(n / p - 1.0, -band, band) / (2.0 * band))


def earnings_yield(ni, cap) -> Column:
    n, c = num(ni), num(cap)
    return F.when((n > 0) & (c > 0), clip(n / c, 0.0, 0.15) / 0.15).otherwise(0.0)


def ev_ebitda(ev, ebitda) -> Column:
    v, e = num(ev), num(ebitda)
    return F.when((v > 0) & (e > 0), 1.0 - (clip(v / e, 5.0, 35.0) - 5.0) / 30.0).otherwise(0.0)


def accruals(ni, cfo, assets) -> Column:
    a = num(assets)
    return F.coalesce(F.when(a > 0, 1.0 - band_score((num(ni) - num(cfo)) / a, 0.20)), F.lit(0.0))


def relative_value(pe, sector_pe) -> Column:
    p, s = num(pe), num(sector_pe)
    return F.when((p > 0) & (s > 0), 1.0 - (clip(p / s, 0.5, 2.0) - 0.5) / 1.5).otherwise(0.0)
