"""Scores from analyst estimates, ratings and surprises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_double, clip, col, lookup, ratio, unit

TINY_BASE = 1e-4


def revision(pct, n) -> Column:
    """Estimate revision damped towards 0.5 by coverage; under three analysts is missing."""
    damp = F.least(F.lit(1.0), as_double(n) / 10.0)
    return F.when(col(n) >= 3, 0.5 + clip(pct, -0.30, 0.30) / 0.60 * damp)


def revision_to_zero(pct, n) -> Column:
    """Older form: damped towards 0, missing reads 0."""
    damp = F.least(F.lit(1.0), as_double(n) / 10.0)
    return F.coalesce(F.when(col(n) >= 3, (clip(pct, -0.30, 0.30) + 0.30) / 0.60 * damp), F.lit(0.0))


def revenue_revision(current, prior, n) -> Column:
    base = F.abs(as_double(prior))
    pct = F.when(base >= TINY_BASE, (as_double(current) - as_double(prior)) / base)
    return revision(pct, n)


def revision_velocity(e0, e1, e2, e3, n) -> Column:
    """Change of the two-step revision between the newest and the previous estimate."""
    ok = (F.abs(col(e2)) >= TINY_BASE) & (F.abs(col(e3)) >= TINY_BASE)
    pace = F.when(ok, ratio(col(e0) - col(e2), F.abs(col(e2))) - ratio(col(e1) - col(e3), F.abs(col(e3))))
    damp = F.least(F.lit(1.0), F.coalesce(as_double(n), F.lit(0.0)) / 8.0)
    return 0.5 + clip(pace, -0.30, 0.30) / 0.60 * damp


def surprise_drift(pct, days) -> Column:
    """Post-earnings drift: full weight to day 60, linear to 0 at day 90, then missing."""
    fade = F.when(col(days) <= 60, 1.0).otherwise((90 - col(days)) / 30.0)
    return F.when((col(days) >= 0) & (col(days) <= 90), 0.5 + clip(pct, -0.50, 0.50) * fade)


# Consensus label -> score, and rating grade -> score.
CONSENSUS_LABEL = {"Strong Buy": 1.00, "Buy": 0.75, "Hold": 0.50, "Sell": 0.25, "Strong Sell": 0.00}
GRADE_SCORE = {
    "strongbuy": 1.0, "buy": 0.75, "outperform": 0.70, "overweight": 0.70, "hold": 0.50, "neutral": 0.50,
    "underperform": 0.25, "sell": 0.10, "underweight": 0.10, "strongsell": 0.0,
}


def _total(counts) -> Column:
    total = F.lit(0)
    for c in counts:
        total = total + F.coalesce(col(c), F.lit(0))
    return total


def consensus_score(label, counts) -> Column:
    """Label score, else the weighted mean of strong-buy ... strong-sell counts; fewer than two analysts is 0."""
    weights = (1.00, 0.75, 0.50, 0.25, 0.00)
    total = _total(counts)
    weighted = F.lit(0.0)
    for w, c in zip(weights, counts):
        weighted = weighted + w * F.coalesce(col(c), F.lit(0))
    return F.when(total < 2, 0.0).otherwise(
        F.coalesce(lookup(CONSENSUS_LABEL, label), F.try_divide(weighted, as_double(total)))
    )


def consensus_source(label, counts) -> Column:
    total = _total(counts).cast("string")
    known = lookup(CONSENSUS_LABEL, label).isNotNull()
    return (
        F.when(_total(counts) < 2, F.concat_ws(":", F.lit("insufficient_coverage"), total))
        .when(known, F.concat_ws(":", F.lit("consensus"), col(label), total))
        .otherwise(F.concat_ws(":", F.lit("consensus_computed"), total))
    )


def rating_action(text) -> Column:
    t = F.lower(col(text))
    return (
        F.when(t.contains("upgrade"), "upgrade").when(t.contains("downgrade"), "downgrade")
        .when(t.contains("initiat") | t.contains("cover"), "initiate")
    )


def sentiment_with_surprise(sentiment, pct, days, has_articles) -> Column:
    """Headline score plus a decaying, bounded earnings boost; only where there is coverage."""
    boost = clip(col(pct) * 0.5 * F.exp(-col(days) * F.log(F.lit(2.0)) / 20.0), -0.20, 0.20)
    use = col(has_articles) & col(pct).isNotNull() & (col(days) <= 90)
    return F.when(use, unit(col(sentiment) + boost)).otherwise(col(sentiment))
