"""Factor bundles: all scores of a name side by side, from the prepared input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SUFFIX_REGION, US_ONLY_FACTORS, PILLARS
from ..functions import consensus, fundamentals, ownership, price
from ..functions.common import ratio
from . import events


def factor_columns() -> dict[str, Column]:
    """Every pillar factor as a column expression over the prepared row."""
    c = F.col
    missing = F.lit(None).cast("double")
    return {
        "quality_dupont": fundamentals.dupont_quality(missing, "npm", "turnover", "de"),
        "fcf_yield": fundamentals.fcf_yield((c("c_1y") - c("c_0y")) / 100.0, c("c_all") / 100.0),
        "quality_piotroski": c("quality_piotroski"),
        "analyst_revision": consensus.revision(ratio(c("px1") - c("px0"), "px0"), "n_1y"),
        "pead_surprise": consensus.surprise_drift("surprise_pct", "surprise_days"),
        "price_target_upside": price.upside("px1", "px"),
        "insider_alpha": ownership.insider_alpha(
            "insider_conviction", ownership.residual("insider_breadth", "insider_conviction"),
            "buy30", "buy180", c("ceo_c") / 100.0, c("buy_c") / 100.0,
        ),
        "congress": c("congress"),
        "inst_flow_13f": c("inst_flow_13f"),
        "pb_value_up": fundamentals.pb_value("px0", "px1"),
        "analyst_consensus": c("analyst_consensus"),
        "inst_concentration": ownership.concentration_13f(c("n_1y") * 5.0, "n_lines", "buys_1y", "sells_1y"),
        "dividend_sustain": ownership.dividend_sustain("npm", "de", c("c_1y") / 100.0, F.when(c("n_0y") > 0, c("c_0y") / 100.0)),
        "amihud_shock": price.illiquidity_shock(ratio("px1", "q_1y"), ratio(c("px") * 3.0, "q_all")),
        "margin_expansion": fundamentals.margin_expansion("npm", "opm"),
        "roic_quality": fundamentals.roic_quality(c("npm") * 5.0, c("opm") * 3.0),
        "revision_velocity": c("revision_velocity"),
    }


def region_factors(region: str) -> list[str]:
    return [f for (r, _), (_, parts) in PILLARS.items() if r == region for f in parts]


def all_pillar_inputs(entries: DataFrame, estimates: DataFrame) -> DataFrame:
    """Names with every pillar factor; US-only factors are missing elsewhere."""
    velocity = events.estimate_velocity(estimates).select("pid", "revision_velocity")
    wide = entries.join(velocity, "pid", "left")
    us = F.col("market") == "USA"
    cols = {n: F.when(us, e) if n in US_ONLY_FACTORS else e for n, e in factor_columns().items()}
    keep = ["pid", "ticker", "market", "region", "sector", "cap_tier", "quality_raw"]
    return wide.select(*keep, *[e.alias(n) for n, e in cols.items()])


def price_only(entries: DataFrame) -> DataFrame:
    """Fallback bundle: price factors kept, everything else missing."""
    return entries.select(
        "ticker", price.momentum("mom_ret").alias("momentum_long"), price.volume_attention("volume_spike").alias("volume_attention"),
        F.lit(None).cast("double").alias("insider_conviction"), F.lit(None).cast("double").alias("analyst_consensus"),
    )


assert set(SUFFIX_REGION.values()) == {"EU", "ASIA"}
