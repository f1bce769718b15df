"""Weight sets, factor specs and suffix tables. Values here are fixed by the strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Traded weights per region.
WEIGHTS = {
    "US": {
        "insider_conviction": 0.30, "insider_breadth": 0.12, "congress": 0.01,
        "news_sentiment": 0.10, "news_buzz": 0.01, "momentum_long": 0.15,
        "volume_attention": 0.01, "analyst_consensus": 0.10, "quality_piotroski": 0.08,
        "transcript_tone": 0.05, "revenue_revision": 0.03, "inst_flow_13f": 0.04,
    },
    "EU": {
        "insider_conviction": 0.08, "insider_breadth": 0.04, "congress": 0.00, "news_sentiment": 0.05,
        "news_buzz": 0.00, "momentum_long": 0.08, "volume_attention": 0.02, "analyst_consensus": 0.07,
        "quality_piotroski": 0.10, "analyst_revision": 0.10, "price_target_upside": 0.10,
        "fcf_yield": 0.14, "amihud_shock": 0.05, "pb_value_up": 0.07, "roic_quality": 0.08,
        "transcript_tone": 0.00, "revenue_revision": 0.02,
    },
    "ASIA": {
        "insider_conviction": 0.08, "insider_breadth": 0.04, "congress": 0.00, "news_sentiment": 0.10,
        "news_buzz": 0.02, "momentum_long": 0.15, "volume_attention": 0.06,
        "analyst_consensus": 0.10, "analyst_revision": 0.05, "price_target_upside": 0.05,
        "quality_piotroski": 0.05, "fcf_yield": 0.10, "amihud_shock": 0.06,
        "pb_value_up": 0.06, "roic_quality": 0.06, "transcript_tone": 0.00, "revenue_revision": 0.02,
    },
    "GLOBAL": {
        "insider_conviction": 0.28, "insider_breadth": 0.14, "congress": 0.00, "news_sentiment": 0.13,
        "news_buzz": 0.02, "momentum_long": 0.17, "volume_attention": 0.04,
        "analyst_consensus": 0.10, "quality_piotroski": 0.05, "analyst_revision": 0.02,
        "price_target_upside": 0.03, "transcript_tone": 0.00, "revenue_revision": 0.02,
    },
    "INTL_PROFILE": {
        "insider_conviction": 0.15, "insider_breadth": 0.08, "news_sentiment": 0.08,
        "news_buzz": 0.02, "momentum_long": 0.12, "volume_attention": 0.03,
        "analyst_consensus": 0.10, "quality_piotroski": 0.05, "analyst_revision": 0.02,
        "price_target_upside": 0.03, "fcf_yield": 0.12, "amihud_shock": 0.06,
        "pb_value_up": 0.07, "roic_quality": 0.07,
    },
}

# Three-pillar weights, (region, pillar) -> (pillar weight, factor weights).
PILLARS = {
    ("US", "fundamental"): (0.30, {"quality_dupont": 0.12, "fcf_yield": 0.10, "quality_piotroski": 0.08}),
    ("US", "consensus"): (0.25, {"analyst_revision": 0.08, "pead_surprise": 0.09, "price_target_upside": 0.08}),
    ("US", "alternative"): (0.45, {"insider_alpha": 0.30, "congress": 0.05, "inst_flow_13f": 0.10}),
    ("EU", "fundamental"): (0.45, {"quality_piotroski": 0.12, "fcf_yield": 0.18, "pb_value_up": 0.15}),
    ("EU", "consensus"): (0.35, {"analyst_consensus": 0.10, "analyst_revision": 0.13, "price_target_upside": 0.12}),
    ("EU", "alternative"): (0.20, {"inst_concentration": 0.07, "dividend_sustain": 0.08, "amihud_shock": 0.05}),
    ("ASIA", "fundamental"): (0.35, {"margin_expansion": 0.13, "roic_quality": 0.10, "quality_piotroski": 0.12}),
    ("ASIA", "consensus"): (0.40, {"analyst_revision": 0.15, "revision_velocity": 0.10, "price_target_upside": 0.15}),
    ("ASIA", "alternative"): (0.25, {"inst_concentration": 0.07, "dividend_sustain": 0.06, "amihud_shock": 0.12}),
}

# Factors whose 0.0 is a real observation, and factors that exist for US names only.
SIGNED_FACTORS = (
    "analyst_revision", "pead_surprise", "price_target_upside", "revision_velocity",
    "margin_expansion", "inst_flow_13f", "inst_concentration",
)
US_ONLY_FACTORS = ("congress", "inst_flow_13f", "pead_surprise", "insider_alpha", "quality_dupont", "transcript_tone")

# Factors that can exist per market (weight renormalisation mask).
MARKET_MASK = {
    "USA": (
        "insider_conviction", "insider_breadth", "news_sentiment", "news_buzz", "momentum_long",
        "volume_attention", "analyst_consensus", "analyst_revision", "price_target_upside", "quality_piotroski",
        "congress", "transcript_tone",
    ),
    "EUROPE": (
        "insider_conviction", "insider_breadth", "news_sentiment", "news_buzz", "momentum_long",
        "volume_attention", "analyst_consensus", "analyst_revision", "price_target_upside", "quality_piotroski",
    ),
    "ASIA": (
        "insider_conviction", "insider_breadth", "news_sentiment", "news_buzz", "momentum_long",
        "volume_attention", "analyst_consensus", "analyst_revision", "price_target_upside", "quality_piotroski",
    ),
}

# Listing suffix -> region, and suffix -> quote currency (other suffixes quote in USD).
EU_SUFFIXES = ("PA", "DE", "L", "AS", "MI", "MC", "BR", "VX", "SW", "LS", "OL", "ST", "HE", "CO", "F", "BE")
ASIA_SUFFIXES = ("T", "HK", "KS", "KQ", "SS", "SZ", "NS", "BO", "SI", "BK", "JK")
SUFFIX_CURRENCY = {
    "L": "GBp", "PA": "EUR", "DE": "EUR", "AS": "EUR", "MI": "EUR", "MC": "EUR", "BR": "EUR",
    "F": "EUR", "BE": "EUR", "LS": "EUR", "HE": "EUR", "VX": "CHF", "OL": "NOK", "ST": "SEK",
    "CO": "DKK", "T": "JPY", "HK": "HKD", "KS": "KRW", "KQ": "KRW", "SS": "CNY", "SZ": "CNY",
    "NS": "INR", "BO": "INR", "SI": "SGD", "BK": "THB", "JK": "IDR",
}
SUFFIX_REGION = {**{s: "EU" for s in EU_SUFFIXES}, **{s: "ASIA" for s in ASIA_SUFFIXES}}
REGION_MARKET = {"US": "USA", "EU": "EUROPE", "ASIA": "ASIA"}

# Monitoring gates and cost model.
IC_TARGET = {"USA": 0.03, "EUROPE": 0.025, "ASIA": 0.02}
COVERAGE_GATE = {"USA": 0.60, "EUROPE": 0.45, "ASIA": 0.40}
ROUNDTRIP_COST = {"large": 0.0020, "mid": 0.0040, "small": 0.0060}
INSIDER_CEILING = {"small": 0.02, "mid": 0.01, "large": 0.005}
TARGET_VOL = {"normal": 0.15, "bear": 0.10, "panic": 0.05}


def check_sums(table: dict = WEIGHTS) -> None:
    """Load-time check: every weight set adds up to one."""
    for name, weights in table.items():
        total = sum(weights.values())
        if abs(total - 1.0) > 1e-6:
            raise ValueError(f"weights of {name} sum to {total}")
    for (region, pillar), (total, parts) in PILLARS.items():
        if abs(sum(parts.values()) - total) > 1e-6:
            raise ValueError(f"pillar {region}/{pillar} does not match its factors")


check_sums()


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table as a VALUES-style relation: no job, and its size is fixed by this file."""
    names = [part.split()[0] for part in schema.split(",")]
    structs = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows])
    return spark.range(1).select(F.inline(structs))


def weight_table(spark: SparkSession, sets: tuple[str, ...] = ("US", "EU", "ASIA")) -> DataFrame:
    """(weight_set, factor, weight)"""
    rows = [(s, f, w) for s in sets for f, w in WEIGHTS[s].items()]
    return _rows(spark, rows, "weight_set string, factor string, weight double")


def pillar_table(spark: SparkSession) -> DataFrame:
    """(region, pillar, pillar_weight, factor, weight, zero_is_dead)"""
    rows = [
        (region, pillar, pw, factor, w, factor not in SIGNED_FACTORS)
        for (region, pillar), (pw, parts) in PILLARS.items()
        for factor, w in parts.items()
    ]
    return _rows(spark, rows, "region string, pillar string, pillar_weight double, factor string, weight double, zero_is_dead boolean")


def market_mask(spark: SparkSession) -> DataFrame:
    """(market, factor) pairs that can carry data."""
    rows = [(m, f) for m, fs in MARKET_MASK.items() for f in fs]
    return _rows(spark, rows, "market string, factor string")


def gate_table(spark: SparkSession) -> DataFrame:
    """(market, ic_target, coverage_gate)"""
    rows = [(m, IC_TARGET[m], COVERAGE_GATE[m]) for m in IC_TARGET]
    return _rows(spark, rows, "market string, ic_target double, coverage_gate double")


def suffix_table(spark: SparkSession) -> DataFrame:
    """(suffix, region, currency)"""
    rows = [(s, r, SUFFIX_CURRENCY.get(s, "USD")) for s, r in SUFFIX_REGION.items()]
    return _rows(spark, rows, "suffix string, region string, currency string")
