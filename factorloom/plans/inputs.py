"""The derived input views themselves, each checked against its SQL statement."""

from pyspark.sql import functions as F

from ..functions.common import r6
from ..oracles.base import FACTORS, statement
from ..views import US_FACTORS
from .registry import query

query("view_universe", statement("uni", "SELECT sid, ticker, market, sector, cap_tier, round(market_cap, 2) AS market_cap FROM uni"))(
    lambda t: t.universe.withColumn("market_cap", F.round("market_cap", 2))
)
query("view_bars", statement("bars", "SELECT sid, d, close, high, low, volume FROM bars"))(
    lambda t: t.bars_plan.drop("traded_c")
)
query("view_statements", statement("stm", "SELECT ticker, d, filing_date, round(revenue, 2) AS revenue, round(op_income, 2) AS op_income, n FROM stm"))(
    lambda t: t.statements.select("ticker", "d", "filing_date", F.round("revenue", 2).alias("revenue"), F.round("op_income", 2).alias("op_income"), "n")
)
query("view_vix", statement("vix", "SELECT d, round(vix, 2) AS vix FROM vix"))(lambda t: t.vix.select("d", F.round("vix", 2).alias("vix")))

query(
    "J01_gather_wide_row",
    statement("scored", "SELECT ticker, market, sector, cap_tier, round(market_cap, 2) AS market_cap, quality_raw::BIGINT AS quality_raw, "
              + ", ".join(f"round({f}, 6) + 0.0 AS {f}" for f in FACTORS) + " FROM scored"),
)(
    lambda t: t.gathered.select(
        "ticker", "market", "sector", "cap_tier", F.round("market_cap", 2).alias("market_cap"),
        F.col("quality_raw").cast("long").alias("quality_raw"), *[r6(f).alias(f) for f in US_FACTORS],
    )
)
query(
    "view_entries",
    statement("entries", "SELECT ticker, final_score, badge, pipeline, round(coverage, 6) AS coverage, round(npr_spike, 6) AS npr_spike, atr FROM entries"),
)(
    lambda t: t.entries_plan.select("ticker", "final_score", "badge", "pipeline", r6("coverage").alias("coverage"), r6("npr_spike").alias("npr_spike"), "atr")
)
