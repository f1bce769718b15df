"""Data-quality assertions over the published lists. Each check returns its violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import WEIGHTS
from ..functions import regime
from ..functions.common import lookup
from .quality import IntegrityError, TICKER_FORMAT, region_of

FOREIGN = ("EUROPE", "ASIA")


def _foreign() -> Column:
    return F.col("market").isin(*FOREIGN)


def _listed() -> Column:
    return F.col("bucket").startswith("top_buys")


def score_range() -> Column:
    return F.col("final_score").isNull() | ~F.col("final_score").between(0.0, 1.0)


def badge_mismatch() -> Column:
    return ~F.col("badge").eqNullSafe(regime.badge("final_score"))


def unsorted() -> Column:
    """A higher score than the row before it in the bucket; a bucket is a published list of bounded length."""
    prev = F.lag("final_score").over(Window.partitionBy("bucket").orderBy("pos"))
    return _listed() & (prev < F.col("final_score"))


def geographic_leak() -> Column:
    return F.contains("ticker", F.lit(".")) != _foreign()


def congress_leak() -> Column:
    return _foreign() & (F.col("congress") > 0)


def over_ceiling(tolerance: float = 1e-4) -> Column:
    """Foreign scores cannot exceed the weight their region's available factors add up to."""
    top = {r: round(sum(w for f, w in WEIGHTS[r].items() if f not in ("congress", "transcript_tone")), 6) for r in ("US", "EU", "ASIA")}
    return _foreign() & (F.col("final_score") > lookup(top, region_of("ticker")) + tolerance)


def bad_format() -> Column:
    return _listed() & ~F.col("ticker").rlike(TICKER_FORMAT)


def overlay_missing(vix: str = "vix", tolerance: float = 1e-4) -> Column:
    limit = regime.vol_multiplier(vix)
    return (limit < 1.0) & (F.col("final_score") > limit + tolerance)


def bad_vix(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("vix").isNull() | ~F.col("vix").between(0.0, 200.0))


CHECKS = {
    "A_SCORE_RANGE": score_range, "B_BADGE": badge_mismatch, "C_SORTING": unsorted, "D_GEOGRAPHY": geographic_leak,
    "E_CONGRESS": congress_leak, "E2_CEILING": over_ceiling, "G_FORMAT": bad_format, "I_OVERLAY": overlay_missing,
}


def violations(lists: DataFrame, codes: tuple[str, ...] = tuple(CHECKS)) -> DataFrame:
    """Broken checks of all list rows, from one pass: code, bucket, ticker."""
    flagged = lists.select("bucket", "ticker", *[CHECKS[k]().alias(k) for k in codes])
    found = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in codes]))
    return flagged.select(F.explode(found).alias("code"), "bucket", "ticker")


def single_name(block: DataFrame) -> DataFrame:
    """First broken rule per single-name row, or null."""
    foreign = F.col("market").isin(*FOREIGN)
    code = (
        F.when(F.col("ticker").isNull() | (F.col("ticker") == ""), "TICKER_MISSING")
        .when(~F.col("ticker").rlike(TICKER_FORMAT), "TICKER_FORMAT")
        .when(~F.coalesce(F.col("pipeline").isin("US", "INTL"), F.lit(False)), "PIPELINE")
        .when(F.col("scoring_mode").isNull(), "SCORING_MODE")
        .when(F.col("final_score").isNull() | ~F.col("final_score").between(0.0, 1.0), "SCORE_RANGE")
        .when(~F.col("badge").eqNullSafe(regime.badge("final_score")), "BADGE")
        .when(F.contains("ticker", F.lit(".")) != foreign, "GEOGRAPHY")
        .when(foreign & (F.col("congress") > 0), "CONGRESS")
    )
    return block.withColumn("code", code)


def audit(lists: DataFrame) -> None:
    """Raise on the first violation in check order."""
    first = violations(lists).orderBy("code", "bucket", "ticker").limit(1).collect()
    if first:
        raise IntegrityError(f"{first[0]['code']}: {first[0]['ticker']} in {first[0]['bucket']}")


def flat_signals(long: DataFrame, keys: list[str], min_rows: int = 5) -> DataFrame:
    """Factors with one single value (to two digits) over more than min_rows rows."""
    s = long.groupBy(*keys, F.round("score", 2).alias("v")).agg(F.count(F.lit(1)).alias("k")).groupBy(*keys).agg(
        F.sum("k").alias("n"), F.count("v").alias("values")
    )
    return s.where((F.col("n") > min_rows) & (F.col("values") == 1))


def flat_share(df: DataFrame, keys: list[str], value: str, limit: float = 0.5) -> DataFrame:
    """Groups in which one value covers more than `limit` of the rows."""
    per = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("k"))
    top = per.groupBy(*keys).agg(F.sum("k").alias("n"), F.max("k").alias("top"))
    return top.withColumn("share", F.col("top") / F.col("n")).withColumn("flat", F.col("share") > limit)
