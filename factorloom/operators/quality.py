"""Row validation, completeness, isolation and freshness checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SUFFIX_CURRENCY, SUFFIX_REGION
from ..functions.common import col, lookup

# Fixed value: accepted ticker format.
TICKER_FORMAT = r"^([A-Z]{1,5}|[A-Z0-9]{1,6}\.[A-Z]{1,2})$"


class IntegrityError(RuntimeError):
    """A table failed a gate that must stop the run."""


def suffix(ticker) -> Column:
    return F.regexp_extract(F.upper(col(ticker)), r"\.([^.]*)$", 1)


def region_of(ticker) -> Column:
    return F.coalesce(lookup(SUFFIX_REGION, suffix(ticker)), F.lit("US"))


def currency_of(ticker) -> Column:
    return F.coalesce(lookup(SUFFIX_CURRENCY, suffix(ticker)), F.lit("USD"))


def misplaced(df: DataFrame, region: Column) -> DataFrame:
    """Rows whose suffix does not belong to the region they are listed under."""
    return df.where(region_of("ticker") != region)


def require_none(violations: DataFrame, message: str) -> None:
    """Raise with a few examples if there is any violation."""
    sample = violations.limit(5).collect()
    if sample:
        raise IntegrityError(f"{message}: {[r.asDict() for r in sample]}")


def unusable(x, positive: bool) -> Column:
    """Missing, NaN or infinite; optionally also not above zero."""
    v = col(x)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return bad | (v <= 0) if positive else bad


def date_issue(ts: Column, source_age_hours: Column, now: dt.datetime, max_age_days: float = 5.0, source_stale_hours: float = 48.0,
               skew_seconds: float = 60.0) -> Column:
    """One code per row: stale source first, then unparseable, future, stale; null is clean."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) / 1e6 - F.unix_micros(ts) / 1e6
    return (
        F.when(source_age_hours > source_stale_hours, "STALE_SOURCE")
        .when(ts.isNull(), "INVALID_DATE")
        .when(age < -skew_seconds, "FUTURE_DATE")
        .when(age > max_age_days * 86400.0, "STALE_DATA")
    )


QUARANTINE_CODES = ("STALE_SOURCE", "INVALID_DATE", "FUTURE_DATE", "INVALID_TICKER", "MISSING_AMOUNT")


def split_quarantine(df: DataFrame, code: str = "code", max_share: float | None = 0.20) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined); above the allowed share of failed rows the run stops."""
    failed = F.coalesce(F.col(code).isin(*QUARANTINE_CODES), F.lit(False))
    if max_share is not None:
        n, bad = df.agg(F.count(F.lit(1)), F.sum(failed.cast("int"))).first()
        if n and (bad or 0) / n > max_share:
            raise IntegrityError(f"{bad} of {n} rows failed validation, above {max_share:.0%}")
    return df.where(~failed), df.where(failed)


def completeness(df: DataFrame, factors: list[str], allowed_missing: int) -> DataFrame:
    """Zero or missing factors per row, their names in order, and the complete flag."""
    names = F.array(*[F.when(F.coalesce(F.col(f), F.lit(0.0)) == 0, F.lit(f)) for f in factors])
    m = df.withColumn("missing", F.array_compact(names))
    return m.withColumns({"n_missing": F.size("missing"), "is_complete": F.size("missing") <= allowed_missing})


def require_complete(df: DataFrame, min_share: float = 0.40) -> None:
    n, ok = df.agg(F.count(F.lit(1)), F.sum(F.col("is_complete").cast("int"))).first()
    if (ok or 0) < max(1, round(min_share * n)):
        raise IntegrityError(f"only {ok} of {n} rows are complete")


def blackouts(long: DataFrame, region: str = "region", rate: float = 0.9) -> DataFrame:
    """Factors missing for at least `rate` of a region."""
    s = long.groupBy(region, "factor").agg(F.avg(F.col("score").isNull().cast("int")).alias("none_rate"))
    return s.where(F.col("none_rate") >= rate)


def ny_time(ts) -> Column:
    return F.from_utc_timestamp(col(ts), "America/New_York")


def is_us_session(ts) -> Column:
    """Weekday, 09:30 to before 16:00 New York time."""
    ny = ny_time(ts)
    minutes = F.hour(ny) * 60 + F.minute(ny)
    return ~F.dayofweek(ny).isin(1, 7) & (minutes >= 570) & (minutes < 960)


def is_us_listing(ticker) -> Column:
    return F.coalesce((F.length(col(ticker)) > 0) & ~F.contains(col(ticker), F.lit(".")), F.lit(False))
