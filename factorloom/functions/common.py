"""Null-safe scalar building blocks shared by all scorers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num(x) -> Column:
    """Double, with NaN read as missing."""
    d = col(x).cast("double")
    return F.when(~F.isnan(d), d)


def clip(x, lo: float, hi: float) -> Column:
    """Bound a value; missing stays missing (least/greatest alone would drop the null)."""
    c = col(x)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def unit(x) -> Column:
    return clip(x, 0.0, 1.0)


def band_score(x, half_width: float) -> Column:
    """Map [-half_width, half_width] linearly onto [0, 1]."""
    return (clip(x, -half_width, half_width) + half_width) / (2.0 * half_width)


def ratio(a, b) -> Column:
    """a / b, missing on a zero or missing base."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def zero_if_null(x) -> Column:
    return F.coalesce(col(x).cast("double"), F.lit(0.0))


def log_saturation(x, full_at: float) -> Column:
    """min(1, ln(1+x) / ln(1+full_at))."""
    return F.least(F.lit(1.0), F.log1p(col(x)) / F.log1p(F.lit(float(full_at))))


def recency_decay(base, age_days, floor: float = 0.70, grace: int = 30, span: int = 150) -> Column:
    """Pull a score towards 0.5 once its newest evidence is older than the grace period."""
    age = col(age_days)
    late = F.least(age - F.lit(grace), F.lit(span)) / F.lit(float(span))
    keep = F.greatest(F.lit(floor), 1.0 - (1.0 - floor) * late)
    return F.when(age > grace, 0.5 + (col(base) - 0.5) * keep).otherwise(col(base))


def lookup(mapping: dict, key) -> Column:
    """Fixed-size lookup table as a literal map, folded into the expression."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), col(key))


def as_double(x) -> Column:
    return col(x).cast("double")


def r6(x) -> Column:
    """Output rounding; adding 0.0 turns -0.0 into 0.0."""
    return F.round(col(x), 6) + F.lit(0.0)


def metric_cell(x) -> Column:
    """Number from a cell that may hold JSON text: {"score": n}, [n, ...] or plain n; blank or unreadable is 0, null stays missing."""
    s = F.trim(col(x))
    value = (
        F.when(s.startswith("{"), F.get_json_object(s, "$.score"))
        .when(s.startswith("["), F.get_json_object(s, "$[0]"))
        .otherwise(s)
    )
    return F.when(col(x).isNotNull(), F.coalesce(value.try_cast("double"), F.lit(0.0)))
