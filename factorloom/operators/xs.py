"""Cross-sectional normalisation: winsorise, min-max, bucket neutralisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .distribution import attach, join_on, percentiles, rank_table, with_average_rank

MIN_BUCKET = 5
FLAT_STD = 1e-9
#: Pairs of one group that a task may sort, at some 64 bytes each.
GROUP_ROWS = 2_000_000


def _bound(x, lo, hi) -> Column:
    return F.when(F.col(x).isNotNull(), F.greatest(F.col(lo), F.least(F.col(hi), F.col(x))))


def winsorise(df: DataFrame, keys: list[str], value: str, lo: float = 0.01, hi: float = 0.99, name: str = "winsorised") -> DataFrame:
    limits = percentiles(df, keys, value, {"_p_lo": lo, "_p_hi": hi})
    return attach(df, limits, keys).withColumn(name, _bound(value, "_p_lo", "_p_hi")).drop("_p_lo", "_p_hi")


def min_max(df: DataFrame, keys: list[str], value: str, lo: float = 0.0, hi: float = 1.0, name: str = "scaled") -> DataFrame:
    """Scale to [lo, hi]; a group without range maps to lo."""
    limits = df.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    part = F.try_divide(F.col(value) - F.col("_min"), F.col("_max") - F.col("_min"))
    scaled = F.when(F.col(value).isNotNull(), F.coalesce(lo + (hi - lo) * part, F.lit(float(lo))))
    return attach(df, limits, keys).withColumn(name, scaled).drop("_min", "_max")


def normalise_scores(df: DataFrame, keys: list[str], value: str, lo_pct: float = 0.01, hi_pct: float = 0.99,
                     lo: float = 0.0, hi: float = 100.0, name: str = "normalised") -> DataFrame:
    w = winsorise(df, keys, value, lo_pct, hi_pct, "_w")
    return min_max(w, keys, "_w", lo, hi, name).drop("_w")


def normalise_factors(long: DataFrame, keys: list[str], value: str = "score", name: str = "norm") -> DataFrame:
    """Per factor: missing reads 0; all zero -> 0; one row or constant -> 0.5; mostly zero -> no winsorising."""
    filled = long.withColumn("_v", F.coalesce(F.col(value), F.lit(0.0)))
    stats = filled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.avg((F.col("_v") == 0).cast("int")).alias("_zeros"),
    ).join(percentiles(filled, keys, "_v", {"_p5": 0.05, "_p95": 0.95}), keys)
    raw = F.col("_zeros") > 0.9
    lo = F.when(raw, F.col("_min")).otherwise(F.col("_p5"))
    hi = F.when(raw, F.col("_max")).otherwise(F.col("_p95"))
    x = F.greatest(lo, F.least(hi, F.col("_v")))
    norm = (
        F.when((F.col("_min") == 0) & (F.col("_max") == 0), 0.0)
        .when((F.col("_n") == 1) | (F.col("_min") == F.col("_max")) | (hi <= lo), 0.5)
        .otherwise(F.try_divide(x - lo, hi - lo))
    )
    return attach(filled, stats, keys).withColumn(name, norm).drop("_v", "_n", "_min", "_max", "_zeros", "_p5", "_p95")


def _logistic(z) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def _neutral(x, mean, std) -> Column:
    z = F.try_divide(F.col(x) - F.col(mean), F.col(std))
    s = F.when(F.col(std) <= FLAT_STD, 0.5).otherwise(_logistic(z))
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), s))


def neutralise(long: DataFrame, value: str = "score", factor: str = "factor", primary=("market", "sector", "cap_tier"),
               fallback=("market", "cap_tier"), zero_is_dead: Column | None = None, min_bucket: int = MIN_BUCKET) -> DataFrame:
    """Two-stage bucket z-scores through a logistic, on long rows; adds `neutral` and `level`.

    Stage one uses the narrow bucket. Rows in buckets that are too small go to stage two, whose statistics cover only those rows; what is still too small
    keeps its raw score. The rows are aggregated once, to count, mean and deviation of the narrow buckets; the wider ones are merged from those, as all
    keys of `fallback` are in `primary`. So there is one table of statistics, of one row per narrow bucket, and one join back to the rows.
    """
    if not set(fallback) <= set(primary):
        raise ValueError("the wider bucket must be made of whole narrow ones")
    dead = zero_is_dead if zero_is_dead is not None else F.lit(True)
    x = F.col(value).cast("double")
    active = x.isNotNull() & ~(dead & (x == 0))
    rows = long.withColumn("_x", F.when(active, x))
    k1, k2 = [factor, *primary], [factor, *fallback]
    narrow = rows.where(F.col("_x").isNotNull()).groupBy(*k1).agg(F.count("_x").alias("_n1"), F.avg("_x").alias("_m1"), F.stddev_pop("_x").alias("_s1"))
    # over the small narrow buckets of a wide one: as many rows as there are values of the further keys
    wide = Window.partitionBy(*k2, F.col("_n1") < min_bucket)
    stats = narrow.withColumn("_n2", F.sum("_n1").over(wide)).withColumn("_m2", F.sum(F.col("_n1") * F.col("_m1")).over(wide) / F.col("_n2"))
    spread = F.pow("_s1", F.lit(2)) + F.pow(F.col("_m1") - F.col("_m2"), F.lit(2))
    stats = stats.withColumn("_s2", F.sqrt(F.sum(F.col("_n1") * spread).over(wide) / F.col("_n2")))
    two = attach(rows, stats, k1)
    big = F.coalesce(F.col("_n1") >= min_bucket, F.lit(False))
    big2 = F.coalesce(F.col("_n2") >= min_bucket, F.lit(False))
    neutral = (
        F.when(x.isNull(), None)
        .when(F.col("_x").isNull(), 0.0)
        .when(big, _neutral("_x", "_m1", "_s1"))
        .when(big2, _neutral("_x", "_m2", "_s2"))
        .otherwise(F.col("_x"))
    )
    level = (
        F.when(x.isNull(), "none").when(F.col("_x").isNull(), "zero").when(big, "sector_cap_tier")
        .when(big2, "cap_tier").otherwise("raw")
    )
    return two.withColumn("neutral", neutral).withColumn("level", level).drop("_x", "_n1", "_m1", "_s1", "_n2", "_m2", "_s2")


def percent_rank(df: DataFrame, keys: list[str], value: str, name: str = "pct") -> DataFrame:
    """Average rank over the number of ranked rows."""
    r = with_average_rank(df, keys, value, "_r")
    return r.withColumn(name, F.col("_r") / F.col("_r_n")).drop("_r", "_r_n")


def _window_rank(keys: list[str], value: str) -> Column:
    """Average rank inside a group."""
    group = keys or [F.lit(0)]
    return F.rank().over(Window.partitionBy(*group).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, value)) - 1) / 2.0


def spearman(df: DataFrame, keys: list[str], a: str, b: str, name: str = "rho", group_rows: int | None = None) -> DataFrame:
    """Rank correlation per group over rows with both values; constant input gives null.

    The groups are counted first. If none has more than `group_rows`, the pairs are dealt out by group, once, and ranked there; a larger group is ranked by
    cells of values (see `distribution`), for which the pairs move several times.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).cast("double"), F.col(b).cast("double"))
    pairs = materialize(pairs, "rank-pairs")  # read for the sizes and for the ranks; if dealt out, for either side's ranks and for the join
    if ((pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]) or 0) <= (group_rows or GROUP_ROWS):
        return pearson(pairs.select(*keys, _window_rank(keys, a).alias("_ra"), _window_rank(keys, b).alias("_rb")), keys, "_ra", "_rb", name)
    ranked = join_on(join_on(pairs, rank_table(pairs, keys, a, "_ra"), [*keys, a]), rank_table(pairs, keys, b, "_rb"), [*keys, b])
    return pearson(ranked, keys, "_ra", "_rb", name)


def pearson(df: DataFrame, keys: list[str], a: str, b: str, name: str = "rho") -> DataFrame:
    """Correlation per group; null where either side is constant."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(a, b).alias("_c"), F.stddev_pop(a).alias("_a"), F.stddev_pop(b).alias("_b")
    )
    rho = F.when((F.col("_a") > 1e-12) & (F.col("_b") > 1e-12), F.try_divide(F.col("_c"), F.col("_a") * F.col("_b")))
    return out.select(*keys, "n", rho.alias(name))
