"""Bar-window operators. Input bars are one row per (key, period), so a key's window is bounded by
the calendar; all operators on the same bars share one (key, date) sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import ratio
from .distribution import attach

KEY, DAY = "sid", "d"


def by_key(key: str = KEY, day: str = DAY):
    return Window.partitionBy(key).orderBy(day)


def change(value, base) -> Column:
    return ratio(value, base) - 1.0


def price_features(bars: DataFrame, far: int, near: int, short: int, mid: int, recent: int, base: int, key: str = KEY) -> DataFrame:
    """Far-to-near return, short and mid returns, and recent volume over its earlier mean (capped at 20)."""
    w = by_key(key)
    now = F.avg("volume").over(w.rowsBetween(-(recent - 1), 0))
    earlier = w.rowsBetween(-(recent + base - 1), -recent)
    then = F.when(F.count("volume").over(earlier) == base, F.avg("volume").over(earlier))
    return bars.withColumns({
        "ret_12_1": change(F.lag("close", near).over(w), F.lag("close", far).over(w)),
        "ret_short": change("close", F.lag("close", short).over(w)),
        "ret_mid": change("close", F.lag("close", mid).over(w)),
        "volume_spike": F.when(then > 0, F.least(F.lit(20.0), ratio(now, then))).otherwise(1.0),
    })


def volume_velocity(bars: DataFrame, key: str = KEY, short: int = 5, long: int = 20) -> DataFrame:
    w = by_key(key)
    v = ratio(F.avg("volume").over(w.rowsBetween(-(short - 1), 0)), F.avg("volume").over(w.rowsBetween(-(long - 1), 0))) - 1.0
    return bars.withColumn("velocity", v)


def with_bench(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Only sessions both sides traded; the benchmark has one row per period and is broadcast once measured, so bars stay where they are."""
    return attach(bars, bench, [DAY], "inner")


def rolling_beta(bars: DataFrame, bench: DataFrame, window: int) -> DataFrame:
    w = by_key()
    r = with_bench(bars, bench).select(
        KEY, DAY, change("close", F.lag("close").over(w)).alias("ra"), change("bench", F.lag("bench").over(w)).alias("rb")
    )
    f = w.rowsBetween(-(window - 1), 0)
    var = F.var_pop("rb").over(f)
    beta = F.when((F.count("ra").over(f) >= window) & (var >= 1e-12), F.try_divide(F.covar_pop("ra", "rb").over(f), var))
    return r.withColumn("beta", beta)


def forward_excess(bars: DataFrame, bench: DataFrame, h: int) -> DataFrame:
    w = by_key()
    own = change(F.lead("close", h).over(w), "close")
    ref = change(F.lead("bench", h).over(w), "bench")
    return with_bench(bars, bench).withColumn("fwd_excess", own - ref)


def momentum_excess(bars: DataFrame, bench: DataFrame, far: int, near: int) -> DataFrame:
    w = by_key()
    own = change(F.lag("close", near).over(w), F.lag("close", far).over(w))
    ref = change(F.lag("bench", near).over(w), F.lag("bench", far).over(w))
    return with_bench(bars, bench).withColumn("mom_excess", own - ref)


def _volume_z(window: int) -> Column:
    f = by_key().rowsBetween(-window, -1)
    sd = F.stddev_pop("volume").over(f)
    z = F.when(sd <= 1e-12, 0.0).otherwise(F.try_divide(F.col("volume") - F.avg("volume").over(f), sd))
    return F.when(F.count("volume").over(f) >= window, z)


def volume_zscore(bars: DataFrame, window: int = 20) -> DataFrame:
    """Today's volume against the trailing window, today excluded; a flat window reads 0."""
    return bars.withColumn("volume_z", _volume_z(window))


def sample_snapshots(bars: DataFrame, step: int, horizon: int, limit: int) -> DataFrame:
    """Every `step`-th bar counted back from the last one that still has a full forward window."""
    w = by_key()
    numbered = bars.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(KEY)))
    back = F.col("n") - 1 - horizon - F.col("i")
    return numbered.where((back >= 0) & (back % step == 0) & (back < step * limit)).drop("n")


def rebuild_snapshots(bars: DataFrame, bench: DataFrame, far: int, near: int, horizon: int, step: int, limit: int) -> DataFrame:
    """Point-in-time factors plus forward label on the sampled bars: one sort per key for all of it."""
    w = by_key()
    both = with_bench(bars, bench)
    own = change(F.lag("close", near).over(w), F.lag("close", far).over(w)) - change(F.lag("bench", near).over(w), F.lag("bench", far).over(w))
    fwd = change(F.lead("close", horizon).over(w), "close") - change(F.lead("bench", horizon).over(w), "bench")
    feats = both.withColumns({"mom_excess": own, "volume_z": _volume_z(20), "fwd_excess": fwd})
    return sample_snapshots(feats, step, horizon, limit)


def illiquidity(bars: DataFrame, baseline: int = 20) -> DataFrame:
    """Price impact today and the median of the non-zero impacts of the bars before."""
    w = by_key()
    impact = F.coalesce(F.abs(change("close", F.lag("close").over(w))) / F.nullif(F.col("volume") * F.col("close"), F.lit(0.0)), F.lit(0.0))
    a = bars.select(KEY, DAY, impact.alias("today"), F.row_number().over(w).alias("k"))
    med = F.percentile(F.when(F.col("today") > 0, F.col("today")), F.lit(0.5)).over(w.rowsBetween(-baseline, -1))
    return a.withColumn("median", med).where(F.col("k") > baseline)


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Wilder averages as closed-form weighted sums: seed weight k^(n-p), later bars k^(n-i) / p."""
    w = by_key()
    x = F.col("close") - F.lag("close").over(w)
    d = bars.select(KEY, x.alias("x"), (F.row_number().over(w) - 1).alias("i"), (F.count(F.lit(1)).over(Window.partitionBy(KEY)) - 1).alias("n"))
    k = (period - 1) / period
    weight = F.pow(F.lit(k), F.col("n") - F.greatest(F.col("i"), F.lit(period))) / period
    sums = d.where((F.col("i") >= 1) & (F.col("n") >= period)).groupBy(KEY).agg(
        F.sum(F.greatest(F.col("x"), F.lit(0.0)) * weight).alias("g"), F.sum(F.greatest(-F.col("x"), F.lit(0.0)) * weight).alias("l")
    )
    from ..functions.price import rsi_from_averages

    return sums.withColumn("rsi", rsi_from_averages("g", "l"))


def _moves(bars: DataFrame) -> DataFrame:
    """True range and directional moves per bar, from the second bar on."""
    w = by_key()
    ph, pl, pc = (F.lag(c).over(w) for c in ("high", "low", "close"))
    up, down = F.col("high") - ph, pl - F.col("low")
    return bars.select(
        KEY, DAY,
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)).alias("tr"),
        F.when((up > down) & (up > 0), up).otherwise(0.0).alias("pdm"),
        F.when((down > up) & (down > 0), down).otherwise(0.0).alias("mdm"),
        F.when(pc.isNotNull(), F.col("close") - pc).alias("x"),
    ).where("x IS NOT NULL")


def _wilder(first: Column, before: Column, value: Column, period: int) -> Column:
    """Running Wilder sum: plain sum while seeding, then s - s/p + x."""
    return F.when(first, before + value).otherwise(before * (1.0 - 1.0 / period) + value)


def _adx_of(moves: Column, period: int) -> Column:
    """One fold over an array of moves, carrying three smoothed sums and the smoothed index."""
    zero, none = F.lit(0.0), F.lit(0)
    start = F.struct(none.alias("i"), zero.alias("t"), zero.alias("a"), zero.alias("b"), none.alias("m"), zero.alias("adx"))

    def sums(acc, v):
        seed = acc["i"] < period
        return F.struct(
            (acc["i"] + 1).alias("i"), _wilder(seed, acc["t"], v["tr"], period).alias("t"), _wilder(seed, acc["a"], v["pdm"], period).alias("a"),
            _wilder(seed, acc["b"], v["mdm"], period).alias("b"), acc["m"].alias("m"), acc["adx"].alias("adx"),
        )

    def index(acc):
        dx = F.when(acc["t"] <= 0, 0.0).otherwise(F.coalesce(100.0 * F.abs(F.try_divide(acc["a"] - acc["b"], acc["a"] + acc["b"])), zero))
        smooth = F.when(acc["m"] < period, acc["adx"] + dx / period).otherwise((acc["adx"] * (period - 1) + dx) / period)
        ready = acc["i"] >= period
        return F.struct(
            acc["i"].alias("i"), acc["t"].alias("t"), acc["a"].alias("a"), acc["b"].alias("b"),
            (acc["m"] + F.when(ready, 1).otherwise(0)).alias("m"), F.when(ready, smooth).otherwise(acc["adx"]).alias("adx"),
        )

    # The inner one-element transform names the new sums once, so the index reads them instead of rebuilding them.
    step = lambda acc, v: F.element_at(F.transform(F.array(sums(acc, v)), index), 1)
    return F.aggregate(moves, start, step, lambda acc: F.when(acc["m"] >= period, acc["adx"]))


def _wilder_mean(values: Column, period: int) -> Column:
    """Wilder average of an array: mean of the first `period` values, then (a (p-1) + x) / p."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("a"))

    def step(acc, x):
        a = F.when(acc["i"] < period, acc["a"] + x / period).otherwise((acc["a"] * (period - 1) + x) / period)
        return F.struct((acc["i"] + 1).alias("i"), a.alias("a"))

    return F.aggregate(values, start, step, lambda acc: acc["a"])


def adx(bars: DataFrame, period: int = 14) -> DataFrame:
    """Trend strength per key; the folded arrays hold one value per calendar period."""
    m = _moves(bars).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(DAY, "tr", "pdm", "mdm"))).alias("m"))
    return m.select(KEY, F.when(F.size("m") >= 2 * period, _adx_of(F.col("m"), period)).alias("adx"))


def windowed_technicals(bars: DataFrame, window: int, period: int) -> DataFrame:
    """RSI reversal and ADX at every bar over its trailing window only."""
    from ..functions.price import adx_score, rsi_from_averages, rsi_reversion

    f = by_key().rowsBetween(-(window - 2), 0)
    m = _moves(bars).select(KEY, DAY, F.collect_list(F.struct("tr", "pdm", "mdm", "x")).over(f).alias("m"))
    full = m.where(F.size("m") >= 2 * period)
    g = _wilder_mean(F.transform("m", lambda s: F.greatest(s["x"], F.lit(0.0))), period)
    l = _wilder_mean(F.transform("m", lambda s: F.greatest(-s["x"], F.lit(0.0))), period)
    folded = full.select(KEY, DAY, g.alias("g"), l.alias("l"), _adx_of(F.col("m"), period).alias("adx"))
    return folded.select(KEY, DAY, rsi_reversion(rsi_from_averages("g", "l")).alias("rsi_score"), adx_score("adx").alias("adx_score"))


def bench_returns(bench: DataFrame) -> DataFrame:
    """Benchmark returns; one row per calendar period, so the single ordered window stays small."""
    w = Window.partitionBy(F.lit(0)).orderBy(DAY)
    return bench.withColumns({
        "r1": change("bench", F.lag("bench", 1).over(w)),
        "r3": change("bench", F.lag("bench", 3).over(w)),
        "r12": change(F.lag("bench", 1).over(w), F.lag("bench", 12).over(w)),
        "r12_full": change("bench", F.lag("bench", 12).over(w)),
    })


def leverage_key(df: DataFrame, keys: list[str], alpha: float = 0.15) -> DataFrame:
    """Dollar volume with a soft beta tilt; grouped statistics joined back."""
    s = df.groupBy(*keys).agg(F.count("beta").alias("_n"), F.avg("beta").alias("_m"), F.stddev_pop("beta").alias("_s"))
    z = F.try_divide(F.col("beta") - F.col("_m"), F.col("_s"))
    tilt = F.coalesce(F.when(z.isNotNull(), F.greatest(F.lit(-2.0), F.least(F.lit(2.0), z))), F.lit(0.0))
    boost = F.when((F.col("_n") >= 2) & (F.col("_s") > 0), 1.0 + alpha * tilt).otherwise(1.0)
    key = F.round(F.coalesce("adv_usd", F.lit(0.0)) * boost, 4)
    return attach(df, s, keys).withColumn("leverage_key", key).drop("_n", "_m", "_s")
