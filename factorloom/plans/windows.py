"""Cross-sectional and bar-window queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import price
from ..functions.common import r6, ratio
from ..operators import distribution, ts, xs
from ..oracles.base import statement
from ..views import US_FACTORS
from .registry import query

NEUTRAL = """
    SELECT *, CASE WHEN score IS NULL THEN NULL WHEN x IS NULL THEN 0.0 WHEN n1 >= 5 THEN {0} WHEN n2 >= 5 THEN {1} ELSE x END AS neutral,
           CASE WHEN score IS NULL THEN 'none' WHEN x IS NULL THEN 'zero' WHEN n1 >= 5 THEN 'sector_cap_tier' WHEN n2 >= 5 THEN 'cap_tier' ELSE 'raw' END AS level
    FROM (SELECT *, count(x) FILTER (n1 < 5) OVER w2 AS n2, avg(x) FILTER (n1 < 5) OVER w2 AS m2, stddev_pop(x) FILTER (n1 < 5) OVER w2 AS s2
          FROM (SELECT *, count(x) OVER w1 AS n1, avg(x) OVER w1 AS m1, stddev_pop(x) OVER w1 AS s1
                FROM (SELECT *, CASE WHEN score = 0 THEN NULL ELSE score END AS x FROM ls) a
                WINDOW w1 AS (PARTITION BY factor, market, sector, cap_tier)) b
          WINDOW w2 AS (PARTITION BY factor, market, cap_tier)) c""".format(*[
    f"greatest(0.01, least(0.99, CASE WHEN s{i} <= 1e-9 THEN 0.5 ELSE 1.0 / (1.0 + exp(-greatest(-30.0, least(30.0, (x - m{i}) / s{i})))) END))"
    for i in (1, 2)
])
NEUTRAL_VIEW = {"neu": (("ls",), NEUTRAL)}


def neutral_long(t):
    return xs.neutralise(t.long_scores)


# --- cross-sectional ---------------------------------------------------------------------


@query("W01_winsorise", statement("entries", """
    SELECT ticker, round(greatest(lo, least(hi, px)), 8) AS winsorised FROM entries
    JOIN (SELECT market, quantile_cont(px, 0.01) AS lo, quantile_cont(px, 0.99) AS hi FROM entries GROUP BY market) q USING (market)"""))
def _(t):
    return xs.winsorise(t.entries, ["market"], "px").select("ticker", F.round("winsorised", 8).alias("winsorised"))


@query("W02_winsorise_min_max", statement("entries", """
    SELECT ticker, round(coalesce(100.0 * (w - min(w) OVER m) / nullif(max(w) OVER m - min(w) OVER m, 0), 0.0), 6) AS normalised
    FROM (SELECT ticker, market, greatest(lo, least(hi, px)) AS w FROM entries
          JOIN (SELECT market, quantile_cont(px, 0.01) AS lo, quantile_cont(px, 0.99) AS hi FROM entries GROUP BY market) q USING (market)) z
    WINDOW m AS (PARTITION BY market)"""))
def _(t):
    return xs.normalise_scores(t.entries.select("ticker", "market", "px"), ["market"], "px").select("ticker", r6("normalised").alias("normalised"))


@query("W02_min_max_only", statement("entries", """
    SELECT ticker, round(coalesce((px - min(px) OVER m) / nullif(max(px) OVER m - min(px) OVER m, 0), 0.0), 6) AS scaled
    FROM entries WINDOW m AS (PARTITION BY market)"""))
def _(t):
    return xs.min_max(t.entries.select("ticker", "market", "px"), ["market"], "px").select("ticker", r6("scaled").alias("scaled"))


@query("W03_normalise_factors", statement("ls", """
    SELECT ticker, factor, round(CASE WHEN mn = 0 AND mx = 0 THEN 0.0 WHEN n = 1 OR mn = mx OR hi <= lo THEN 0.5
           ELSE (greatest(lo, least(hi, v)) - lo) / (hi - lo) END, 6) AS norm
    FROM (SELECT *, CASE WHEN z > 0.9 THEN mn ELSE p5 END AS lo, CASE WHEN z > 0.9 THEN mx ELSE p95 END AS hi
          FROM (SELECT ticker, factor, coalesce(score, 0.0) AS v FROM ls) a
          JOIN (SELECT factor, count(*) AS n, min(coalesce(score, 0.0)) AS mn, max(coalesce(score, 0.0)) AS mx,
                       avg(CASE WHEN coalesce(score, 0.0) = 0 THEN 1 ELSE 0 END) AS z, quantile_cont(coalesce(score, 0.0), 0.05) AS p5,
                       quantile_cont(coalesce(score, 0.0), 0.95) AS p95 FROM ls GROUP BY factor) s USING (factor)) q"""))
def _(t):
    return xs.normalise_factors(t.long_scores, ["factor"]).select("ticker", "factor", r6("norm").alias("norm"))


@query("W04_bucket_neutralise", statement("neu", "SELECT ticker, factor, round(neutral, 6) AS neutral, level FROM neu", extra=NEUTRAL_VIEW))
def _(t):
    return neutral_long(t).select("ticker", "factor", r6("neutral").alias("neutral"), "level")


@query("W05_neutral_factors_wide", statement("neu", "SELECT ticker, " + ", ".join(f"round(max(neutral) FILTER (factor = '{f}'), 6) AS {f}" for f in US_FACTORS) + " FROM neu GROUP BY ticker", extra=NEUTRAL_VIEW))
def _(t):
    names = list(US_FACTORS)
    wide = neutral_long(t).groupBy("ticker").pivot("factor", names).agg(F.max("neutral"))
    return wide.select("ticker", *[r6(n).alias(n) for n in names])


@query("W06_absolute_mode", statement("ls", "SELECT ticker, factor, round(greatest(0.0, least(1.0, coalesce(score, 0.0))), 6) AS score FROM ls"))
def _(t):
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))))
    return t.long_scores.select("ticker", "factor", r6(s).alias("score"))


@query("W10_percentile_rank", statement("entries", """
    SELECT ticker, round((rank() OVER (PARTITION BY market ORDER BY volume_spike) + (count(*) OVER (PARTITION BY market, volume_spike) - 1) / 2.0)
           / count(*) OVER (PARTITION BY market), 6) AS pct FROM entries WHERE volume_spike IS NOT NULL"""))
def _(t):
    return xs.percent_rank(t.entries.where("volume_spike IS NOT NULL").select("ticker", "market", "volume_spike"), ["market"], "volume_spike").select(
        "ticker", r6("pct").alias("pct")
    )


@query("W12_average_rank", statement("ls", """
    SELECT ticker, factor, (rank() OVER (PARTITION BY factor ORDER BY score) + (count(*) OVER (PARTITION BY factor, score) - 1) / 2.0)::DOUBLE AS avg_rank
    FROM (SELECT ticker, factor, round(score, 9) AS score FROM ls) x WHERE score IS NOT NULL"""))
def _(t):
    some = t.long_scores.where(F.col("score").isNotNull()).select("ticker", "factor", F.round("score", 9).alias("score"))
    return distribution.with_average_rank(some, ["factor"], "score", "avg_rank").select("ticker", "factor", "avg_rank")


@query("W29_score_percentile", statement("entries", """
    SELECT ticker, CAST(floor(100.0 * (SELECT count(*) FROM entries b WHERE b.final_score <= a.final_score) / (SELECT count(*) FROM entries)) AS BIGINT) AS percentile
    FROM entries a"""))
def _(t):
    e = t.entries.select("ticker", "final_score")
    r = distribution.value_ranks(e, [], "final_score")
    pct = F.floor(100.0 * (F.col("less") + F.col("cnt")) / F.col("n")).cast("long")
    return e.join(r.select("final_score", pct.alias("percentile")), "final_score").select("ticker", "percentile")


@query("W30_score_to_return", statement("entries", """
    SELECT ticker, round(greatest(0.04, least(0.18, 0.11 + (c - mu) / (sd + 1e-8) * (0.14 / 6.0))), 6) AS expected_return
    FROM (SELECT ticker, market, c, avg(c) OVER (PARTITION BY market) AS mu, stddev_pop(c) OVER (PARTITION BY market) AS sd
          FROM (SELECT ticker, market, greatest(lo, least(hi, final_score)) AS c FROM entries JOIN (SELECT market, quantile_cont(final_score, 0.05) AS lo,
                       quantile_cont(final_score, 0.95) AS hi FROM entries GROUP BY market) q USING (market)) w) z"""))
def _(t):
    w = xs.winsorise(t.entries.select("ticker", "market", "final_score"), ["market"], "final_score", 0.05, 0.95, "c")
    s = w.groupBy("market").agg(F.avg("c").alias("mu"), F.stddev_pop("c").alias("sd"))
    z = (F.col("c") - F.col("mu")) / (F.col("sd") + 1e-8)
    back = F.greatest(F.lit(0.04), F.least(F.lit(0.18), 0.11 + z * (0.14 / 6.0)))
    return distribution.attach(w, s, ["market"]).select("ticker", r6(back).alias("expected_return"))


LEVERAGE_SQL = """
    SELECT ticker, cap_tier, row_number() OVER (PARTITION BY cap_tier ORDER BY k DESC, ticker) AS rn
    FROM (SELECT ticker, cap_tier, round(coalesce(adv_usd, 0.0) * (CASE WHEN nb >= 2 AND sb > 0 THEN 1.0 + 0.15 * (CASE WHEN beta IS NULL THEN 0.0 ELSE greatest(-2.0, least(2.0, (beta - mb) / sb)) END)
                 ELSE 1.0 END), 4) AS k
          FROM (SELECT *, count(beta) OVER w AS nb, avg(beta) OVER w AS mb, stddev_pop(beta) OVER w AS sb FROM entries WHERE market_cap BETWEEN 300e6 AND 10e9
                WINDOW w AS (PARTITION BY cap_tier)) a) b"""


@query("W31_leverage_rank", statement("entries", f"SELECT ticker, cap_tier, rn FROM ({LEVERAGE_SQL}) z WHERE rn <= 30"))
def _(t):
    pool = t.entries.where(F.col("market_cap").between(300e6, 10e9))
    ranked = ts.leverage_key(pool, ["cap_tier"])
    w = Window.partitionBy("cap_tier").orderBy(F.desc("leverage_key"), "ticker")
    return ranked.withColumn("rn", F.row_number().over(w)).where("rn <= 30").select("ticker", "cap_tier", F.col("rn").cast("long"))


# --- bars --------------------------------------------------------------------------------

BW = "(PARTITION BY sid ORDER BY d)"
RETURNS_SQL = f"""
    SELECT *, lag(close, 1) OVER w AS c1, lag(close, 12) OVER w AS c12, lag(close, 3) OVER w AS c3,
           avg(volume) OVER (PARTITION BY sid ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v3,
           avg(volume) OVER (PARTITION BY sid ORDER BY d ROWS BETWEEN 14 PRECEDING AND 3 PRECEDING) AS v12,
           count(*) OVER (PARTITION BY sid ORDER BY d ROWS BETWEEN 14 PRECEDING AND 3 PRECEDING) AS k12
    FROM bars WINDOW w AS {BW}"""


@query("W07_price_features", statement("bars", f"""
    SELECT sid, d, round(c1 / c12 - 1, 6) AS ret_12_1, round(close / c1 - 1, 6) AS ret_short, round(close / c3 - 1, 6) AS ret_mid,
           round(CASE WHEN k12 = 12 AND v12 > 0 THEN least(20.0, v3 / v12) ELSE 1.0 END, 6) AS volume_spike FROM ({RETURNS_SQL}) z"""))
def _(t):
    f = ts.price_features(t.bars, far=12, near=1, short=1, mid=3, recent=3, base=12)
    return f.select("sid", "d", *[r6(c).alias(c) for c in ("ret_12_1", "ret_short", "ret_mid", "volume_spike")])


@query("W08_short_returns", statement("daily", """
    SELECT uid, d, round(close / nullif(lag(close, 5) OVER w, 0) - 1, 6) AS return_5d, round(close / nullif(lag(close, 21) OVER w, 0) - 1, 6) AS return_21d
    FROM daily WINDOW w AS (PARTITION BY uid ORDER BY d)"""))
def _(t):
    w = Window.partitionBy("uid").orderBy("d")
    return t.daily_bars.select(
        "uid", "d",
        r6(ratio("close", F.lag("close", 5).over(w)) - 1).alias("return_5d"),
        r6(ratio("close", F.lag("close", 21).over(w)) - 1).alias("return_21d"),
    )


@query("W09_volume_velocity", statement("daily", """
    SELECT uid, d, round(avg(volume) OVER (PARTITION BY uid ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
           / nullif(avg(volume) OVER (PARTITION BY uid ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) - 1, 6) AS velocity FROM daily"""))
def _(t):
    return ts.volume_velocity(t.daily_bars, "uid", 5, 20).select("uid", "d", r6("velocity").alias("velocity"))


BETA_SQL = """
    SELECT sid, d, CASE WHEN count(ra) OVER f >= 12 AND var_pop(rb) OVER f >= 1e-12 THEN covar_pop(ra, rb) OVER f / var_pop(rb) OVER f END AS beta
    FROM (SELECT sid, d, close / lag(close) OVER w - 1 AS ra, bench / lag(bench) OVER w - 1 AS rb
          FROM bars JOIN bench USING (d) WINDOW w AS (PARTITION BY sid ORDER BY d)) r
    WINDOW f AS (PARTITION BY sid ORDER BY d ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""


@query("W11_rolling_beta", statement("bars bench", f"SELECT sid, d, round(beta, 6) AS beta FROM ({BETA_SQL}) z"))
def _(t):
    return ts.rolling_beta(t.bars, t.bench_bars, 12).select("sid", "d", r6("beta").alias("beta"))


@query("J07_aligned_sessions", statement("bars bench", "SELECT sid, count(*) AS sessions, round(sum(close - bench), 4) AS gap FROM bars JOIN bench USING (d) GROUP BY sid"))
def _(t):
    return (
        ts.with_bench(t.bars, t.bench_bars).groupBy("sid")
        .agg(F.count(F.lit(1)).alias("sessions"), F.round(F.sum(F.col("close") - F.col("bench")), 4).alias("gap"))
    )


@query("W17_forward_excess", statement("bars bench", """
    SELECT sid, d, round((lead(close, 3) OVER w / close - 1) - (lead(bench, 3) OVER w / bench - 1), 6) AS fwd_excess
    FROM bars JOIN bench USING (d) WINDOW w AS (PARTITION BY sid ORDER BY d)"""))
def _(t):
    return ts.forward_excess(t.bars, t.bench_bars, 3).select("sid", "d", r6("fwd_excess").alias("fwd_excess"))


@query("W18_momentum_excess", statement("bars bench", """
    SELECT sid, d, round((lag(close, 1) OVER w / lag(close, 12) OVER w - 1) - (lag(bench, 1) OVER w / lag(bench, 12) OVER w - 1), 6) AS mom_excess
    FROM bars JOIN bench USING (d) WINDOW w AS (PARTITION BY sid ORDER BY d)"""))
def _(t):
    return ts.momentum_excess(t.bars, t.bench_bars, 12, 1).select("sid", "d", r6("mom_excess").alias("mom_excess"))


@query("W19_volume_zscore", statement("bars", """
    SELECT sid, d, round(CASE WHEN k < 20 THEN NULL WHEN s <= 1e-12 THEN 0.0 ELSE (volume - m) / s END, 6) AS volume_z
    FROM (SELECT sid, d, volume, count(*) OVER f AS k, avg(volume) OVER f AS m, stddev_pop(volume) OVER f AS s FROM bars
          WINDOW f AS (PARTITION BY sid ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) z"""))
def _(t):
    return ts.volume_zscore(t.bars, 20).select("sid", "d", r6("volume_z").alias("volume_z"))


SAMPLE_SQL = """
    SELECT sid, d, i FROM (SELECT sid, d, row_number() OVER (PARTITION BY sid ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY sid) AS n FROM bars) z
    WHERE n - 1 - 3 - i >= 0 AND (n - 1 - 3 - i) % 3 = 0 AND (n - 1 - 3 - i) // 3 < 52"""


@query("W20_sample_snapshots", statement("bars", SAMPLE_SQL))
def _(t):
    return ts.sample_snapshots(t.bars, step=3, horizon=3, limit=52).select("sid", "d", F.col("i").cast("long"))


@query("W21_point_in_time_rebuild", statement("bars bench", f"""
    SELECT sid, d, round(mom, 6) AS mom_excess, round(CASE WHEN k < 20 THEN NULL WHEN s <= 1e-12 THEN 0.0 ELSE (volume - m) / s END, 6) AS volume_z, round(fwd, 6) AS fwd_excess
    FROM (SELECT sid, d, volume, (lag(close, 1) OVER w / lag(close, 12) OVER w - 1) - (lag(bench, 1) OVER w / lag(bench, 12) OVER w - 1) AS mom,
                 (lead(close, 3) OVER w / close - 1) - (lead(bench, 3) OVER w / bench - 1) AS fwd, count(*) OVER f AS k, avg(volume) OVER f AS m, stddev_pop(volume) OVER f AS s
          FROM bars JOIN bench USING (d) WINDOW w AS (PARTITION BY sid ORDER BY d), f AS (PARTITION BY sid ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) a
    JOIN ({SAMPLE_SQL}) s USING (sid, d)"""))
def _(t):
    return ts.rebuild_snapshots(t.bars, t.bench_bars, far=12, near=1, horizon=3, step=3, limit=52).select(
        "sid", "d", r6("mom_excess").alias("mom_excess"), r6("volume_z").alias("volume_z"), r6("fwd_excess").alias("fwd_excess")
    )


MOVES = """SELECT sid, d, i, x, tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS mdm FROM (
    SELECT sid, d, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS x, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn,
           greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY sid ORDER BY d)) z WHERE i >= 1"""


def wilder_sql(source, keys, p):
    """SQL of the smoothed index: running sums and their mean as discounted sums."""
    k = f"({p - 1} / {p}.0)"
    run = lambda v: f"pow({k}, i) * sum({v} * pow({k}, -greatest(i, {p}))) OVER (PARTITION BY {keys} ORDER BY i ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT {keys}, CASE WHEN max(n) >= {2 * p} THEN sum(dx / {p} * pow({k}, n - {p - 1} - greatest(i - {p - 1}, {p}))) END AS adx FROM (SELECT *, CASE WHEN t > 1e-12 THEN coalesce(100.0 * abs(a - b) / nullif(a + b, 0), 0.0) ELSE 0.0 END AS dx FROM (
        SELECT *, {run('tr')} AS t, {run('pdm')} AS a, {run('mdm')} AS b, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}) s WHERE i >= {p}) q GROUP BY {keys}"""


TECH_VIEWS = {
    "mv": (("bars",), MOVES),
    "win": (("mv",), "SELECT e.sid, e.d AS e, m.i - greatest(e.i - 34, 1) + 1 AS i, m.x, m.tr, m.pdm, m.mdm FROM mv e JOIN mv m ON m.sid = e.sid AND m.i <= e.i AND m.i > e.i - 35"),
    "wrsi": (("win",), """SELECT sid, e, n, sum(greatest(x, 0.0) / 6 * pow(5 / 6.0, n - greatest(i, 6))) AS g, sum(greatest(-x, 0.0) / 6 * pow(5 / 6.0, n - greatest(i, 6))) AS l
        FROM (SELECT *, count(*) OVER (PARTITION BY sid, e) AS n FROM win) z WHERE n >= 12 GROUP BY 1, 2, 3"""),
}


@query("W22_windowed_technicals", statement("win wrsi", f"""
    SELECT sid, e AS d, round(0.5 + (50 - CASE WHEN g = 0 AND l = 0 THEN 50.0 WHEN l = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + g / l) END) / 100, 6) AS rsi_score,
           round(coalesce(greatest(0.0, least(50.0, adx)) / 50, 0.0), 6) AS adx_score FROM wrsi JOIN ({wilder_sql('win', 'sid, e', 6)}) a USING (sid, e)""", extra=TECH_VIEWS))
def _(t):
    return ts.windowed_technicals(t.bars, window=36, period=6).select("sid", "d", r6("rsi_score").alias("rsi_score"), r6("adx_score").alias("adx_score"))


@query("W23_illiquidity_shock", statement("bars", """
    SELECT sid, d, round(CASE WHEN a / nullif(med, 0) >= 1 THEN least(1.0, (a / med - 1) / 2.0) ELSE 0.0 END, 6) AS shock
    FROM (SELECT sid, d, a, k, quantile_cont(CASE WHEN a > 0 THEN a END, 0.5) OVER f AS med
          FROM (SELECT sid, d, row_number() OVER w AS k, coalesce(abs(close / lag(close) OVER w - 1) / nullif(volume * close, 0), 0.0) AS a FROM bars
                WINDOW w AS (PARTITION BY sid ORDER BY d)) r
          WINDOW f AS (PARTITION BY sid ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) z WHERE k >= 21"""))
def _(t):
    return ts.illiquidity(t.bars, 20).select("sid", "d", r6(price.illiquidity_shock("today", "median")).alias("shock"))


RSI_SQL = """
    SELECT sid, CASE WHEN g = 0 AND l = 0 THEN 50.0 WHEN l = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + g / l) END AS rsi
    FROM (SELECT sid, sum(CASE WHEN i <= 14 THEN greatest(x, 0.0) / 14 * pow(13 / 14.0, n - 14) ELSE greatest(x, 0.0) / 14 * pow(13 / 14.0, n - i) END) AS g,
                 sum(CASE WHEN i <= 14 THEN greatest(-x, 0.0) / 14 * pow(13 / 14.0, n - 14) ELSE greatest(-x, 0.0) / 14 * pow(13 / 14.0, n - i) END) AS l
          FROM (SELECT sid, close - lag(close) OVER w AS x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY sid) - 1 AS n FROM bars WINDOW w AS (PARTITION BY sid ORDER BY d)) a
          WHERE i >= 1 AND n >= 14 GROUP BY sid) z"""


@query("W24_rsi_reversal", statement("bars", f"SELECT sid, round(rsi, 6) AS rsi, round(0.5 + (50 - rsi) / 100, 6) AS score FROM ({RSI_SQL}) z"))
def _(t):
    r = ts.rsi(t.bars, 14)
    return r.select("sid", r6("rsi").alias("rsi"), r6(price.rsi_reversion("rsi")).alias("score"))


@query("W25_adx_trend", statement("bars mv", f"""
    SELECT sid, round(adx, 6) AS adx, round(CASE WHEN adx IS NULL THEN 0.0 ELSE greatest(0.0, least(50.0, adx)) / 50 END, 6) AS score FROM (SELECT DISTINCT sid FROM mv) u LEFT JOIN ({wilder_sql('mv', 'sid', 14)}) a USING (sid)""", extra=TECH_VIEWS))
def _(t):
    return ts.adx(t.bars, 14).select("sid", r6("adx").alias("adx"), r6(price.adx_score("adx")).alias("score"))


@query("W26_bench_regime", statement("bench", """
    SELECT d, round(r12, 6) AS r12, round(r3, 6) AS r3, CASE WHEN r3 < -0.20 THEN 'BEAR_CRASH' WHEN r3 < -0.10 THEN 'BEAR_MOMENTUM' WHEN r12 < -0.15 THEN 'BEAR_TREND'
           WHEN r12 > 0.30 THEN 'BULL_STRONG' ELSE 'NORMAL' END AS regime
    FROM (SELECT d, lag(bench, 1) OVER w / lag(bench, 12) OVER w - 1 AS r12, bench / lag(bench, 3) OVER w - 1 AS r3 FROM bench WINDOW w AS (ORDER BY d)) z"""))
def _(t):
    b = ts.bench_returns(t.bench_bars)
    return b.select("d", r6("r12").alias("r12"), r6("r3").alias("r3"), price.bench_regime("r12", "r3").alias("regime"))


@query("W26_name_regime", statement("bars", """
    SELECT sid, d, CASE WHEN r3 < -0.20 THEN 'BEAR_CRASH' WHEN r3 < -0.10 THEN 'BEAR_MOMENTUM' WHEN r12 < -0.15 THEN 'BEAR_TREND' WHEN r12 > 0.30 THEN 'BULL_STRONG' ELSE 'NORMAL' END AS regime
    FROM (SELECT sid, d, lag(close, 1) OVER w / lag(close, 12) OVER w - 1 AS r12, close / lag(close, 3) OVER w - 1 AS r3 FROM bars WINDOW w AS (PARTITION BY sid ORDER BY d)) z"""))
def _(t):
    """The same states for every name's own bars, where all of them occur."""
    w = Window.partitionBy("sid").orderBy("d")
    r12, r3 = ratio(F.lag("close", 1).over(w), F.lag("close", 12).over(w)) - 1, ratio("close", F.lag("close", 3).over(w)) - 1
    return t.bars.select("sid", "d", r12.alias("r12"), r3.alias("r3")).select("sid", "d", price.bench_regime("r12", "r3").alias("regime"))


@query("W27_bench_snapshot", statement("bench", """
    SELECT d, round(bench, 6) AS last, round(r1, 6) AS r1, round(r3, 6) AS r3, round(r12b, 6) AS r12
    FROM (SELECT d, bench, bench / lag(bench, 1) OVER w - 1 AS r1, bench / lag(bench, 3) OVER w - 1 AS r3, bench / lag(bench, 12) OVER w - 1 AS r12b FROM bench WINDOW w AS (ORDER BY d)) z
    ORDER BY d DESC LIMIT 1"""))
def _(t):
    b = ts.bench_returns(t.bench_bars).orderBy(F.desc("d")).limit(1)
    return b.select("d", r6("bench").alias("last"), r6("r1").alias("r1"), r6("r3").alias("r3"), r6("r12_full").alias("r12"))


@query("W28_log_returns", statement("bars", "SELECT sid, d, round(ln(close / lag(close) OVER (PARTITION BY sid ORDER BY d)), 6) + 0.0 AS log_ret FROM bars"))
def _(t):
    w = Window.partitionBy("sid").orderBy("d")
    return t.bars.select("sid", "d", r6(F.log(ratio("close", F.lag("close").over(w)))).alias("log_ret"))
