"""Weighting and composite-score queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import MARKET_MASK, PILLARS, ROUNDTRIP_COST, SIGNED_FACTORS, WEIGHTS, market_mask, weight_table
from ..functions import price, regime
from ..functions.common import lookup, r6, ratio
from ..operators import bundles, composite, ts, xs
from ..operators.distribution import attach
from ..oracles.base import BADGE, FACTORS, statement
from ..oracles.factors import FACTOR_VIEWS, PILLAR_SQL
from .registry import query
from .windows import NEUTRAL_VIEW

c = F.col


def values(name, weights):
    return f"(SELECT v.factor, v.weight::DOUBLE AS weight FROM (VALUES " + ", ".join(f"('{f}', {w})" for f, w in weights.items()) + ") v(factor, weight))"


def w_us(t):
    return weight_table(t.spark, ("US",)).drop("weight_set")


W_US = values("US", WEIGHTS["US"])
MASK_SQL = "(SELECT v.market, v.factor FROM (VALUES " + ", ".join(f"('{m}', '{f}')" for m, fs in MARKET_MASK.items() for f in fs) + ") v(market, factor))"


def dated(t):
    """Entries spread over the months of the volatility series, joined to it."""
    e = t.entries.withColumn("d", F.add_months(F.lit("1995-01-01").cast("date"), (c("pid") % 83).cast("int")))
    return attach(e, t.vix, ["d"])


DATED = {"dated": (("entries", "vix"), "SELECT * FROM (SELECT *, CAST(DATE '1995-01-01' + to_months((pid % 83)::INT) AS DATE) AS d FROM entries) e LEFT JOIN vix USING (d)")}
VOL = "(CASE WHEN vix >= 40 THEN 0.2 WHEN vix >= 30 THEN 0.5 WHEN vix >= 20 THEN 0.8 ELSE 1.0 END)::DOUBLE"
GATE = "(CASE WHEN quality_raw IS NULL THEN 0.375 WHEN quality_raw < 3 THEN 0.0 WHEN quality_raw < 6 THEN 0.6 ELSE 1.0 END)::DOUBLE"


@query("C01_renormalise_mask", statement("ls", f"""
    SELECT ticker, factor, round(CASE WHEN t <= 1e-9 THEN 1.0 / n ELSE a / t END, 6) AS eff_weight
    FROM (SELECT *, sum(a) OVER w AS t, count(*) OVER w AS n FROM (SELECT ticker, factor, CASE WHEN score IS NOT NULL THEN weight ELSE 0.0 END AS a FROM ls JOIN {W_US} x USING (factor)) q
          WINDOW w AS (PARTITION BY ticker)) z"""))
def _(t):
    return composite.renormalise_available(t.long_scores.join(w_us(t), "factor")).select("ticker", "factor", r6("eff_weight").alias("eff_weight"))


@query("C02_dead_factor_weights", statement("ls", f"""
    SELECT factor, round(CASE WHEN rn = 1 THEN g + 1.0 - s ELSE g END, 6) AS eff_weight, live FROM (SELECT *, sum(g) OVER () AS s, row_number() OVER (ORDER BY g DESC, factor) AS rn
    FROM (SELECT factor, live, round(lw + (1.0 - lt) * lw / lt, 6) AS g FROM (SELECT *, sum(lw) OVER () AS lt FROM (
        SELECT factor, coalesce(m, 0) > 0 AS live, CASE WHEN coalesce(m, 0) > 0 THEN weight ELSE 0.0 END AS lw FROM {W_US} x LEFT JOIN (
            SELECT factor, max(abs(coalesce(score, 0.0))) AS m FROM ls WHERE factor NOT IN ('news_buzz', 'congress') GROUP BY factor) l USING (factor)) a) b) d) e"""))
def _(t):
    long = t.long_scores.where(~c("factor").isin("news_buzz", "congress"))
    return composite.redistribute_dead(long, w_us(t), "score").select("factor", r6("eff_weight").alias("eff_weight"), "live")


@query("C03_null_redistribution", statement("ls", f"""
    SELECT ticker, round(sum(score * weight) / nullif(sum(CASE WHEN score IS NOT NULL THEN weight END), 0), 6) AS composite,
           round(sum(CASE WHEN score IS NOT NULL THEN weight ELSE 0.0 END), 6) AS present FROM ls JOIN {W_US} x USING (factor) GROUP BY ticker"""))
def _(t):
    m = composite.weighted_mean(t.long_scores.join(w_us(t), "factor"), ["ticker"], "score")
    return m.select("ticker", r6("composite").alias("composite"), r6("coverage").alias("present"))


@query("C04_market_weights", f"""
    SELECT market, factor, round(w / sum(w) OVER (PARTITION BY market), 6) AS weight FROM (SELECT m.market, x.factor, CASE WHEN k.factor IS NOT NULL THEN weight ELSE 0.0 END AS w
    FROM {W_US} x CROSS JOIN (VALUES ('USA'), ('EUROPE'), ('ASIA')) m(market) LEFT JOIN {MASK_SQL} k ON k.market = m.market AND k.factor = x.factor
    WHERE m.market IN (SELECT CASE p_partkey % 3 WHEN 0 THEN 'USA' WHEN 1 THEN 'EUROPE' ELSE 'ASIA' END FROM part)) z""")
def _(t):
    used = t.parts.select("market").distinct()
    return composite.market_weights(w_us(t), market_mask(t.spark)).join(used, "market", "left_semi").select("market", "factor", r6("weight").alias("weight"))


@query("A37_market_weight_coverage", f"""SELECT market, round(sum(CASE WHEN k.factor IS NOT NULL THEN weight ELSE 0.0 END), 6) AS coverage, max(n) AS names FROM (SELECT market, count(*) AS n FROM (
    SELECT (['USA', 'EUROPE', 'ASIA'])[p_partkey % 3 + 1] AS market FROM part) q GROUP BY market) m CROSS JOIN {W_US} x LEFT JOIN {MASK_SQL} k USING (market, factor) GROUP BY market""")
def _(t):
    names = t.parts.groupBy("market").agg(F.count(F.lit(1)).alias("names"))
    cover = market_mask(t.spark).join(w_us(t), "factor").groupBy("market").agg(F.sum("weight").alias("w"))
    return names.join(cover, "market", "left").select("market", r6(F.coalesce("w", F.lit(0.0))).alias("coverage"), "names")


@query("C05_monitored_composite", statement("neu", f"""
    SELECT ticker, market, round(coalesce(sum(neutral * weight) / nullif(sum(CASE WHEN neutral IS NOT NULL THEN weight END), 0), 0.0), 6) AS composite,
           round(sum(CASE WHEN neutral IS NOT NULL THEN weight ELSE 0.0 END) / sum(weight), 6) AS coverage,
           sum(CASE WHEN neutral IS NOT NULL THEN weight ELSE 0.0 END) / sum(weight) < 0.5 AS low_coverage FROM neu JOIN {W_US} x USING (factor) GROUP BY 1, 2""", extra=NEUTRAL_VIEW))
def _(t):
    m = composite.monitored(xs.neutralise(t.long_scores), w_us(t))
    return m.select("ticker", "market", r6("composite").alias("composite"), r6("coverage").alias("coverage"), "low_coverage")


NORM_SQL = """SELECT pid, ticker, market, factor, score, CASE WHEN mn = 0 AND mx = 0 THEN 0.0 WHEN mn = mx OR hi <= lo THEN 0.5 ELSE (greatest(lo, least(hi, v)) - lo) / (hi - lo) END AS norm
    FROM (SELECT *, CASE WHEN z > 0.9 THEN mn ELSE p5 END AS lo, CASE WHEN z > 0.9 THEN mx ELSE p95 END AS hi FROM (SELECT *, coalesce(score, 0.0) AS v FROM ls) a
          JOIN (SELECT factor, min(coalesce(score, 0.0)) AS mn, max(coalesce(score, 0.0)) AS mx, avg(CASE WHEN coalesce(score, 0.0) = 0 THEN 1 ELSE 0 END) AS z,
                       quantile_cont(coalesce(score, 0.0), 0.05) AS p5, quantile_cont(coalesce(score, 0.0), 0.95) AS p95 FROM ls GROUP BY factor) s USING (factor)) q"""
NORM_VIEW = {"nrm": (("ls",), NORM_SQL)}


def macro_entries(t, index):
    """Entries with the volatility of their date, and the multiplier of the state that the index had then."""
    levels = t.bars.where(c("sid") == index).select("d", c("close").alias("bench"))
    state = ts.bench_returns(levels).select("d", lookup(price.MOMENTUM_MULTIPLIER, price.bench_regime("r12", "r3")).alias("mult"))
    return attach(dated(t), state, ["d"]).select("ticker", "quality_raw", "vix", F.coalesce("mult", F.lit(1.0)).alias("mult"))



# the multiplier of each name's state on its date
STATE_SQL = """SELECT sid, d, CASE WHEN r3 < -0.20 THEN 'BEAR_CRASH' WHEN r3 < -0.10 THEN 'BEAR_MOMENTUM' WHEN r12 < -0.15 THEN 'BEAR_TREND' WHEN r12 > 0.30 THEN 'BULL_STRONG' ELSE 'NORMAL' END AS state
    FROM (SELECT sid, d, lag(close, 1) OVER w / lag(close, 12) OVER w - 1 AS r12, close / lag(close, 3) OVER w - 1 AS r3 FROM bars WINDOW w AS (PARTITION BY sid ORDER BY d)) z"""
MACRO_VIEWS = {**DATED, **NORM_VIEW, "macro": (("dated", "bars"), f"""SELECT ticker, quality_raw, vix, CASE state WHEN 'BEAR_CRASH' THEN 0.3 WHEN 'BEAR_MOMENTUM' THEN 0.55 WHEN 'BEAR_TREND' THEN 0.7 WHEN 'BULL_STRONG' THEN 0.95 ELSE 1.0 END::DOUBLE AS mult
    FROM dated LEFT JOIN (SELECT d, state FROM ({STATE_SQL}) q WHERE sid = 1) r USING (d)""")}
TRADED = f"raw * {VOL} * mult * {GATE}"


@query("C06_traded_composite", statement("nrm macro", f"""
    SELECT ticker, round(raw, 6) AS raw_score, round({TRADED}, 6) AS final_score, {BADGE.format(f'round({TRADED}, 6)')} AS badge
    FROM macro JOIN (SELECT ticker, sum(a / t * norm) AS raw FROM (SELECT *, sum(a) OVER (PARTITION BY ticker) AS t FROM (
        SELECT ticker, norm, CASE WHEN score IS NOT NULL THEN weight ELSE 0.0 END AS a FROM nrm JOIN {W_US} x USING (factor)) y) z GROUP BY ticker) r USING (ticker)""", extra=MACRO_VIEWS))
def _(t):
    """Volatility and momentum state of each entry's own date; the state is that of a single index, here the first name's bars."""
    norm = xs.normalise_factors(t.long_scores, ["factor"])
    out = composite.traded(norm, w_us(t), macro_entries(t, 1), c("vix"), c("mult"))
    return out.select("ticker", r6("raw_score").alias("raw_score"), r6("final_score").alias("final_score"), "badge")


W_INTL = values("I", WEIGHTS["INTL_PROFILE"])


@query("C07_coverage_penalised", statement("ls", f"""
    SELECT ticker, round(raw, 6) AS raw_composite, round(cov, 6) AS coverage, round(raw * least(1.0, cov / 0.70), 6) AS composite, cov < 0.40 AS low_coverage
    FROM (SELECT ticker, coalesce(sum(score * weight) / nullif(sum(CASE WHEN score IS NOT NULL THEN weight END), 0), 0.0) AS raw,
                 sum(CASE WHEN score IS NOT NULL THEN weight ELSE 0.0 END) / sum(weight) AS cov FROM ls JOIN {W_INTL} x USING (factor) WHERE market <> 'USA' GROUP BY ticker) z"""))
def _(t):
    w = weight_table(t.spark, ("INTL_PROFILE",)).drop("weight_set")
    m = composite.coverage_penalised(t.long_scores.where("market <> 'USA'"), w)
    return m.select("ticker", *[r6(k).alias(k) for k in ("raw_composite", "coverage", "composite")], "low_coverage")


SPEC = "(SELECT v.region, v.pillar, v.pw::DOUBLE AS pw, v.factor, v.weight::DOUBLE AS weight, v.dead FROM (VALUES " + ", ".join(
    f"('{r}', '{p}', {pw}, '{f}', {w}, {str(f not in SIGNED_FACTORS).lower()})" for (r, p), (pw, parts) in PILLARS.items() for f, w in parts.items()
) + ") v(region, pillar, pw, factor, weight, dead))"
PILLAR_VIEWS = {
    **FACTOR_VIEWS,
    "plong": (("pin",), " UNION ALL ".join(
        f"SELECT ticker, market, region, sector, cap_tier, quality_raw, '{f}' AS factor, {f} AS score FROM pin" for f in PILLAR_SQL)),
    "pneu": (("plong",), NEUTRAL_VIEW["neu"][1].replace("CASE WHEN score = 0 THEN NULL ELSE score END AS x FROM ls",
             f"CASE WHEN dead AND score = 0 THEN NULL ELSE score END AS x FROM plong JOIN {SPEC} sp USING (region, factor)")),
    "pil": (("pneu",), """
        SELECT ticker, market, region, quality_raw, max(v) FILTER (pillar = 'fundamental') AS fundamental, max(v) FILTER (pillar = 'consensus') AS consensus,
               max(v) FILTER (pillar = 'alternative') AS alternative, sum(p) AS coverage, sum(pw * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN pw END), 0) AS base
        FROM (SELECT ticker, market, region, quality_raw, pillar, pw, sum(neutral * weight) / nullif(sum(CASE WHEN neutral IS NOT NULL THEN weight END), 0) AS v,
                     sum(CASE WHEN neutral IS NOT NULL THEN weight ELSE 0.0 END) AS p FROM pneu GROUP BY ALL) z GROUP BY ALL"""),
    "v3": (("pil",), f"""SELECT *, (CASE WHEN region = 'US' AND alternative IS NOT NULL AND fundamental IS NOT NULL
        THEN greatest(0.0, least(1.0, base + 0.5 * greatest(0.0, alternative - 0.80) * greatest(0.0, fundamental - 0.5))) ELSE base END) * {GATE} AS final_v3,
        coverage < 0.5 OR base IS NULL AS low_coverage FROM pil"""),
}


def pillar_rows(t):
    """Pillar scores of all names, stored once: reports read them many times."""
    return t.stored("pillars", lambda: composite.pillar_scores(pillar_inputs(t), list(PILLAR_SQL)))


def pillar_inputs(t):
    """The wide factor bundle, stored: neutralising it takes several passes."""
    return t.stored("pillar-inputs", lambda: bundles.all_pillar_inputs(t.entries, t.estimates))


@query("C08_pillar_engine", statement("v3", "SELECT ticker, region, " + ", ".join(f"round({k}, 6) AS {k}" for k in ("fundamental", "consensus", "alternative", "coverage")) + ", round(final_v3, 6) AS final_score, low_coverage FROM v3", extra=PILLAR_VIEWS))
def _(t):
    s = composite.pillar_scores(pillar_inputs(t), list(PILLAR_SQL))
    return s.select("ticker", "region", *[r6(k).alias(k) for k in ("fundamental", "consensus", "alternative", "coverage", "final_score")], "low_coverage")


def region_sum(weights, skip=()):
    return " + ".join(f"coalesce({f}, 0.0) * {w}" for f, w in weights.items() if f not in skip and f in FACTORS) or "0.0"


@query("C09_congress_masked_composite", statement("entries", f"""
    SELECT ticker, region, round(greatest(0.0, least(1.0, (CASE region WHEN 'US' THEN {region_sum(WEIGHTS['US'])} WHEN 'EU' THEN {region_sum(WEIGHTS['EU'])} ELSE {region_sum(WEIGHTS['ASIA'])} END)
           * (CASE WHEN quality_raw IS NULL THEN 1.0 WHEN quality_raw < 3 THEN 0.0 WHEN quality_raw < 6 THEN 0.6 ELSE 1.0 END))), 6) AS composite FROM entries"""))
def _(t):
    def total(region):
        return composite.wide_sum({f: w for f, w in WEIGHTS[region].items() if f in FACTORS})

    e = t.entries.withColumn("congress", F.when(c("region") == "US", c("congress")).otherwise(0.0))
    s = F.when(c("region") == "US", total("US")).when(c("region") == "EU", total("EU")).otherwise(total("ASIA"))
    capped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s * regime.quality_gate("quality_raw", 1.0)))
    return e.select("ticker", "region", r6(capped).alias("composite"))


@query("C10_quality_gate", statement("entries", f"SELECT ticker, {GATE} AS gate, (CASE WHEN q IS NULL THEN 1.0 WHEN q < 3 THEN 0.0 WHEN q < 6 THEN 0.6 ELSE 1.0 END)::DOUBLE AS gate_neutral FROM (SELECT *, CASE WHEN pid % 11 <> 0 THEN quality_raw END AS q FROM entries) z"))
def _(t):
    q = F.when(c("pid") % 11 != 0, c("quality_raw"))
    return t.entries.select("ticker", regime.quality_gate("quality_raw").alias("gate"), regime.quality_gate(q, 1.0).alias("gate_neutral"))


@query("C11_vol_multiplier", statement("vix", f"SELECT d, {VOL} AS multiplier FROM vix"))
def _(t):
    return t.vix.select("d", regime.vol_multiplier("vix").alias("multiplier"))


@query("C12_vol_overlay", statement("dated", f"SELECT ticker, d, final_score * {VOL} AS score FROM dated", extra=DATED))
def _(t):
    return dated(t).select("ticker", "d", (c("final_score") * regime.vol_multiplier("vix")).alias("score"))


@query("C13_regime_labels", statement("vix", """
    SELECT d, r AS regime, (CASE r WHEN 'CAPITULATION' THEN 0.5 WHEN 'BEAR' THEN 0.8 WHEN 'NORMAL' THEN 1.0 END)::DOUBLE AS multiplier, r = 'CAPITULATION' AS panic,
           CASE r WHEN 'CAPITULATION' THEN 'panic' WHEN 'BEAR' THEN 'bear' ELSE 'normal' END AS sizing,
           CASE r WHEN 'CAPITULATION' THEN 'CAPITULATION DISTRESSED REGIME / HIGH-QUALITY ANCHORS ONLY' WHEN 'BEAR' THEN 'DEFENSIVE / GRADUATED POSITIONING ACTIVATED' WHEN 'NORMAL' THEN 'NORMAL / FULL POSITIONING' END AS strategy
    FROM (SELECT d, CASE WHEN v IS NULL THEN 'UNKNOWN' WHEN v >= 30 THEN 'CAPITULATION' WHEN v >= 20 THEN 'BEAR' ELSE 'NORMAL' END AS r FROM (SELECT d, CASE WHEN month(d) <> 7 THEN vix END AS v FROM vix) y) z"""))
def _(t):
    v = t.vix.withColumn("vix", F.when(F.month("d") != 7, c("vix")))
    r = regime.regime("vix")
    return v.select(
        "d", r.alias("regime"), regime.regime_multiplier("vix").alias("multiplier"), (r == "CAPITULATION").alias("panic"),
        regime.sizing_regime("vix").alias("sizing"), regime.strategy_label("vix").alias("strategy"),
    )


@query("C14_market_state", statement("vix bench bars", """
    SELECT d, CASE WHEN vix >= 30 THEN 'CAPITULATION' WHEN a IS NULL THEN CASE WHEN vix >= 20 THEN 'BEAR' ELSE 'NEUTRAL' END WHEN vix < 14 AND a >= 0.08 AND coalesce(b, a) >= 0.08 THEN 'EUPHORIA'
           WHEN vix >= 20 OR a <= -0.05 THEN 'BEAR' WHEN a >= 0.02 THEN 'BULL' ELSE 'NEUTRAL' END AS state
    FROM (SELECT d, bench / lag(bench, 3) OVER (ORDER BY d) - 1 AS a FROM bench) x JOIN vix USING (d) LEFT JOIN (SELECT d, close / lag(close, 3) OVER (ORDER BY d) - 1 AS b FROM bars WHERE sid = 1) y USING (d)"""))
def _(t):
    return market_states(t, t.bars.where("sid = 1"))


def market_states(t, second):
    """State per date from volatility, the benchmark and a second index, given as bars."""
    w = Window.partitionBy(F.lit(0)).orderBy("d")
    a = t.bench_bars.select("d", (ratio("bench", F.lag("bench", 3).over(w)) - 1).alias("a"))
    b = second.select("d", (ratio("close", F.lag("close", 3).over(w)) - 1).alias("b"))
    return a.join(t.vix, "d").join(b, "d", "left").select("d", regime.market_state("vix", "a", "b").alias("state"))


@query("C15_contributions", statement("ls", f"SELECT ticker, factor, round(weight * coalesce(score, 0.0), 9) AS contribution, score IS NULL AS unavailable FROM ls JOIN {W_US} x USING (factor)"))
def _(t):
    return composite.contributions(t.long_scores, w_us(t)).select("ticker", "factor", F.round("contribution", 9).alias("contribution"), "unavailable")


W_GLOBAL = values("G", WEIGHTS["GLOBAL"])


@query("C16_weight_source", statement("parts", f"""
    SELECT ticker, count(*) AS n_factors, round(sum(weight), 6) AS total, CASE WHEN market = 'USA' THEN 'US' ELSE 'GLOBAL' END AS source FROM parts
    JOIN (SELECT 'US' AS s, factor, weight FROM {W_US} a UNION ALL SELECT 'GLOBAL', factor, weight FROM {W_GLOBAL} b) w ON s = CASE WHEN market = 'USA' THEN 'US' ELSE 'GLOBAL' END GROUP BY ticker, market"""))
def _(t):
    p = t.parts.withColumn("weight_set", F.when(c("market") == "USA", "US").otherwise("GLOBAL"))
    j = p.join(F.broadcast(weight_table(t.spark, ("US", "GLOBAL"))), "weight_set")  # 23 literal rows
    return j.groupBy("ticker", c("weight_set").alias("source")).agg(F.count(F.lit(1)).alias("n_factors"), r6(F.sum("weight")).alias("total"))


@query("C17_primary_failure_factor", statement("ls", f"""
    SELECT ticker, factor FROM (SELECT ticker, factor, row_number() OVER (PARTITION BY ticker ORDER BY round(weight * coalesce(score, 0.0), 9) DESC, factor) AS rn FROM ls JOIN {W_US} x USING (factor)) z WHERE rn = 1"""))
def _(t):
    k = composite.contributions(t.long_scores, w_us(t))
    best = F.min_by("factor", F.struct(-F.round("contribution", 9), "factor"))
    return k.groupBy("ticker").agg(best.alias("factor"))


LEV_SQL = """round((0.50 * final_score + 0.30 * momentum_long + 0.20 * quality_piotroski) * (CASE WHEN surprise_pct > 0 AND surprise_days > 0 AND surprise_days <= 60 THEN 1.10 ELSE 1.0 END), 6)"""


def smid_pool(entries, n, keys=()):
    boost = F.when((c("surprise_pct") > 0) & (c("surprise_days") > 0) & (c("surprise_days") <= 60), 1.10).otherwise(1.0)
    base = composite.wide_sum({"final_score": 0.50, "momentum_long": 0.30, "quality_piotroski": 0.20})
    pool = entries.where((c("pipeline") == "US") & c("market_cap").between(300e6, 10e9))
    scored = pool.withColumn("leverage_score", F.round(base * boost, 6))
    return scored.orderBy(F.desc("leverage_score"), F.desc("final_score"), "ticker").limit(n)


@query("C18_smid_leverage_pool", statement("entries", f"SELECT ticker, {LEV_SQL} AS leverage_score FROM entries WHERE pipeline = 'US' AND market_cap BETWEEN 300e6 AND 10e9 ORDER BY leverage_score DESC, final_score DESC, ticker LIMIT 3"))
def _(t):
    return smid_pool(t.entries, 3).select("ticker", "leverage_score")


@query("C19_intl_entries", statement("dated", f"SELECT ticker, market, final_score * {VOL} AS final_score, {BADGE.format(f'(final_score * {VOL})')} AS badge, 0.0::DOUBLE AS congress, CASE WHEN market_cap > 0 THEN CASE WHEN market_cap >= 10e9 THEN 'large' WHEN market_cap >= 2e9 THEN 'mid' ELSE 'small' END ELSE 'large' END AS cap_tier FROM dated WHERE market <> 'USA'", extra=DATED))
def _(t):
    s = c("final_score") * regime.vol_multiplier("vix")
    tier = F.when(c("market_cap") > 0, regime.cap_tier("market_cap")).otherwise("large")
    return dated(t).where("market <> 'USA'").select(
        "ticker", "market", s.alias("final_score"), regime.badge(s).alias("badge"), F.lit(0.0).alias("congress"), tier.alias("cap_tier")
    )


@query("C20_roundtrip_cost", statement("entries", "SELECT ticker, (CASE CASE WHEN pid % 13 = 0 THEN 'unknown' ELSE cap_tier END WHEN 'mid' THEN 0.004 WHEN 'small' THEN 0.006 ELSE 0.002 END)::DOUBLE AS cost FROM entries"))
def _(t):
    tier = F.when(c("pid") % 13 == 0, "unknown").otherwise(c("cap_tier"))
    return t.entries.select("ticker", F.coalesce(lookup(ROUNDTRIP_COST, F.lower(tier)), F.lit(ROUNDTRIP_COST["large"])).alias("cost"))


@query("C21_failure_labels", statement("entries", """
    SELECT ticker, CASE WHEN mom_ret <= -0.05 THEN 'STOPPED OUT' WHEN mom_ret <= -0.015 THEN 'MEAN REVERTED' WHEN mom_ret < 0 THEN 'NOISE' ELSE '' END AS label,
           coalesce(surprise_pct < 0 OR surprise_pct < mom_ret * 0.5, false) AS alpha_decay FROM entries"""))
def _(t):
    r = c("mom_ret")
    label = F.when(r <= -0.05, "STOPPED OUT").when(r <= -0.015, "MEAN REVERTED").when(r < 0, "NOISE").otherwise("")
    decayed = F.coalesce((c("surprise_pct") < 0) | (c("surprise_pct") < r * 0.5), F.lit(False))
    return t.entries.select("ticker", label.alias("label"), decayed.alias("alpha_decay"))
