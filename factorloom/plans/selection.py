"""Top-k, rotation, caps, set operations, sizing and exit rules."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ownership, price, regime
from ..functions.common import r6
from ..operators import quality, ranking, research, sizing, ts
from ..oracles.base import BADGE, US, statement
from .aggregates import ADV_SQL, COV_VIEWS, dollar_volume, pools
from .composites import LEV_SQL, W_US, dated, DATED, smid_pool, VOL, w_us
from .joins import BOOST, boosted
from .predicates import LISTS, OFF, REGION, SURVIVES, WHALE, lists, off_desk
from .registry import query
from .windows import LEVERAGE_SQL


def c(name):
    return F.col(name)


N = lambda: F.count(F.lit(1))


def long(name):
    return c(name).cast("long").alias(name)


# --- top-k -------------------------------------------------------------------------------


@query("T01_top_five_lists", statement("entries", """
    SELECT 'all' AS list, ticker, pos FROM (SELECT ticker, row_number() OVER (ORDER BY final_score DESC, ticker) AS pos FROM entries) a WHERE pos <= 5
    UNION ALL SELECT market, ticker, pos FROM (SELECT market, ticker, row_number() OVER (PARTITION BY market ORDER BY final_score DESC, ticker) AS pos FROM entries) b WHERE pos <= 5
    UNION ALL SELECT cap_tier, ticker, pos FROM (SELECT cap_tier, ticker, row_number() OVER (PARTITION BY cap_tier ORDER BY final_score DESC, ticker) AS pos FROM entries) d WHERE pos <= 5"""))
def _(t):
    e = t.entries.select("ticker", "market", "cap_tier", "final_score")
    overall = ranking.top_overall(e, 5).select(F.lit("all").alias("list"), "ticker", long("pos"))
    per = [ranking.top_per(e, [k], 5).select(c(k).alias("list"), "ticker", long("pos")) for k in ("market", "cap_tier")]
    return overall.unionByName(per[0]).unionByName(per[1])


@query("T02_top_per_sector", statement("entries", "SELECT sector, ticker, pos FROM (SELECT sector, ticker, row_number() OVER (PARTITION BY sector ORDER BY final_score DESC, ticker) AS pos FROM entries WHERE sector IN ('ECONOMY', 'LARGE', 'PROMO', 'SMALL')) z WHERE pos <= 3"))
def _(t):
    wanted = t.entries.where(c("sector").isin("ECONOMY", "LARGE", "PROMO", "SMALL"))
    return ranking.top_per(wanted, ["sector"], 3).select("sector", "ticker", long("pos"))


@query("T03_top_covered", statement("entries", "SELECT market, ticker, pos FROM (SELECT market, ticker, row_number() OVER (PARTITION BY market ORDER BY final_score DESC, ticker) AS pos FROM entries WHERE coverage >= 0.65 OR pid % 10 = 0) z WHERE pos <= 20"))
def _(t):
    ok = t.entries.where((c("coverage") >= 0.65) | (c("pid") % 10 == 0))
    return ranking.top_per(ok, ["market"], 20).select("market", "ticker", long("pos"))


@query("T04_portfolio_candidates", statement("entries", "SELECT ticker, final_score FROM entries ORDER BY final_score DESC, ticker LIMIT 20"))
def _(t):
    return ranking.top_overall(t.entries, 20).select("ticker", "final_score")


CAPPED = {**LISTS, "capped": (("lists",), "SELECT *, CASE WHEN row_number() OVER (PARTITION BY bucket, sector ORDER BY final_score DESC, ticker) <= 2 THEN 'primary' ELSE 'overflow' END AS slot FROM lists")}


@query("T05_sector_count_cap", statement("capped", "SELECT bucket, ticker, slot FROM capped", extra=CAPPED))
def _(t):
    return ranking.sector_cap(lists(t), 2, ("bucket",)).select("bucket", "ticker", "slot")


TEN = {"ten": (("parts",), "SELECT ticker, (pid % 5)::INT AS tenure FROM parts WHERE pid % 3 <> 2")}


def tenure(t):
    return t.parts.where("pid % 3 <> 2").select("ticker", (c("pid") % 5).cast("int").alias("tenure"))


def rotation_sql(keys, n, mx, exempt="false"):
    part = f"PARTITION BY {keys}" if keys else ""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", ")) if keys else "true"
    return f"""
    rr AS (SELECT e.*, CASE WHEN {exempt} THEN 0 ELSE coalesce(tenure, 0) END AS ten FROM entries e LEFT JOIN ten USING (ticker)),
    sel AS (SELECT * FROM (SELECT *, row_number() OVER ({part} ORDER BY final_score DESC, ticker) AS rn FROM rr WHERE ten < {mx}) q WHERE rn <= {n}),
    lastsel AS (SELECT * FROM sel WHERE rn = {n}),
    rot AS (SELECT ticker, market, final_score, ten, 'selected' AS action FROM sel UNION ALL SELECT a.ticker, a.market, a.final_score, a.ten, 'cooldown' FROM rr a LEFT JOIN lastsel b ON {on}
            WHERE a.ten >= {mx} AND (b.ticker IS NULL OR a.final_score > b.final_score OR (a.final_score = b.final_score AND a.ticker < b.ticker)))"""


def rotation_statement(keys, n, mx, body, exempt="false"):
    return statement("entries ten", "", extra=TEN) + "," + rotation_sql(keys, n, mx, exempt) + " " + body


@query("T06_cooled_top_n", rotation_statement("market", 20, 3, "SELECT market, ticker, action, ten::BIGINT AS tenure, action = 'selected' AND ten = 0 AS added FROM rot"))
def _(t):
    r = ranking.cooled_top_n(t.entries.select("ticker", "market", "final_score"), tenure(t), 20, 3, ["market"])
    return r.select("market", "ticker", "action", long("tenure"), "added")


@query("T07_cooldown_set", statement("ten", "SELECT ticker, tenure::BIGINT AS tenure FROM ten WHERE tenure >= 3", extra=TEN))
def _(t):
    return tenure(t).where("tenure >= 3").select("ticker", long("tenure"))


@query("T08_tenure_update", rotation_statement("market", 20, 3, "SELECT ticker, CASE WHEN action = 'cooldown' THEN 0 ELSE ten + 1 END::BIGINT AS tenure FROM rot"))
def _(t):
    r = ranking.cooled_top_n(t.entries.select("ticker", "market", "final_score"), tenure(t), 20, 3, ["market"])
    return ranking.update_tenure(tenure(t), r).select("ticker", long("tenure"))


@query("T09_regional_rotation", rotation_statement("market", 15, 3, "SELECT market, ticker, action FROM rot", exempt=WHALE))
def _(t):
    whale = ownership.whale_signal("inst_flow_13f", "npr_spike")
    e = t.entries.select("ticker", "market", "final_score", "inst_flow_13f", "npr_spike")
    return ranking.cooled_top_n(e, tenure(t), 15, 3, ["market"], exempt=whale).select("market", "ticker", "action")


@query("T11_round_robin", statement("uni", """SELECT ticker, suffix, rn FROM (SELECT ticker, CASE WHEN ticker LIKE '%.%' THEN split_part(ticker, '.', 2) ELSE '' END AS suffix, row_number() OVER (PARTITION BY CASE WHEN ticker LIKE '%.%' THEN split_part(ticker, '.', 2) ELSE '' END ORDER BY ticker) AS rn FROM uni) z ORDER BY rn, suffix LIMIT 40"""))
def _(t):
    u = t.universe.withColumn("suffix", quality.suffix("ticker"))
    return ranking.round_robin(u, "suffix", 40).select("ticker", "suffix", long("rn"))


def screen(t, lo=300e6, hi=10e9, min_adv=20000.0):
    """Screened candidates: cap band, volume and dollar-volume gates, one row per ticker."""
    ok = c("market_cap").between(lo, hi) & (c("q_1y") > 0) & (c("adv_usd").isNull() | (c("adv_usd") >= min_adv))
    return t.entries.where(ok)


SCREEN = "market_cap BETWEEN {lo} AND {hi} AND q_1y > 0 AND (adv_usd IS NULL OR adv_usd >= 20000.0)"


@query("T12_balanced_satellite", statement("entries", f"""
    SELECT ticker, cap_tier FROM (SELECT *, row_number() OVER (PARTITION BY cap_tier ORDER BY rn) AS r2 FROM ({LEVERAGE_SQL.replace("WHERE market_cap BETWEEN 300e6 AND 10e9", "WHERE " + SCREEN.format(lo=300e6, hi=10e9) + " AND cap_tier IN ('small', 'mid') AND pid % 4 <> 0")}) k) z
    WHERE (cap_tier = 'small' AND rn <= 15) OR (cap_tier = 'mid' AND rn <= 30 - least(15, (SELECT count(*) FROM entries WHERE {SCREEN.format(lo=300e6, hi=10e9)} AND cap_tier = 'small' AND pid % 4 <> 0)))"""))
def _(t):
    return balanced_satellite(t)


def balanced_satellite(t, k=30):
    """Half the places for small caps by leverage key, the rest for mid caps; names of the core stay out."""
    core = t.parts.where("pid % 4 = 0").select("ticker")
    pool = screen(t).where(c("cap_tier").isin("small", "mid")).join(core, "ticker", "left_anti")
    ranked = ranking.top_per(ts.leverage_key(pool, ["cap_tier"]), ["cap_tier"], k, "leverage_key")
    ranked = ranked.select("ticker", "cap_tier", "pos")
    small = ranked.where("cap_tier = 'small'").where(c("pos") <= k // 2)
    n_small = small.agg(N()).scalar()
    mid = ranked.where("cap_tier = 'mid'").where(c("pos") <= F.lit(k) - n_small)
    return small.unionByName(mid).select("ticker", "cap_tier")


@query("T13_screen", statement("entries", f"SELECT ticker, CASE WHEN market_cap < 2e9 THEN 'small' ELSE 'mid' END AS tier FROM entries WHERE {SCREEN.format(lo=300e6, hi=10e9)}"))
def _(t):
    return screen(t).select("ticker", F.when(c("market_cap") < 2e9, "small").otherwise("mid").alias("tier"))


@query("T13_large_mid_screen", statement("entries", "SELECT ticker FROM entries WHERE market_cap >= 2e9 AND market = 'EUROPE'"))
def _(t):
    return t.entries.where("market_cap >= 2e9 AND market = 'EUROPE'").select("ticker")


@query("T13_volume_panel", statement("daily", "SELECT d, sum(volume)::BIGINT AS total, count(*) AS names, max(CASE WHEN uid = 7 THEN volume END)::BIGINT AS v7 FROM daily GROUP BY d"))
def _(t):
    return t.daily_bars.groupBy("d").agg(F.sum("volume").alias("total"), N().alias("names"), F.max(F.when(c("uid") == 7, c("volume"))).alias("v7"))


DESK = ["top_buys_usa", "top_buys", "mid_caps", "small_caps"]
PRIO = "CASE bucket " + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(DESK, 1)) + " END"


@query("T14_desk_fill", statement("lists", f"SELECT ticker, bucket, final_score FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY {PRIO}, pos) AS rn FROM lists WHERE {PRIO} IS NOT NULL) z WHERE rn = 1 AND NOT {OFF}", extra=LISTS))
def _(t):
    d = ranking.first_bucket_wins(lists(t), DESK).where(~off_desk())
    return d.orderBy(*ranking.order_by_score()).select("ticker", "bucket", "final_score")


@query("T14_score_population", statement("lists", "SELECT count(*) AS n, count(DISTINCT ticker) AS names, round(avg(final_score), 9) AS mean FROM lists", extra=LISTS))
def _(t):
    return lists(t).agg(N().alias("n"), F.countDistinct("ticker").alias("names"), F.round(F.avg("final_score"), 9).alias("mean"))


@query("T15_sector_heat", statement("entries", "SELECT sector, pos, ticker FROM (SELECT sector, ticker, row_number() OVER (PARTITION BY sector ORDER BY final_score DESC, ticker) AS pos FROM entries) z WHERE pos <= 2"))
def _(t):
    return ranking.top_per(t.entries.select("sector", "ticker", "final_score"), ["sector"], 2).select("sector", long("pos"), "ticker")


@query("T16_driver_strip", statement("ls", f"""
    SELECT ticker, string_agg(factor, '|' ORDER BY k) FILTER (ok AND k <= 4) AS drivers, string_agg(factor, '|' ORDER BY k) FILTER (NOT ok AND k <= 2) AS gaps FROM (
        SELECT ticker, factor, score IS NOT NULL AS ok, row_number() OVER (PARTITION BY ticker, score IS NOT NULL ORDER BY round(CASE WHEN score IS NOT NULL THEN weight * score ELSE weight END, 9) DESC, factor) AS k FROM ls JOIN {W_US} x USING (factor)) z GROUP BY ticker"""))
def _(t):
    from ..operators import composite

    k = composite.contributions(t.long_scores, w_us(t))
    key = F.round(F.when(c("unavailable"), c("weight")).otherwise(c("contribution")), 9)
    w = Window.partitionBy("ticker", "unavailable").orderBy(F.desc("key"), "factor")
    r = k.withColumn("key", key).withColumn("k", F.row_number().over(w))

    def strip(missing, n):
        part = F.sort_array(F.collect_list(F.when((c("unavailable") == missing) & (c("k") <= n), F.struct("k", "factor"))))
        return F.nullif(F.array_join(F.transform(part, lambda s: s["factor"]), "|"), F.lit(""))

    return r.groupBy("ticker").agg(strip(False, 4).alias("drivers"), strip(True, 2).alias("gaps"))


# --- set operations ------------------------------------------------------------------------

SAT = "SELECT ticker, sector, cap_tier, 'satellite' AS origin FROM entries WHERE final_score >= 0.70"
CORE = "SELECT ticker, sector, cap_tier, 'core' AS origin FROM entries WHERE cap_tier = 'large'"


def core_and_satellite(t):
    cols = ["ticker", "sector", "cap_tier"]
    core = t.entries.where("cap_tier = 'large'").select(*cols, F.lit("core").alias("origin"))
    sat = t.entries.where("final_score >= 0.70").select(*cols, F.lit("satellite").alias("origin"))
    return core, sat


def merge_universe(core, satellite):
    """Core rows, then satellite rows whose ticker the core does not have."""
    return core.unionByName(satellite.join(core.select("ticker"), "ticker", "left_anti"))


@query("U01_merge_universe", statement("entries", f"SELECT * FROM ({CORE}) a UNION ALL SELECT * FROM ({SAT}) b WHERE ticker NOT IN (SELECT ticker FROM ({CORE}) d)"))
def _(t):
    return merge_universe(*core_and_satellite(t))


U02_SQL = f"SELECT ticker, 'core' AS origin FROM entries WHERE cap_tier = 'large' AND region = 'EU' UNION ALL SELECT ticker, 'satellite' FROM entries WHERE final_score >= 0.70 AND region = 'EU' AND cap_tier <> 'large' UNION ALL SELECT ticker, 'smid' FROM entries WHERE {SCREEN.format(lo=300e6, hi=2e9)} AND region = 'EU' AND cap_tier <> 'large' AND final_score < 0.70"


@query("U02_resolve_universe", statement("entries", U02_SQL))
def _(t):
    eu = t.entries.where("region = 'EU'")
    core = eu.where("cap_tier = 'large'").select("ticker", F.lit("core").alias("origin"))
    sat = eu.where("final_score >= 0.70").select("ticker", F.lit("satellite").alias("origin"))
    smid = screen(t, hi=2e9).where("region = 'EU'").select("ticker", F.lit("smid").alias("origin"))
    return merge_universe(merge_universe(core, sat), smid)


@query("U03_satellite_tickers", statement("entries", f"""SELECT ticker FROM (SELECT ticker, row_number() OVER (ORDER BY coalesce(adv_usd, 0.0) DESC, ticker) AS rn FROM entries WHERE {SCREEN.format(lo=300e6, hi=10e9)} AND cap_tier = 'small' AND pid % 4 <> 0) z WHERE rn <= 15"""))
def _(t):
    core = t.parts.where("pid % 4 = 0").select("ticker")
    pool = screen(t).where("cap_tier = 'small'").join(core, "ticker", "left_anti").withColumn("adv", F.coalesce("adv_usd", F.lit(0.0)))
    return ranking.top_overall(pool, 15, "adv").select("ticker")


@query("U04_build_region", statement("bars uni", f"""
    SELECT ticker, cap_tier, round(adv, 4) AS adv FROM (SELECT DISTINCT sid, ticker, cap_tier FROM uni WHERE market_cap >= 2e9 AND ({REGION.format('ticker')} = 'EU' OR sid % 5 = 0)) u JOIN ({ADV_SQL}) a USING (sid) WHERE {REGION.format('ticker')} = 'EU' AND adv >= 100000.0"""))
def _(t):
    u = t.universe.where("market_cap >= 2e9").select("sid", "ticker", "cap_tier")
    screened = u.where(quality.region_of("ticker") == "EU")
    registry = u.where("sid % 5 = 0")
    candidates = merge_universe(screened, registry).where(quality.region_of("ticker") == "EU")
    built = candidates.join(dollar_volume(t.bars), "sid").where("adv >= 100000.0")
    return built.orderBy(F.desc("adv"), "ticker").select("ticker", "cap_tier", F.round("adv", 4).alias("adv"))


@query("U05_first_bucket_wins", statement("lists", f"SELECT ticker, bucket, pos FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY {PRIO}, pos) AS rn FROM lists WHERE {PRIO} IS NOT NULL) z WHERE rn = 1", extra=LISTS))
def _(t):
    return ranking.first_bucket_wins(lists(t), DESK).select("ticker", "bucket", long("pos"))


@query("U06_all_entries", statement("lists", "SELECT DISTINCT bucket, ticker FROM lists", extra=LISTS))
def _(t):
    return lists(t).dropDuplicates(["bucket", "ticker"]).select("bucket", "ticker")


PAYLOAD = {
    **DATED,
    "gated": (("entries",), f"SELECT *, CASE WHEN market = 'USA' THEN final_score ELSE final_score * 0.8 END AS s FROM entries"),
    "p0": (("gated",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY s DESC, ticker) AS pos FROM gated) z WHERE pos <= 20"),
    "p1": (("p0",), "SELECT *, CASE WHEN row_number() OVER (PARTITION BY market, sector ORDER BY s DESC, ticker) <= 2 THEN 'primary' ELSE 'overflow' END AS slot FROM p0"),
}


def combined_payload(entries, vix):
    """US, Europe and Asia lists after the regime gate and the sector cap, plus the small/mid sleeve.

    In capitulation every survivor moves to the watchlist instead.
    """
    intl = c("market") != "USA"
    gated = entries.withColumn("final_score", F.when(intl, c("final_score") * regime.vol_multiplier(F.lit(vix))).otherwise(c("final_score")))
    if vix >= 30:
        alive = gated.where(regime.survives_capitulation("beta", "de", "quality_piotroski"))
        top = ranking.top_per(alive, ["market"], 20)
        return top.select(F.lit("watchlist").alias("bucket"), "market", "ticker", "final_score")
    capped = ranking.sector_cap(ranking.top_per(gated, ["market"], 20), 2, ("market",))
    name = F.concat(F.when(c("slot") == "primary", "top_buys_").otherwise("overflow_"), F.lower("market"))
    desks = capped.select(name.alias("bucket"), "market", "ticker", "final_score")
    sleeve = smid_pool(gated, 3).select(F.lit("top_buys_smid").alias("bucket"), "market", "ticker", "final_score")
    return desks.unionByName(sleeve)


@query("U07_combined_payload", statement("p1 gated", f"""
    SELECT CASE slot WHEN 'primary' THEN 'top_buys_' ELSE 'overflow_' END || lower(market) AS bucket, market, ticker, s AS final_score FROM p1
    UNION ALL SELECT 'top_buys_smid', market, ticker, s FROM (SELECT * FROM gated WHERE pipeline = 'US' AND market_cap BETWEEN 300e6 AND 10e9 ORDER BY {LEV_SQL} DESC, final_score DESC, ticker LIMIT 3) x""", extra=PAYLOAD))
def _(t):
    return combined_payload(t.entries, 25.0)


@query("U07_capitulation_payload", statement("entries", f"""SELECT 'watchlist' AS bucket, market, ticker, s AS final_score FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY s DESC, ticker) AS pos FROM (
    SELECT *, CASE WHEN market = 'USA' THEN final_score ELSE final_score * 0.5 END AS s FROM entries) g WHERE {SURVIVES}) z WHERE pos <= 20"""))
def _(t):
    return combined_payload(t.entries, 35.0)


@query("U08_single_name", statement("dated", f"SELECT ticker, market, CASE WHEN market = 'USA' THEN 'US' ELSE 'INTL' END AS pipeline, final_score * {VOL} AS final_score, {BADGE.format(f'(final_score * {VOL})')} AS badge, 'absolute' AS scoring_mode FROM dated WHERE ticker = 'P7.PA'", extra=DATED))
def _(t):
    s = c("final_score") * regime.vol_multiplier("vix")
    one = dated(t).where("ticker = 'P7.PA'")
    return one.select("ticker", "market", "pipeline", s.alias("final_score"), regime.badge(s).alias("badge"), F.lit("absolute").alias("scoring_mode"))


@query("U10_merge_markets", statement("entries", "SELECT market, count(*) AS n FROM entries GROUP BY market"))
def _(t):
    legs = [t.entries.where(c("market") == m).select("market", "ticker") for m in ("USA", "EUROPE", "ASIA")]
    return legs[0].unionByName(legs[1]).unionByName(legs[2]).groupBy("market").agg(N().alias("n"))


@query("S19_promotion_log", statement("boosted", """SELECT ticker, br AS boosted_rank, sr AS shadow_rank, round(boosted - final_score, 6) AS score_delta FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY boosted DESC, ticker) AS br, row_number() OVER (PARTITION BY market ORDER BY final_score DESC, ticker) AS sr FROM boosted) z
    WHERE br <= 20 AND boost > 0 AND sr > br""".replace("AS shadow_rank", "AS shadow_rank"), extra=BOOST))
def _(t):
    rows = t.stored("boosted", lambda: boosted(t).select("ticker", "pid", "market", "final_score", "boosted", "boost"))
    after = ranking.top_per(rows, ["market"], 20, "boosted", "boosted_rank").where("boost > 0")
    listed = after.select("market", "ticker", "final_score", "boosted", "boosted_rank", "boost")
    # At most 20 listed names per market: broadcast, and count for each the rows that rank before it.
    mine = F.broadcast(listed.select("market", c("ticker").alias("t"), c("final_score").alias("s")))
    ahead = (c("final_score") > c("s")) | ((c("final_score") == c("s")) & (c("ticker") < c("t")))
    before = rows.join(mine, "market").where(ahead).groupBy("market", c("t").alias("ticker")).agg(N().alias("before"))
    j = listed.join(before, ["market", "ticker"], "left").withColumn("shadow_rank", F.coalesce("before", F.lit(0)) + 1).where("shadow_rank > boosted_rank")
    return j.select("ticker", long("boosted_rank"), long("shadow_rank"), r6(c("boosted") - c("final_score")).alias("score_delta"))


# --- exits and sizing ------------------------------------------------------------------------


@query("X01_stop_floor", statement("entries", "SELECT ticker, round(CASE WHEN px <> 0 AND atr <> 0 THEN px - 2.5 * atr END, 6) AS floor FROM entries"))
def _(t):
    return t.entries.select("ticker", r6(price.stop_floor("px", "atr")).alias("floor"))


@query("X02_target_signal", statement("entries", "SELECT ticker, round(u * 100, 6) AS upside_pct, coalesce(u BETWEEN 0 AND 0.05, false) AS take_profit FROM (SELECT ticker, CASE WHEN target_price > 0 AND px > 0 THEN (target_price - px) / px END AS u FROM entries) z"))
def _(t):
    s = t.entries.select("ticker", price.target_signal("px", "target_price").alias("s"))
    return s.select("ticker", r6("s.upside_pct").alias("upside_pct"), c("s.take_profit_alert").alias("take_profit"))


BREAK = "CASE WHEN target_price <> 0 AND px > target_price AND rsi > 50 AND vwap_ratio * 1.1 > 1 THEN target_price + 1.5 * coalesce(atr, 0.0) END"


@query("X03_breakout_extension", statement("entries", f"SELECT ticker, round({BREAK}, 6) AS extended_target FROM entries"))
def _(t):
    return t.entries.select("ticker", r6(price.breakout_target("px", "target_price", "atr", "rsi", c("vwap_ratio") * 1.1)).alias("extended_target"))


@query("X04_exit_anchors", statement("entries", f"""SELECT ticker, atr AS atr_14, round(CASE WHEN px <> 0 AND atr <> 0 THEN px - 2.5 * atr END, 6) AS batch_floor, round((target_price - px) / px * 100, 6) AS upside_pct,
    ({BREAK}) IS NOT NULL AS breakout_extension, round({BREAK}, 6) AS extended_target FROM entries WHERE px > 0"""))
def _(t):
    a = t.entries.where("px > 0").select("ticker", price.exit_anchors("px", "target_price", "atr", "rsi", c("vwap_ratio") * 1.1).alias("a"))
    return a.select("ticker", c("a.atr_14"), r6("a.batch_floor").alias("batch_floor"), r6("a.upside_pct").alias("upside_pct"), "a.breakout_extension", r6("a.extended_target").alias("extended_target"))


@query("X05_equal_anchors", statement("entries", "SELECT ticker, market, round(1.0 / count(*) OVER (PARTITION BY market), 8) AS weight FROM entries WHERE market_cap > 10e9"))
def _(t):
    return sizing.equal_anchors(t.entries.select("ticker", "market", "market_cap"), ["market"]).select("ticker", "market", F.round("weight", 8).alias("weight"))


def covariance(t):
    r = research.two_bar_returns(t.bars, pools(t).select("sid", "pool", "slot"))
    return t.stored("covariance", lambda: research.shrunk_covariance(r))


@query("X06_inverse_vol", statement("pcov", "SELECT pool, i AS slot, round((1 / greatest(1e-8, sqrt(cov))) / sum(1 / greatest(1e-8, sqrt(cov))) OVER (PARTITION BY pool), 8) AS weight FROM pcov WHERE i = j", extra=COV_VIEWS))
def _(t):
    v = covariance(t).where("i = j").select("pool", c("i").alias("slot"), "cov")
    return sizing.inverse_vol(v, ["pool"]).select("pool", long("slot"), F.round("weight", 8).alias("weight"))


TOP20 = {"top20": (("entries",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY final_score DESC, ticker) AS pos FROM entries) z WHERE pos <= 20")}
PROP = "least(0.10, final_score / sum(final_score) OVER (PARTITION BY market))"


def top20(t):
    return ranking.top_per(t.entries, ["market"], 20)


@query("X07_score_proportional", statement("top20", f"SELECT ticker, round(k / sum(k) OVER (PARTITION BY market), 8) AS weight FROM (SELECT *, {PROP} AS k FROM top20) z", extra=TOP20))
def _(t):
    return sizing.score_proportional(top20(t), ["market"]).select("ticker", F.round("weight", 8).alias("weight"))


SEC = {**TOP20, "sec": (("top20",), f"""SELECT *, CASE WHEN tot > 0.30 + 1e-8 THEN w * 0.30 / tot ELSE w END AS w2 FROM (SELECT *, sum(w) OVER (PARTITION BY market, sector) AS tot FROM (SELECT *, k / sum(k) OVER (PARTITION BY market) AS w FROM (SELECT *, {PROP} AS k FROM top20) a) b) d""")}


@query("X08_sector_cap", statement("sec", "SELECT ticker, round(w2, 8) AS weight FROM sec", extra=SEC))
def _(t):
    return sizing.cap_sectors(sizing.score_proportional(top20(t), ["market"]), ["market"]).select("ticker", F.round("weight", 8).alias("weight"))


@query("X09_liquidity_ceiling", statement("sec", "SELECT ticker, round(kk / sum(kk) OVER (PARTITION BY market), 8) AS weight FROM (SELECT *, CASE WHEN adv_usd > 0 THEN least(w2, least(0.10, 0.03 * adv_usd / 100000.0)) ELSE w2 END AS kk FROM sec) z", extra=SEC))
def _(t):
    w = sizing.cap_sectors(sizing.score_proportional(top20(t), ["market"]), ["market"]).withColumn("adv", c("adv_usd"))
    return sizing.cap_liquidity(w, ["market"], F.lit(100000.0)).select("ticker", F.round("weight", 8).alias("weight"))


@query("X10_vol_target", statement("pcov", """WITH w AS (SELECT pool, i AS slot, (1 / greatest(1e-8, sqrt(cov))) / sum(1 / greatest(1e-8, sqrt(cov))) OVER (PARTITION BY pool) AS weight FROM pcov WHERE i = j),
    v AS (SELECT pool, sqrt(sum(a.weight * b.weight * cov) + 1e-10) AS vol FROM pcov JOIN w a USING (pool) JOIN w b USING (pool) WHERE a.slot = i AND b.slot = j GROUP BY pool)
    SELECT pool, slot, round(weight * least(1.0, 0.10 / vol), 8) AS weight FROM w JOIN v USING (pool)""".replace("WITH w AS", "SELECT * FROM (WITH w AS") + ") z", extra=COV_VIEWS))
def _(t):
    cov = covariance(t)
    w = sizing.inverse_vol(cov.where("i = j").select("pool", c("i").alias("slot"), "cov"), ["pool"]).withColumn("vix", F.lit(25.0))
    vol = sizing.portfolio_vol(w, cov, ["pool"])
    return sizing.target_volatility(w, vol, ["pool"]).select("pool", long("slot"), F.round("weight", 8).alias("weight"))


SIZE = {
    "sp": (("snaps", "vix"), """SELECT *, lead(1) OVER (PARTITION BY market, d ORDER BY pos) AS nx FROM (SELECT *, row_number() OVER (PARTITION BY d, market ORDER BY score DESC, ticker) AS pos FROM snaps JOIN vix USING (d)) z WHERE pos <= 10"""),
    "sw": (("sp",), """SELECT *, CASE WHEN tot > 0.30 + 1e-8 THEN w * 0.30 / tot ELSE w END AS w2 FROM (SELECT *, sum(w) OVER (PARTITION BY d, market, sector) AS tot FROM (SELECT *, k / sum(k) OVER (PARTITION BY d, market) AS w FROM (
        SELECT *, least(0.10, score / sum(score) OVER (PARTITION BY d, market)) AS k FROM sp) a) b) q"""),
}


@query("X11_sizing_all_dates", statement("sw", """SELECT d, market, ticker, round(w2 * least(1.0, CASE WHEN vix >= 30 THEN 0.05 WHEN vix >= 20 THEN 0.10 ELSE 0.15 END / sqrt(v + 1e-10)), 8) AS weight
    FROM (SELECT *, sum(0.04 * w2 * w2) OVER (PARTITION BY d, market) AS v FROM sw) z""", extra=SIZE))
def _(t):
    top = ranking.top_per(t.snaps, ["d", "market"], 10, "score").join(t.vix, "d")
    return sizing_run(top, ["d", "market"], "score").select("d", "market", "ticker", F.round("weight", 8).alias("weight"))


def sizing_run(top, keys, score):
    """All pools of all dates in one job: proportional weights, sector cap, volatility target on the default 4 % variance."""
    w = sizing.cap_sectors(sizing.score_proportional(top, keys, score), keys)
    vol = w.groupBy(*keys).agg(F.sqrt(F.sum(0.04 * c("weight") * c("weight")) + 1e-10).alias("vol"))
    return sizing.target_volatility(w, vol, keys)
