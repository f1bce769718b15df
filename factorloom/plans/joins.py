"""Join queries: fallback symbols, as-of, nth bar, shadow merges."""

import datetime as dt

from pyspark.sql import functions as F

from ..config import REGION_MARKET, ROUNDTRIP_COST
from ..functions import price, regime
from ..functions.common import lookup, r6, ratio
from ..operators import events, joins, quality, research, scan, ts
from ..operators.distribution import attach
from ..oracles.base import BADGE, clip, flow13f, statement
from ..views import count_when
from .composites import PILLAR_VIEWS, pillar_rows
from .predicates import REGION
from .registry import query


def c(name):
    return F.col(name)


def fallback_inputs(t):
    """A universe with shared bases, and bulk rows keyed by exact, bare, foreign and lower-case symbols."""
    m, q, r = c("pid") % 8, F.concat(F.lit("Q"), F.floor(c("pid") / 8).cast("string")), F.concat(F.lit("R"), c("pid").cast("string"))
    uni = t.parts.select("pid", F.when(m == 0, F.concat(q, F.lit(".PA"))).when(m == 1, F.concat(q, F.lit(".T"))).otherwise(F.concat(r, F.lit(".PA"))).alias("ticker"))
    symbol = (
        F.when(m == 0, q).when(m == 1, F.concat(q, F.lit(".T"))).when(m == 2, F.concat(r, F.lit(".PA"))).when(m == 3, r)
        .when(m == 4, F.concat(r, F.lit(".XX"))).when(m == 5, F.lower(F.concat(r, F.lit(".pa")))).when(m == 6, "")
    )
    bulk = t.parts.select(c("pid").alias("row_id"), symbol.alias("symbol")).where("symbol IS NOT NULL")
    return uni, bulk


FALL = {
    "funi": ((), "SELECT p_partkey AS pid, CASE p_partkey % 8 WHEN 0 THEN 'Q' || p_partkey // 8 || '.PA' WHEN 1 THEN 'Q' || p_partkey // 8 || '.T' ELSE 'R' || p_partkey || '.PA' END AS ticker FROM part"),
    "fbulk": ((), """SELECT p_partkey AS row_id, upper(CASE p_partkey % 8 WHEN 0 THEN 'Q' || p_partkey // 8 WHEN 1 THEN 'Q' || p_partkey // 8 || '.T' WHEN 2 THEN 'R' || p_partkey || '.PA' WHEN 3 THEN 'R' || p_partkey
        WHEN 4 THEN 'R' || p_partkey || '.XX' WHEN 5 THEN 'r' || p_partkey || '.pa' END) AS sym FROM part WHERE p_partkey % 8 < 6"""),
}


@query("J02_fallback_join", statement("funi fbulk", """
    SELECT u.ticker, coalesce(e.row_id, CASE WHEN s.k = 1 THEN b.row_id END) AS row_id FROM funi u JOIN (SELECT split_part(ticker, '.', 1) AS base, count(*) AS k FROM funi GROUP BY 1) s ON s.base = split_part(u.ticker, '.', 1)
    LEFT JOIN fbulk e ON e.sym = u.ticker LEFT JOIN fbulk b ON b.sym = s.base AND b.sym NOT LIKE '%.%'""", extra=FALL))
def _(t):
    uni, bulk = fallback_inputs(t)
    return joins.fallback_join(uni, bulk).select("ticker", "row_id")


@query("J03_symbol_index", statement("fbulk", """
    SELECT sym AS key, row_id FROM fbulk UNION ALL SELECT base, max(row_id) FROM (SELECT split_part(sym, '.', 1) AS base, row_id FROM fbulk WHERE sym LIKE '%.%') b
    WHERE base NOT IN (SELECT sym FROM fbulk) GROUP BY base HAVING count(*) = 1""", extra=FALL))
def _(t):
    return joins.bulk_index(fallback_inputs(t)[1]).select("key", "row_id")


@query("J04_base_symbol", statement("parts", "SELECT ticker, upper(split_part(ticker, '.', 1)) AS base FROM parts"))
def _(t):
    return t.parts.select("ticker", joins.base_symbol("ticker").alias("base"))


FACTS = {"facts": (("parts",), """SELECT CASE WHEN pid % 2 = 0 THEN ticker ELSE split_part(ticker, '.', 1) END AS symbol, d, value_c, insider_id, l_orderkey AS ok, l_linenumber AS ln
    FROM (SELECT l_partkey AS pid, CAST(l_shipdate AS DATE) AS d, CAST(round(l_extendedprice * 100) AS BIGINT) AS value_c, l_suppkey AS insider_id, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 5 <> 0) x JOIN parts USING (pid)""")}


def symbol_facts(t):
    """Rows of a keyed input; half of the names are keyed by their base symbol, a fifth have none."""
    li = t.lineitem.where("l_partkey % 5 <> 0").select(
        c("l_partkey").alias("pid"), F.to_date("l_shipdate").alias("d"), F.round(c("l_extendedprice") * 100).cast("long").alias("value_c"),
        c("l_orderkey").alias("ok"), c("l_linenumber").alias("ln"),
    )
    symbol = F.when(c("pid") % 2 == 0, c("ticker")).otherwise(joins.base_symbol("ticker"))
    return li.join(t.parts.select("pid", "ticker"), "pid").select(symbol.alias("symbol"), "d", "value_c", "ok", "ln")


@query("J05_symbol_candidates", statement("parts facts", """
    SELECT p.ticker, coalesce(a.symbol, b.symbol) AS symbol FROM parts p LEFT JOIN (SELECT DISTINCT symbol FROM facts) a ON a.symbol = p.ticker LEFT JOIN (SELECT DISTINCT symbol FROM facts) b ON b.symbol = split_part(p.ticker, '.', 1)""", extra=FACTS))
def _(t):
    known = symbol_facts(t).select("symbol").distinct()
    j = joins.symbol_candidates(t.parts.select("ticker")).join(known, "symbol")
    best = j.groupBy("ticker").agg(F.min_by("symbol", "prio").alias("symbol"))
    return t.parts.select("ticker").join(best, "ticker", "left")


@query("S24_newest_rows_per_key", statement("parts facts", """
    SELECT p.ticker, f.symbol, f.d, f.value_c, f.rn FROM parts p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC, ok DESC, ln DESC, value_c DESC) AS rn FROM facts) f
    ON f.rn <= 4 AND f.symbol = CASE WHEN p.ticker IN (SELECT symbol FROM facts) THEN p.ticker ELSE split_part(p.ticker, '.', 1) END""", extra=FACTS))
def _(t):
    order = [F.desc("d"), F.desc("ok"), F.desc("ln"), F.desc("value_c")]
    return joins.newest_by_candidate(t.parts.select("ticker"), symbol_facts(t), order, 4).select("ticker", "symbol", "d", "value_c", c("rn").cast("long"))


@query("J06_asof_filing", """
    WITH f AS (SELECT o_custkey AS cid, CAST(o_orderdate AS DATE) AS filing_date, arg_max(o_totalprice, o_orderkey) AS amount FROM orders GROUP BY 1, 2),
         g AS (SELECT c_custkey AS cid, unnest(generate_series(TIMESTAMP '1995-03-01', TIMESTAMP '2001-07-01', INTERVAL 2 MONTH))::DATE AS snapshot FROM customer)
    SELECT g.cid, g.snapshot, f.filing_date, f.amount FROM g ASOF LEFT JOIN f ON g.cid = f.cid AND g.snapshot >= f.filing_date""")
def _(t):
    filings = joins.newest_per_day(
        t.orders.select(c("o_custkey").alias("cid"), F.to_date("o_orderdate").alias("filing_date"), "o_orderkey", c("o_totalprice").alias("amount")),
        "cid", "filing_date", "o_orderkey", "amount",
    )
    days = F.sequence(F.lit(dt.date(1995, 3, 1)), F.lit(dt.date(2001, 7, 1)), F.expr("INTERVAL 2 MONTHS"))
    grid = joins.spread(t.customer.select(c("c_custkey").alias("cid")), 39).select("cid", F.explode(days).alias("snapshot"))
    return joins.asof_join(grid, filings, "cid", "snapshot", "filing_date", "amount").select("cid", "snapshot", "filing_date", "amount")


PAIRED = """SELECT ticker, price, CASE WHEN ticker LIKE '%.L' AND target / price BETWEEN 0.005 AND 0.02 THEN target * 100.0 WHEN ticker LIKE '%.L' AND target / price BETWEEN 50 AND 200 THEN target / 100.0 ELSE target END AS target
    FROM (SELECT CASE WHEN market = 'EUROPE' THEN 'P' || pid || '.L' ELSE ticker END AS ticker, px AS price, px1 * (CASE pid % 5 WHEN 0 THEN 100.0 WHEN 1 THEN 0.01 WHEN 2 THEN 10.0 ELSE 1.0 END)::DOUBLE AS target
          FROM entries WHERE coalesce(buy_age, 0) <= 90 AND px > 0 AND px1 > 0) z"""


def paired_targets(t):
    k = c("pid") % 5
    e = t.entries.where("coalesce(buy_age, 0) <= 90 AND px > 0 AND px1 > 0").select(
        F.when(c("market") == "EUROPE", F.concat(F.lit("P"), c("pid").cast("string"), F.lit(".L"))).otherwise(c("ticker")).alias("ticker"),
        c("px").alias("price"), (c("px1") * F.when(k == 0, 100.0).when(k == 1, 0.01).when(k == 2, 10.0).otherwise(1.0)).alias("target"),
    )
    pence = c("ticker").endswith(".L")
    q = ratio("target", "price")
    fixed = F.when(pence & q.between(0.005, 0.02), c("target") * 100.0).when(pence & q.between(50.0, 200.0), c("target") / 100.0).otherwise(c("target"))
    return e.withColumn("target", fixed).where(ratio("target", "price").between(0.2, 5.0))


@query("J08_paired_target_and_price", statement("entries", f"SELECT ticker, target, price FROM ({PAIRED}) p WHERE target / price BETWEEN 0.2 AND 5.0"))
def _(t):
    return paired_targets(t).select("ticker", "target", "price")


@query("J08_upside_from_pair", statement("entries", f"SELECT ticker, round({clip('(target - price) / price', -0.5, 0.5)} + 0.5, 6) AS score FROM ({PAIRED}) p WHERE target / price BETWEEN 0.2 AND 5.0"))
def _(t):
    return paired_targets(t).select("ticker", r6(price.upside("target", "price")).alias("score"))


@query("J09_intl_metadata", statement("parts", f"""
    SELECT ticker, CASE WHEN reg THEN market ELSE m END AS market, CASE WHEN reg THEN cap_tier WHEN market_cap > 0 THEN CASE WHEN market_cap >= 10e9 THEN 'large' WHEN market_cap >= 2e9 THEN 'mid' ELSE 'small' END ELSE 'large' END AS cap_tier
    FROM (SELECT *, pid % 2 = 0 AND market <> 'USA' AS reg, CASE {REGION.format('ticker')} WHEN 'EU' THEN 'EUROPE' WHEN 'ASIA' THEN 'ASIA' END AS m FROM parts) z WHERE reg OR m IS NOT NULL"""))
def _(t):
    registry = t.parts.where("pid % 2 = 0 AND market <> 'USA'").select("ticker", c("market").alias("r_market"), c("cap_tier").alias("r_tier"))
    by_suffix = F.when(quality.region_of("ticker") != "US", lookup(REGION_MARKET, quality.region_of("ticker")))
    j = t.parts.select("ticker", "market_cap").join(registry, "ticker", "left")
    tier = F.coalesce("r_tier", F.when(c("market_cap") > 0, regime.cap_tier("market_cap")).otherwise("large"))
    return j.select("ticker", F.coalesce("r_market", by_suffix).alias("market"), tier.alias("cap_tier")).where("market IS NOT NULL")


BARS_NO = {
    "nb": (("bars",), "SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d) AS bar_no FROM bars"),
    "ent": (("sig", "nb"), "SELECT s.*, e.bar_no FROM sig s JOIN (SELECT x.sid, x.anchor, min(bar_no) AS bar_no FROM (SELECT DISTINCT sid, anchor FROM sig) x LEFT JOIN nb ON nb.sid = x.sid AND nb.d >= x.anchor GROUP BY 1, 2) e USING (sid, anchor)"),
    "bnb": (("bench",), "SELECT *, row_number() OVER (ORDER BY d) AS bar_no FROM bench"),
    "trades": (("ent", "bnb"), """
        SELECT s.sid, s.anchor, s.badge, s.cap_tier, s.market, s.era, s.score, h.horizon, e.close AS entry_price, x.close AS exit_price, x.close / e.close - 1.0 - CASE s.cap_tier WHEN 'mid' THEN 0.004 WHEN 'small' THEN 0.006 ELSE 0.002 END AS ret,
               CASE WHEN s.market = 'USA' AND x.close IS NOT NULL THEN b1.bench / b0.bench - 1.0 END AS bench_ret,
               (x.close / e.close - 1.0 - CASE s.cap_tier WHEN 'mid' THEN 0.004 WHEN 'small' THEN 0.006 ELSE 0.002 END) - CASE WHEN s.market = 'USA' AND x.close IS NOT NULL THEN b1.bench / b0.bench - 1.0 END AS alpha
        FROM ent s CROSS JOIN (VALUES (1), (3), (6)) h(horizon) LEFT JOIN nb e ON e.sid = s.sid AND e.bar_no = s.bar_no LEFT JOIN nb x ON x.sid = s.sid AND x.bar_no = s.bar_no + h.horizon
        LEFT JOIN (SELECT a.anchor, min(bar_no) AS bn FROM (SELECT DISTINCT anchor FROM sig) a JOIN bnb ON d >= a.anchor GROUP BY 1) z ON z.anchor = s.anchor
        LEFT JOIN bnb b0 ON b0.bar_no = z.bn LEFT JOIN bnb b1 ON b1.bar_no = z.bn + h.horizon"""),
}


def trades(t):
    """Back-test rows, stored once: every statistic reads them."""
    cost = lookup(ROUNDTRIP_COST, "cap_tier")
    return t.stored("trades", lambda: trades_plan(t, cost))


def trades_plan(t, cost=None):
    cost = cost if cost is not None else lookup(ROUNDTRIP_COST, "cap_tier")
    return research.backtest(t.signals, t.bars, t.bench_bars, [1, 3, 6], cost)


@query("J06_asof_quote_intraday", """
    WITH f AS (SELECT user_id, ts AS quote_ts, arg_max(value, event_id) AS quote FROM events WHERE event_type = 'click' GROUP BY 1, 2)
    SELECT e.event_id, e.user_id, f.quote_ts, f.quote FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts >= f.quote_ts""")
def _(t):
    """Facts by the microsecond, a key of any length."""
    quotes = t.events.where("event_type = 'click'").select("user_id", c("ts").alias("quote_ts"), c("value").alias("quote"), c("event_id").alias("tie"))
    buys = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return scan.asof_scan(buys, quotes, "user_id", "ts", "quote_ts", ["quote"], "tie").select("event_id", "user_id", "quote_ts", "quote")


@query("J10_nth_tick_intraday", """
    WITH n AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events WHERE event_type = 'click'),
    b AS (SELECT event_id, e.user_id, e.ts, coalesce(n.no, 0) AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') e
      ASOF LEFT JOIN (SELECT user_id, ts, max(no) AS no FROM n GROUP BY 1, 2) n ON e.user_id = n.user_id AND e.ts > n.ts)
    SELECT b.event_id, k.k, n.value AS price FROM b CROSS JOIN (VALUES (0), (1), (4)) k(k) LEFT JOIN n ON n.user_id = b.user_id AND n.no = b.before + 1 + k.k""")
def _(t):
    clicks = t.events.where("event_type = 'click'").select("user_id", "ts", "event_id", c("value").alias("price"))
    buys = t.events.where("event_type = 'purchase'").select(c("event_id").alias("buy"), "user_id", c("ts").alias("anchor"))
    return scan.nth_after(buys, clicks, [0, 1, 4], "user_id", "anchor", "ts", "event_id", "price").select(c("buy").alias("event_id"), "k", "price")


@query("J10_nth_bar_price", statement("ent nb", "SELECT s.sid, s.anchor, k.k, e.close AS price FROM ent s CROSS JOIN (VALUES (0), (1), (4)) k(k) LEFT JOIN nb e ON e.sid = s.sid AND e.bar_no = s.bar_no + k.k", extra=BARS_NO))
def _(t):
    return joins.offset_prices(t.signals.select("sid", "anchor"), t.bars, [0, 1, 4]).select("sid", "anchor", "k", "price")


@query("J11_backtest_returns", statement("trades", "SELECT sid, anchor, horizon, round(ret, 6) AS ret, round(bench_ret, 6) AS bench_ret, round(alpha, 6) AS alpha FROM trades", extra=BARS_NO))
def _(t):
    return trades_plan(t).select("sid", "anchor", "horizon", r6("ret").alias("ret"), r6("bench_ret").alias("bench_ret"), r6("alpha").alias("alpha"))


PREV = {"pc": (("snaps",), "SELECT a.sid, a.ticker, a.d, a.score AS curr, b.score AS prev FROM snaps a JOIN snaps b ON a.sid = b.sid AND b.d = CAST(a.d - INTERVAL 1 MONTH AS DATE)")}


def prev_curr(t):
    """Each snapshot row next to the same name one month before."""
    prev = t.snaps.select("sid", F.add_months("d", 1).alias("d"), c("score").alias("prev"))
    return t.snaps.select("sid", "ticker", "d", c("score").alias("curr")).join(prev, ["sid", "d"])


TURNOVER_SQL = """
    SELECT d, n AS common, CASE WHEN sa > 1e-12 AND sb > 1e-12 THEN cv / (sa * sb) END AS autocorrelation, 1.0 - k / least(20, n)::DOUBLE AS churn
    FROM (SELECT d, count(*) AS n, covar_pop(ra, rb) AS cv, stddev_pop(ra) AS sa, stddev_pop(rb) AS sb, count(*) FILTER (ta <= 20 AND tb <= 20) AS k
          FROM (SELECT *, rank() OVER (PARTITION BY d ORDER BY prev) + (count(*) OVER (PARTITION BY d, prev) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY d ORDER BY curr) + (count(*) OVER (PARTITION BY d, curr) - 1) / 2.0 AS rb,
                       row_number() OVER (PARTITION BY d ORDER BY prev DESC, ticker) AS ta, row_number() OVER (PARTITION BY d ORDER BY curr DESC, ticker) AS tb FROM pc) r GROUP BY d) z"""


@query("J12_rank_turnover", statement("pc", f"SELECT d, common, round(autocorrelation, 6) AS autocorrelation, round(churn, 6) AS churn FROM ({TURNOVER_SQL}) q", extra=PREV))
def _(t):
    out = research.turnover(prev_curr(t), ["d"], "prev", "curr", 20)
    return out.select("d", "common", r6("autocorrelation").alias("autocorrelation"), r6("churn").alias("churn"))


@query("J13_sector_price_join", statement("bars uni", """
    SELECT sid, d, round(close / s.level, 6) AS relative FROM bars JOIN uni USING (sid) JOIN (SELECT market AS exchange, d, upper(sector) AS sector, sum(close * volume) / sum(volume) AS level FROM bars JOIN uni USING (sid) GROUP BY 1, 2, 3) s
    USING (d) WHERE s.exchange = market AND lower(s.sector) = lower(uni.sector)"""))
def _(t):
    b = t.bars.join(t.universe.select("sid", "market", F.lower("sector").alias("sector")), "sid")
    level = b.groupBy("market", "d", "sector").agg((F.sum(c("close") * c("volume")) / F.sum("volume")).alias("level"))
    return attach(b, level, ["market", "d", "sector"], "inner").select("sid", "d", r6(ratio("close", "level")).alias("relative"))


HOLD = {"hold": (("tx", "parts"), """
    SELECT CASE WHEN pid % 3 = 0 THEN ticker ELSE split_part(ticker, '.', 1) END AS symbol, CAST(date_trunc('quarter', d) AS DATE) AS q, count(*) AS ih, count(*) FILTER (code = 'P') AS inc, count(*) FILTER (code = 'S') AS red
    FROM tx JOIN parts USING (pid) WHERE d >= DATE '2001-04-01' AND d < DATE '2001-10-01' AND pid % 7 <> 0 GROUP BY 1, 2""")}


@query("J14_quarter_fallback", statement("parts hold", f"""
    SELECT ticker, symbol, q, round({flow13f('ih', 'inc - red', 'inc', 'red', 'inc / 4.0')}, 6) AS score FROM (SELECT p.ticker, h.*, row_number() OVER (PARTITION BY p.ticker ORDER BY CASE WHEN h.symbol = p.ticker THEN 0 ELSE 1 END, q DESC) AS rn
        FROM parts p LEFT JOIN hold h ON h.symbol = p.ticker OR h.symbol = split_part(p.ticker, '.', 1)) z WHERE rn = 1""", extra=HOLD))
def _(t):
    from ..functions import ownership

    symbol = F.when(c("pid") % 3 == 0, c("ticker")).otherwise(joins.base_symbol("ticker"))
    names = t.parts.where("pid % 7 <> 0").select("pid", symbol.alias("symbol"))
    recent = t.insider_rows(218).where("d >= DATE'2001-04-01' AND d < DATE'2001-10-01'").groupBy("pid", F.to_date(F.date_trunc("quarter", "d")).alias("q")).agg(
        F.count(F.lit(1)).alias("ih"), count_when(c("code") == "P").alias("inc"), count_when(c("code") == "S").alias("red")
    )
    held = recent.join(names, "pid").drop("pid")
    got = joins.newest_by_candidate(t.parts.select("ticker"), held, [F.desc("q")], 1)
    flow = ownership.flow_13f("ih", c("inc") - c("red"), "inc", "red", c("inc") / 4.0)
    return got.select("ticker", "symbol", "q", r6(flow).alias("score"))


CLUSTER_SQL = """SELECT cid AS pid, count(DISTINCT member) AS members FROM ctx WHERE type <> 'Exchange' AND age <= 900 GROUP BY cid HAVING count(DISTINCT member) >= 3"""
CONV_SQL = "(CASE WHEN members IS NOT NULL THEN least(1.0, (members - 3) / 2.0 * 0.40 + 0.60) END)"


def clusters(t, lookback=900):
    """Names traded by at least three distinct members, with the cluster's conviction."""
    s = t.congress_rows(lookback).where(c("type") != "Exchange").select("cid", "member").distinct()
    k = s.groupBy(c("cid").alias("pid")).agg(F.count(F.lit(1)).alias("members")).where("members >= 3")
    return k.withColumn("conviction", F.least(F.lit(1.0), (c("members") - 3) / 2.0 * 0.40 + 0.60))


def boosted(t):
    j = t.entries.join(clusters(t), "pid", "left").withColumn("boost", F.coalesce(0.10 * c("conviction"), F.lit(0.0)))
    return j.withColumn("boosted", c("final_score") * (1.0 + c("boost")))


BOOST = {"boosted": (("entries", "ctx"), f"SELECT *, final_score * (1.0 + boost) AS boosted FROM (SELECT *, coalesce(0.10 * {CONV_SQL}, 0.0)::DOUBLE AS boost FROM entries LEFT JOIN ({CLUSTER_SQL}) k USING (pid)) z")}


@query("J15_cluster_boost", statement("boosted", f"SELECT ticker, round(boost, 6) AS boost, round(boosted, 8) AS final_score, {BADGE.format('boosted')} AS badge FROM boosted", extra=BOOST))
def _(t):
    return boosted(t).select("ticker", r6("boost").alias("boost"), F.round("boosted", 8).alias("final_score"), regime.badge("boosted").alias("badge"))


@query("J16_shadow_merge", statement("entries v3", "SELECT ticker, e.final_score, round(v.final_v3, 6) AS final_score_v3, round(v.coverage, 6) AS coverage_v3, v.low_coverage FROM entries e LEFT JOIN (SELECT * FROM v3 WHERE region = 'US') v USING (ticker)", extra=PILLAR_VIEWS))
def _(t):
    v = pillar_rows(t).where("region = 'US'").select("ticker", c("final_score").alias("v3"), c("coverage").alias("cv"), "low_coverage")
    j = t.entries.select("ticker", "final_score").join(v, "ticker", "left")
    return j.select("ticker", "final_score", r6("v3").alias("final_score_v3"), r6("cv").alias("coverage_v3"), "low_coverage")


@query("J17_regional_shadow_merge", statement("entries v3", "SELECT ticker, e.final_score, round(v.final_v3, 6) AS final_score_v3 FROM entries e LEFT JOIN (SELECT * FROM v3 WHERE region IN ('EU', 'ASIA')) v USING (ticker) WHERE e.market <> 'USA'", extra=PILLAR_VIEWS))
def _(t):
    rows = pillar_rows(t)
    both = rows.where("region = 'EU'").unionByName(rows.where("region = 'ASIA'")).select("ticker", r6("final_score").alias("final_score_v3"))
    return t.entries.where("market <> 'USA'").select("ticker", "final_score").join(both, "ticker", "left")


@query("J18_score_delta_tag", statement("snaps", """
    SELECT a.ticker, a.d, CASE WHEN b.score IS NULL THEN 'NEW' WHEN abs(a.score - b.score) < 0.005 THEN '' WHEN a.score > b.score THEN 'UP' ELSE 'DOWN' END AS tag, round(a.score - b.score, 6) + 0.0 AS delta
    FROM snaps a LEFT JOIN snaps b ON a.sid = b.sid AND b.d = CAST(a.d - INTERVAL 1 MONTH AS DATE)"""))
def _(t):
    prev = t.snaps.select("sid", F.add_months("d", 1).alias("d"), c("score").alias("prev"))
    j = t.snaps.join(prev, ["sid", "d"], "left").withColumn("delta", c("score") - c("prev"))
    tag = F.when(c("prev").isNull(), "NEW").when(F.abs("delta") < 0.005, "").when(c("delta") > 0, "UP").otherwise("DOWN")
    return j.select("ticker", "d", tag.alias("tag"), r6("delta").alias("delta"))


VEL_SQL = """SELECT uid, velocity FROM (SELECT uid, d, avg(volume) OVER (PARTITION BY uid ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(volume) OVER (PARTITION BY uid ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 1 AS velocity,
    row_number() OVER (PARTITION BY uid ORDER BY d DESC) AS rn FROM daily) z WHERE rn = 1"""


@query("J19_satellite_anti_join", statement("daily", f"SELECT uid, round(velocity, 6) AS velocity FROM ({VEL_SQL}) v WHERE uid NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') ORDER BY round(velocity, 9) DESC, uid LIMIT 20"))
def _(t):
    v = ts.volume_velocity(t.daily_bars, "uid", 5, 20)
    last = events.newest_n(v, ["uid"], [F.desc("d")], 1)
    core = t.customer.where("c_mktsegment = 'MACHINERY'").select(c("c_custkey").alias("uid"))
    return last.join(core, "uid", "left_anti").orderBy(F.desc(F.round("velocity", 9)), "uid").limit(20).select("uid", r6("velocity").alias("velocity"))
