"""SQL text of the input views and small text helpers for oracle statements."""

from __future__ import annotations

from ..config import WEIGHTS


def clip(x, a, b):
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({a}, least({b}, ({x}))) END)"


def log_sat(x, full):
    return f"least(1.0, ln(1 + ({x})) / ln(1 + {full}))"


def decay(base, age):
    return (
        f"(CASE WHEN ({age}) > 30 THEN 0.5 + (({base}) - 0.5) * greatest(0.70, 1.0 - 0.30 * least(({age}) - 30, 150) / 150.0) "
        f"ELSE ({base}) END)"
    )


def weighted(weights, prefix=""):
    return " + ".join(f"coalesce({prefix}{f}, 0.0) * {w}" for f, w in weights.items())


def present(weights, prefix=""):
    return " + ".join(f"(CASE WHEN {prefix}{f} IS NOT NULL THEN {w} ELSE 0.0 END)::DOUBLE" for f, w in weights.items())


BADGE = "(CASE WHEN {0} >= 0.80 THEN 'HIGH BUY' WHEN {0} >= 0.60 THEN 'TACTICAL BUY' ELSE 'WATCHLIST' END)"
TIER = "(CASE WHEN {0} >= 10e9 THEN 'large' WHEN {0} >= 2e9 THEN 'mid' ELSE 'small' END)"
AGE = "(DATE '2001-11-05' - CAST({0} AS DATE))"
US = WEIGHTS["US"]
FACTORS = list(US)

# Conviction with the CEO lift, over columns usd, cap, ceo, age.
_CONV_BASE = f"(0.30 + 0.60 * {log_sat('(usd / cap) * 10000', 100)})"
_CEO = (
    "(CASE WHEN coalesce(ceo, 0) <= 0 THEN 1.0 WHEN cap > 0 THEN (CASE WHEN ceo / cap * 10000 < 0.5 THEN 1.0 "
    "WHEN ceo / cap * 10000 < 1.0 THEN 1.05 WHEN ceo / cap * 10000 < 5.0 THEN 1.10 ELSE 1.15 END) "
    "WHEN ceo >= 50000 THEN 1.10 ELSE 1.0 END)"
)


def conviction(usd, cap, ceo, age):
    base = f"(CASE WHEN {_CEO} > 1.0 THEN least(0.95, {_CONV_BASE} * {_CEO}) ELSE {_CONV_BASE} END)"
    text = f"(CASE WHEN usd > 0 AND cap > 0 THEN {decay(base, 'coalesce(age, 0)')} ELSE 0.0 END)"
    for name, value in (("usd", usd), ("cap", cap), ("ceo", ceo)):
        text = _word(text, name, f"({value})")
    return _word(text, "age", f"({age})")


def _word(text, name, value):
    import re

    return re.sub(rf"\b{name}\b(?!\()", value.replace("\\", ""), text)


def breadth(b, s, age):
    base = f"(0.7 * ({b}) / nullif(({b}) + ({s}), 0) + 0.3 * {log_sat(f'(({b}) + ({s}))::DOUBLE', 10)})"
    return f"(CASE WHEN ({b}) + ({s}) > 0 THEN (CASE WHEN ({age}) IS NOT NULL THEN {decay(base, age)} ELSE {base} END) ELSE 0.0 END)"


def congress(p, s, age):
    base = f"(((({p}) - ({s}))::DOUBLE / (({p}) + ({s}) + 1) + 1) / 2)"
    return (
        f"(CASE WHEN ({p}) IS NULL THEN 0.0 WHEN ({p}) + ({s}) = 0 THEN 0.5 WHEN ({age}) IS NOT NULL THEN {decay(base, age)} ELSE {base} END)"
    )


def flow13f(ih, dih, inc, red, dop):
    return (
        f"(CASE WHEN ({ih}) IS NOT NULL THEN greatest(0.0, least(1.0, 0.5 + 0.2 * coalesce({clip(f'10.0 * ({dih}) / nullif(({ih}), 0)', -1.0, 1.0)}, 0.0) "
        f"+ 0.2 * (({inc}) - ({red})) / greatest(1.0, ({inc}) + ({red})) + 0.1 * greatest(-5.0, least(5.0, ({dop}))) / 5.0)) END)"
    )


VIEWS = {
    "uni": ((), """
        SELECT s_suppkey AS sid,
               'S' || s_suppkey || CASE market WHEN 'EUROPE' THEN (['.PA', '.DE', '.L'])[n_nationkey % 3 + 1]
                                               WHEN 'ASIA' THEN (['.T', '.HK', '.KS'])[n_nationkey % 3 + 1] ELSE '' END AS ticker,
               market, (['Technology', 'Energy', 'Healthcare', 'Utilities'])[s_suppkey % 4 + 1] AS sector,
               """ + TIER.format("(s_acctbal + 1000.0) * 2000000.0") + """ AS cap_tier,
               (s_acctbal + 1000.0) * 2000000.0 AS market_cap
        FROM supplier JOIN (SELECT n_nationkey, CASE WHEN r_name IN ('AMERICA', 'AFRICA') THEN 'USA' WHEN r_name = 'EUROPE' THEN 'EUROPE'
                                   ELSE 'ASIA' END AS market FROM nation JOIN region ON n_regionkey = r_regionkey) w
             ON s_nationkey = n_nationkey"""),
    "parts": ((), """
        SELECT p_partkey AS pid, 'P' || p_partkey || (['', '.PA', '.T'])[p_partkey % 3 + 1] AS ticker,
               (['USA', 'EUROPE', 'ASIA'])[p_partkey % 3 + 1] AS market, (['US', 'EU', 'ASIA'])[p_partkey % 3 + 1] AS region,
               p_type AS sector, CASE WHEN p_size >= 35 THEN 'large' WHEN p_size >= 15 THEN 'mid' ELSE 'small' END AS cap_tier,
               p_retailprice * p_size * 250000.0 AS market_cap
        FROM part"""),
    "bars": ((), """
        SELECT l_suppkey AS sid, CAST(date_trunc('month', l_shipdate) AS DATE) AS d,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / sum(CAST(l_quantity AS BIGINT))::DOUBLE / 100.0 AS close,
               max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
               sum(CAST(l_quantity AS BIGINT))::BIGINT AS volume
        FROM lineitem GROUP BY 1, 2"""),
    "bench": ((), """
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / sum(CAST(l_quantity AS BIGINT))::DOUBLE / 100.0 AS bench
        FROM lineitem GROUP BY 1"""),
    "daily": ((), """
        SELECT user_id AS uid, CAST(ts AS DATE) AS d,
               sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / count(*)::DOUBLE / 100.0 AS close, count(*) AS volume
        FROM events GROUP BY 1, 2"""),
    "tx": ((), """
        SELECT l_partkey AS pid, l_suppkey AS insider_id, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'O' END AS code,
               CAST(l_quantity AS BIGINT) AS shares, CAST(round(l_extendedprice * 100) AS BIGINT) AS value_c,
               CAST(l_shipdate AS DATE) AS d, DATE '2001-11-05' - CAST(l_shipdate AS DATE) AS age, l_linenumber = 1 AS is_ceo
        FROM lineitem"""),
    "ctx": ((), """
        SELECT o_custkey AS cid, 'C' || o_custkey AS ticker, o_orderkey % 50 AS member,
               CASE o_orderstatus WHEN 'F' THEN 'Purchase' WHEN 'O' THEN 'Sale (Full)' ELSE 'Exchange' END AS type,
               CAST(o_orderdate AS DATE) AS d, DATE '2001-11-05' - CAST(o_orderdate AS DATE) AS age
        FROM orders"""),
    "stm": ((), """
        SELECT c_mktsegment AS ticker, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH AS DATE) - 1 AS d,
               CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH AS DATE) + 40 AS filing_date,
               sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / 100.0 AS revenue,
               coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'F'), 0)::DOUBLE / 100.0 AS op_income,
               count(*) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3"""),
    "est": ((), """
        SELECT l_partkey AS pid, year(l_shipdate) AS yr,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / sum(CAST(l_quantity AS BIGINT))::DOUBLE / 100.0 AS est, count(*) AS n
        FROM lineitem GROUP BY 1, 2"""),
    "art": ((), """
        SELECT user_id AS uid, CASE WHEN event_type IN ('purchase', 'signup') THEN 'Positive' WHEN event_type = 'error' THEN 'Negative' ELSE 'Neutral' END AS sentiment,
               CAST(ts AS DATE) AS d, DATE '2024-01-31' - CAST(ts AS DATE) AS age
        FROM events"""),
    "pstat": ((), """
        SELECT l_partkey AS pid, count(*) AS n_lines, sum(q) AS q_all, sum(c) AS c_all, sum(disc) AS disc, sum(tax) AS tax,
               coalesce(sum(q) FILTER (age <= 365), 0) AS q_1y, coalesce(sum(c) FILTER (age <= 365), 0) AS c_1y, count(*) FILTER (age <= 365) AS n_1y,
               coalesce(sum(q) FILTER (age > 365 AND age <= 730), 0) AS q_0y, coalesce(sum(c) FILTER (age > 365 AND age <= 730), 0) AS c_0y,
               count(*) FILTER (age > 365 AND age <= 730) AS n_0y, coalesce(sum(q) FILTER (age > 365 AND age <= 1826), 0) AS q_4y,
               count(*) FILTER (f = 'A' AND age <= 30) AS buy30, count(*) FILTER (f = 'A' AND age > 30 AND age <= 180) AS buy180,
               coalesce(sum(c) FILTER (f = 'A' AND age <= 180), 0) AS buy_c, coalesce(sum(c) FILTER (f = 'A' AND age <= 180 AND l_linenumber = 1), 0) AS ceo_c,
               count(*) FILTER (f = 'A') AS n_a, count(*) FILTER (f = 'R') AS n_r, count(*) FILTER (f = 'N') AS n_n,
               count(*) FILTER (l_linenumber = 1) AS r1, count(*) FILTER (l_linenumber = 2) AS r2, count(*) FILTER (l_linenumber IN (3, 4)) AS r3,
               count(*) FILTER (l_linenumber IN (5, 6)) AS r4, count(*) FILTER (l_linenumber = 7) AS r5,
               count(*) FILTER (f = 'A' AND age <= 365) AS buys_1y, count(*) FILTER (f = 'R' AND age <= 365) AS sells_1y,
               min(age) FILTER (f = 'A' AND age <= 365) AS buy_age,
               count(DISTINCT l_suppkey) FILTER (f = 'A' AND age <= 365) AS buyers, count(DISTINCT l_suppkey) FILTER (f = 'R' AND age <= 365) AS sellers,
               max(up) AS px_high, min(up) AS px_low
        FROM (SELECT *, l_returnflag AS f, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS q,
                     CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax,
                     DATE '2001-11-05' - CAST(l_shipdate AS DATE) AS age, l_extendedprice / l_quantity AS up FROM lineitem) x
        GROUP BY 1"""),
    "news": (("art",), """
        SELECT uid AS pid, sum((CASE sentiment WHEN 'Positive' THEN 1.0 WHEN 'Negative' THEN -1.0 ELSE 0.0 END) * exp(-age * ln(2.0) / 5.0)) AS vw,
               sum(exp(-age * ln(2.0) / 5.0)) AS ww, count(*) FILTER (age <= 7) AS n_recent, count(*) AS n_articles,
               max(CASE WHEN sentiment <> 'Neutral' THEN 1 ELSE 0 END) AS directional
        FROM art GROUP BY 1"""),
    "wide": (("parts", "pstat", "news"), """
        SELECT *, c_all::DOUBLE / q_all / 100.0 AS px, c_1y::DOUBLE / nullif(q_1y, 0) / 100.0 AS px1, c_0y::DOUBLE / nullif(q_0y, 0) / 100.0 AS px0,
               (c_1y::DOUBLE / nullif(q_1y, 0) / 100.0) / nullif(c_0y::DOUBLE / nullif(q_0y, 0) / 100.0, 0) - 1.0 AS mom_ret,
               q_1y * 4.0::DOUBLE / nullif(q_4y, 0) AS volume_spike, tax::DOUBLE / n_lines / 100.0 - 0.02 AS npm,
               0.2 + disc::DOUBLE / n_lines / 100.0 * 2.5 AS gpm, (tax - disc)::DOUBLE / n_lines / 100.0 AS opm,
               n_r::DOUBLE / nullif(n_a, 0) - 0.4 AS de, n_n::DOUBLE / nullif(n_r, 0) + 0.5 AS cr, q_1y::DOUBLE / nullif(q_0y, 0) AS turnover,
               CASE WHEN directional = 1 THEN (vw / nullif(ww, 0) + 1.0) / 2.0 WHEN directional = 0 THEN 0.0 END AS sent_raw
        FROM parts LEFT JOIN pstat USING (pid) LEFT JOIN news USING (pid)"""),
    "scored": (("wide",), f"""
        SELECT *, quality_raw / 8.0::DOUBLE AS quality_piotroski FROM (SELECT *,
               CASE WHEN n_lines IS NOT NULL THEN (CASE WHEN npm * turnover > 0 THEN 1 ELSE 0 END) + (CASE WHEN npm * turnover > 0.05 THEN 1 ELSE 0 END)
                 + (CASE WHEN opm > 0 THEN 1 ELSE 0 END) + (CASE WHEN de >= 0 AND de < 1 THEN 1 ELSE 0 END) + (CASE WHEN de >= 0 AND de < 0.5 THEN 1 ELSE 0 END)
                 + (CASE WHEN cr > 1.5 THEN 1 ELSE 0 END) + (CASE WHEN gpm > 0.30 THEN 1 ELSE 0 END) + (CASE WHEN npm > 0.05 THEN 1 ELSE 0 END) END AS quality_raw,
               {conviction('buy_c / 100.0', 'market_cap', 'ceo_c / 100.0', 'buy_age')} AS insider_conviction,
               {breadth('buyers', 'sellers', 'buy_age')} AS insider_breadth,
               CASE WHEN market = 'USA' THEN {congress('buys_1y', 'sells_1y', 'buy_age')} END AS congress,
               sent_raw AS news_sentiment,
               CASE WHEN n_articles IS NOT NULL THEN {log_sat('n_recent::DOUBLE', 50)} END AS news_buzz,
               coalesce(({clip('mom_ret', -0.60, 0.60)} + 0.60) / 1.20, 0.0) AS momentum_long,
               coalesce({clip('(volume_spike - 1.0) / 4.0', 0.0, 1.0)}, 0.0) AS volume_attention,
               CASE WHEN n_lines < 2 THEN 0.0 WHEN n_lines IS NOT NULL THEN (r1 * 1.0 + r2 * 0.75 + r3 * 0.5 + r4 * 0.25)::DOUBLE / nullif(r1 + r2 + r3 + r4 + r5, 0) END AS analyst_consensus,
               (CASE WHEN market = 'USA' AND n_lines IS NOT NULL THEN CASE WHEN n_a > n_r AND n_a > n_n THEN 0.80 WHEN n_r > n_a AND n_r > n_n THEN 0.20 ELSE 0.55 END END)::DOUBLE AS transcript_tone,
               CASE WHEN n_1y >= 3 AND abs(px0) >= 1e-4 THEN 0.5 + {clip('(px1 - px0) / abs(px0)', -0.30, 0.30)} / 0.60 * least(1.0, n_1y / 10.0) END AS revenue_revision,
               CASE WHEN market = 'USA' THEN {flow13f('n_lines', 'n_1y - n_0y', 'buys_1y', 'sells_1y', '(n_1y - n_0y) / 2.0')} END AS inst_flow_13f
        FROM wide) z"""),
    "entries": (("scored",), f"""
        SELECT *, {BADGE.format('final_score')} AS badge FROM (SELECT *,
               least(1.0, coalesce(round(({weighted(US)}) / nullif({present(US)}, 0) * 1.25, 6), 0.0))::DOUBLE AS final_score,
               CASE WHEN market = 'USA' THEN 'US' ELSE 'INTL' END AS pipeline, ({present(US)}) AS coverage, px1 AS target_price,
               mom_ret / 2.0 AS return_5d, mom_ret AS return_21d, (n_1y - n_0y)::DOUBLE / nullif(n_0y, 0) AS surprise_pct, buy_age AS surprise_days,
               buys_1y::DOUBLE / nullif(buys_1y + sells_1y, 0) - n_a::DOUBLE / nullif(n_a + n_r, 0) AS npr_spike,
               q_1y::DOUBLE / nullif(q_0y, 0) AS beta, (px_high - px_low) / 20.0 AS atr, 100.0 * (n_a::DOUBLE / nullif(n_a + n_r, 0)) AS rsi,
               px1 / nullif(px, 0) AS vwap_ratio, c_1y / 100.0 AS adv_usd
        FROM scored) z"""),
    "ls": (("scored",), "SELECT pid, ticker, market, sector, cap_tier, factor, score FROM (" + " UNION ALL ".join(
        f"SELECT pid, ticker, market, sector, cap_tier, '{f}' AS factor, {f}::DOUBLE AS score FROM scored" for f in FACTORS) + ") z"),
    "snaps": (("bars", "bench", "uni"), """
        SELECT sid, ticker, d, market, sector, cap_tier, mom, vz, rev, val, fwd, bench_fwd, fwd - bench_fwd AS fwd_x,
               round(0.5 * (greatest(-0.6, least(0.6, mom)) + 0.6) / 1.2 + 0.3 * greatest(0.0, least(1.0, (coalesce(vz, 0.0) + 3.0) / 6.0)) + 0.2 * greatest(0.0, least(1.0, val / 2.0)), 6) AS score
        FROM (SELECT sid, d, (lag(close, 1) OVER w / lag(close, 12) OVER w - 1) - (lag(bench, 1) OVER w / lag(bench, 12) OVER w - 1) AS mom,
                     CASE WHEN count(*) OVER f < 20 THEN NULL WHEN stddev_pop(volume) OVER f <= 1e-12 THEN 0.0 ELSE (volume - avg(volume) OVER f) / stddev_pop(volume) OVER f END AS vz,
                     -(close / lag(close, 1) OVER w - 1) AS rev, bench / close AS val, lead(close, 3) OVER w / close - 1 AS fwd, lead(bench, 3) OVER w / bench - 1 AS bench_fwd
              FROM bars JOIN bench USING (d) WINDOW w AS (PARTITION BY sid ORDER BY d), f AS (PARTITION BY sid ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) z
        JOIN uni USING (sid) WHERE mom IS NOT NULL"""),
    "sl": (("snaps",), " UNION ALL ".join(f"SELECT sid, d, market, fwd_x, '{f}' AS factor, {f}::DOUBLE AS score FROM snaps" for f in ("mom", "vz", "rev", "val"))),
    "sig": (("snaps",), """
        SELECT sid, d + (sid % 28)::INT AS anchor, CASE WHEN score >= 0.62 THEN 'HIGH BUY' ELSE 'TACTICAL BUY' END AS badge, cap_tier, market, score,
               CASE WHEN year(d) % 2 = 0 THEN 'v1' ELSE 'v2' END AS era FROM snaps WHERE score >= 0.52"""),
    "vix": ((), """
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d,
               ((sum(CAST(round(l_tax * 100) AS BIGINT)) * 31 + sum(CAST(l_quantity AS BIGINT) % 7) * 7 + count(*)) % 450)::DOUBLE / 10.0 AS vix
        FROM lineitem GROUP BY 1"""),
}


def statement(views: str, body: str, recursive: bool = False, extra=None) -> str:
    """WITH chain of the named views (and what they need), then the body."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for d in known[name][0]:
            need(d)
        order.append(name)

    for v in views.split():
        need(v)
    head = ", ".join(f"{v} AS MATERIALIZED ({known[v][1]})" for v in order)
    word = "WITH RECURSIVE " if recursive else "WITH "
    return f"{word}{head} {body}" if head else body
