"""One query per factor scorer, each over whole tables."""

import datetime as dt

from pyspark.sql import functions as F

from ..config import INSIDER_CEILING
from ..functions import consensus, fundamentals, ownership, price, text
from ..functions.common import r6, ratio
from ..operators import bundles, events
from ..operators.distribution import attach
from ..oracles.base import clip, congress, conviction, breadth, decay, flow13f, log_sat, statement
from ..oracles.factors import ALPHA, C13, DIVIDEND, DUPONT, FACTOR_VIEWS, PB, PEAD, PILLAR_SQL, RESIDUAL, REVISION, ROIC, SHOCK, UPSIDE
from ..views import None_, count_when
from .registry import query

c = F.col


def digits(name):
    """Output digits; the dividend score is a short decimal that often ends in a five at digit seven."""
    return 9 if name.endswith("dividend_sustain") else 6


def scorer(name, expr, sql):
    """A scorer that is one expression over the prepared rows."""

    @query(name, statement("entries", f"SELECT ticker, round(({sql})::DOUBLE, {digits(name)}) + 0.0 AS score FROM entries"))
    def _(t):
        return t.entries.select("ticker", (F.round(expr(), digits(name)) + 0.0).alias("score"))


scorer("F01_momentum", lambda: price.momentum("mom_ret", F.lit(0.05)), f"coalesce(({clip('mom_ret - 0.05', -0.6, 0.6)} + 0.6) / 1.2, 0.0)")
scorer("F02_volume_attention", lambda: price.volume_attention("volume_spike"), f"coalesce({clip('(volume_spike - 1) / 4', 0.0, 1.0)}, 0.0)")
scorer("F03_target_upside", lambda: price.upside("px1", "px"), UPSIDE.format(t="px1", p="px"))
scorer("F05_fcf_yield", lambda: fundamentals.fcf_yield((c("c_1y") - c("c_0y")) / 100.0, c("c_all") / 100.0), PILLAR_SQL["fcf_yield"])
scorer("F06_pb_value", lambda: fundamentals.pb_value("px0", "px1"), PB.format(b="px0", p="px1"))
scorer("F07_roic_quality", lambda: fundamentals.roic_quality(c("npm") * 5.0, c("opm") * 3.0), PILLAR_SQL["roic_quality"])
scorer("F08_dupont_quality", lambda: fundamentals.dupont_quality(None_(), "npm", "turnover", "de"), DUPONT)
scorer("F10_earnings_yield", lambda: fundamentals.earnings_yield(c("c_1y") - c("c_0y"), c("c_all")),
       "CASE WHEN c_1y - c_0y > 0 AND c_all > 0 THEN least(0.15, (c_1y - c_0y)::DOUBLE / c_all) / 0.15 ELSE 0.0 END")
scorer("F11_ev_ebitda", lambda: fundamentals.ev_ebitda("c_all", "c_1y"),
       "CASE WHEN c_all > 0 AND c_1y > 0 THEN 1.0 - (greatest(5.0, least(35.0, c_all::DOUBLE / c_1y)) - 5.0) / 30.0 ELSE 0.0 END")
scorer("F15_accruals", lambda: fundamentals.accruals("c_1y", "c_0y", "c_all"),
       "CASE WHEN c_all > 0 THEN 1.0 - (greatest(-0.2, least(0.2, (c_1y - c_0y)::DOUBLE / c_all)) + 0.2) / 0.4 ELSE 0.0 END")
scorer("F17_dcf_upside", lambda: price.dcf_upside("px0", "px1"), f"CASE WHEN px0 > 0 AND px1 > 0 THEN {clip('(px0 - px1) / px1', -0.5, 0.5)} + 0.5 END")
scorer("F18_insider_conviction", lambda: ownership.conviction(c("buy_c") / 10.0, "market_cap", "buy_age", c("ceo_c") / 10.0, c("px") * 1000),
       conviction("buy_c / 10.0", "market_cap", "ceo_c / 10.0", "buy_age").replace("ELSE 1.15 END", "ELSE (CASE WHEN (ceo_c / 10.0) < 0.5 * (px * 1000) THEN 1.10 ELSE 1.15 END) END"))
scorer("F19_ceo_significance", lambda: ownership.ceo_multiplier(c("ceo_c") / 1.0, "market_cap"),
       "CASE WHEN coalesce(ceo_c, 0) <= 0 THEN 1.0 WHEN ceo_c / market_cap * 10000 < 0.5 THEN 1.0 WHEN ceo_c / market_cap * 10000 < 1 THEN 1.05 WHEN ceo_c / market_cap * 10000 < 5 THEN 1.10 ELSE 1.15 END")
scorer("F20_insider_breadth", lambda: ownership.breadth("buyers", "sellers", "buy_age"), breadth("buyers", "sellers", "buy_age"))
scorer("F21_residual_breadth", lambda: ownership.residual("insider_breadth", "insider_conviction"), f"CASE WHEN insider_breadth IS NOT NULL THEN {RESIDUAL} END")
scorer("F22_insider_alpha", lambda: bundles.factor_columns()["insider_alpha"], ALPHA)
scorer("F24_insider_log_scale", lambda: ownership.log_scale_by_tier(c("buy_c") * 10.0, "market_cap", "cap_tier", INSIDER_CEILING),
       "CASE WHEN buy_c > 0 AND market_cap > 0 THEN least(1.0, ln(1 + buy_c * 10.0 / market_cap) / ln(1 + CASE cap_tier WHEN 'small' THEN 0.02 WHEN 'mid' THEN 0.01 ELSE 0.005 END)) END")
scorer("F25_insider_value", lambda: ownership.insider_value(c("buy_c") / 100.0, "market_cap", "buy_age"),
       f"CASE WHEN buy_c > 0 THEN {decay('(0.30 + 0.60 * ' + log_sat('buy_c / 100.0 / market_cap * 10000', 100) + ')', 'coalesce(buy_age, 0)')} ELSE 0.0 END")
scorer("F26_filing_count", lambda: ownership.filing_count("n_1y"), "CASE WHEN n_1y > 0 THEN least(0.90, ln(1 + n_1y::DOUBLE) / ln(201.0)) ELSE 0.0 END")
scorer("F29_flow_13f", lambda: ownership.flow_13f("n_lines", c("n_1y") - c("n_0y"), "buys_1y", "sells_1y", c("n_1y") / 3.0),
       flow13f("n_lines", "n_1y - n_0y", "buys_1y", "sells_1y", "n_1y / 3.0"))
scorer("F30_concentration_13f", lambda: ownership.concentration_13f(c("n_1y") * 5.0, "n_lines", "buys_1y", "sells_1y"), C13.format("n_1y * 5.0", "n_lines", "buys_1y", "sells_1y"))
scorer("F31_dividend_sustain", lambda: bundles.factor_columns()["dividend_sustain"], PILLAR_SQL["dividend_sustain"])
scorer("F35_revenue_revision", lambda: consensus.revenue_revision("px1", "px0", "n_1y"), REVISION.format(n="n_1y", p="((px1 - px0) / nullif(px0, 0))"))
scorer("F38_surprise_drift", lambda: consensus.surprise_drift("surprise_pct", "surprise_days"), PEAD.format(p="surprise_pct", d="surprise_days"))
scorer("F23w_shock_expression", lambda: price.illiquidity_shock(ratio("px1", "q_1y"), ratio(c("px") * 3.0, "q_all")), SHOCK.format("((px1 / nullif(q_1y, 0)) / nullif(px * 3.0 / q_all, 0))"))


@query("F04_quality_points", statement("entries", "SELECT ticker, quality_raw::BIGINT AS points, quality_raw / 8.0::DOUBLE AS score FROM entries"))
def _(t):
    p = fundamentals.quality_points(None_(), "opm", "de", "cr", "gpm", "npm", "turnover")
    return t.entries.select("ticker", p.cast("long").alias("points")).withColumn("score", fundamentals.quality_score("points"))


# --- statements --------------------------------------------------------------------------

STATEMENT_ROWS = "SELECT ticker, d, filing_date, CASE WHEN n % 9 <> 0 THEN revenue END AS revenue, op_income FROM stm"
TTM_SQL = f"""
    WITHIN AS (SELECT * FROM ({STATEMENT_ROWS}) s WHERE revenue IS NOT NULL AND op_income IS NOT NULL),
    Q8 AS (SELECT *, row_number() OVER w AS rn, lag(d) OVER w - d AS gap FROM WITHIN WINDOW w AS (PARTITION BY ticker ORDER BY d DESC)),
    QQ AS (SELECT ticker, count(*) AS k, count(*) FILTER (rn > 1 AND gap BETWEEN 70 AND 110) AS good, sum(revenue) FILTER (rn <= 4) AS qnr, sum(op_income) FILTER (rn <= 4) AS qno,
                  sum(revenue) FILTER (rn > 4) AS qpr, sum(op_income) FILTER (rn > 4) AS qpo FROM Q8 WHERE rn <= 8 GROUP BY ticker),
    AA AS (SELECT ticker, max(r) FILTER (rn = 1) AS anr, max(o) FILTER (rn = 1) AS ano, max(r) FILTER (rn = 2) AS apr, max(o) FILTER (rn = 2) AS apo
           FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY yr DESC) AS rn FROM (SELECT ticker, year(d) AS yr, sum(revenue) AS r, sum(op_income) AS o FROM WITHIN GROUP BY 1, 2) y) z
           GROUP BY ticker)"""


def ttm_statement(body):
    base = statement("stm", "")
    return base + ", " + TTM_SQL + " " + body


def statement_rows(t):
    return t.statements.withColumn("revenue", F.when(c("n") % 9 != 0, c("revenue")))


@query("F09_margin_expansion", ttm_statement("""
    SELECT ticker, round(0.5 + greatest(-0.1, least(0.1, CASE WHEN k = 8 AND good = 7 THEN qno / nullif(qnr, 0) - qpo / nullif(qpr, 0) ELSE ano / nullif(anr, 0) - apo / nullif(apr, 0) END)) / 0.2, 6) AS score
    FROM QQ JOIN AA USING (ticker)"""))
def _(t):
    p = events.ttm_pair(statement_rows(t), "ticker", ["revenue", "op_income"])
    q = fundamentals.margin_expansion(ratio("q_now_op_income", "q_now_revenue"), ratio("q_prior_op_income", "q_prior_revenue"))
    a = fundamentals.margin_expansion(ratio("a_now_op_income", "a_now_revenue"), ratio("a_prior_op_income", "a_prior_revenue"))
    return p.select("ticker", r6(F.coalesce(F.when(c("clean"), q), a)).alias("score"))


def growth_sql(now, prior, band):
    g = f"greatest(-{band}, least({band}, {{n}} / {{p}} - 1.0)) / {2 * band}"
    q, a = g.format(n="qn" + now, p="qp" + now), g.format(n="an" + now, p="ap" + now)
    return ttm_statement(f"""SELECT ticker, round(CASE WHEN k = 8 AND good = 7 AND qp{now} > 0 THEN 0.5 + {q} WHEN ap{now} > 0 THEN 0.5 + {a} END, 6) AS score FROM QQ JOIN AA USING (ticker)""")


def growth(t, field, band):
    p = events.ttm_pair(statement_rows(t), "ticker", ["revenue", "op_income"])
    q = fundamentals.growth_score(f"q_now_{field}", f"q_prior_{field}", band)
    a = fundamentals.growth_score(f"a_now_{field}", f"a_prior_{field}", band)
    return p.select("ticker", r6(F.coalesce(F.when(c("clean"), q), a)).alias("score"))


query("F12_ttm_growth", growth_sql("r", "r", 0.10))(lambda t: growth(t, "revenue", 0.10))
query("F13_revenue_growth", growth_sql("r", "r", 0.30))(lambda t: growth(t, "revenue", 0.30))
query("F14_earnings_growth", growth_sql("o", "o", 0.50))(lambda t: growth(t, "op_income", 0.50))


@query("F16_sector_relative_value", statement("entries", """
    SELECT ticker, round(CASE WHEN px > 0 AND spe > 0 THEN 1.0 - (greatest(0.5, least(2.0, px / spe)) - 0.5) / 1.5 ELSE 0.0 END, 6) AS score
    FROM entries JOIN (SELECT market, sector, sum(c_all)::DOUBLE / sum(q_all)::DOUBLE / 100.0 AS spe FROM entries GROUP BY 1, 2) s USING (market, sector)"""))
def _(t):
    spe = t.entries.groupBy("market", "sector").agg((F.sum("c_all") / F.sum("q_all") / 100.0).alias("spe"))
    return attach(t.entries.select("ticker", "market", "sector", "px"), spe, ["market", "sector"], "inner").select("ticker", r6(fundamentals.relative_value("px", "spe")).alias("score"))


# --- ownership ---------------------------------------------------------------------------

@query("F23_npr_spike", statement("tx", """
    SELECT pid, q, round(npr, 6) AS npr, round(npr - coalesce(base, npr), 6) + 0.0 AS spike, acq, disp
    FROM (SELECT *, row_number() OVER w AS rn, avg(npr) OVER (PARTITION BY pid ORDER BY q DESC ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS base
          FROM (SELECT pid, CAST(date_trunc('quarter', d) AS DATE) AS q, count(*) FILTER (code = 'P')::DOUBLE / count(*) AS npr, count(*) FILTER (code = 'P') AS acq, count(*) FILTER (code = 'S') AS disp
                FROM tx WHERE code IN ('P', 'S') GROUP BY 1, 2) a WINDOW w AS (PARTITION BY pid ORDER BY q DESC)) b WHERE rn = 1"""))
def _(t):
    return events.npr_spike(t.insider_tx).select("pid", "q", r6("npr").alias("npr"), r6("spike").alias("spike"), "acq", "disp")


CONGRESS_SQL = """SELECT cid, count(*) FILTER (type = 'Purchase') AS p, count(*) FILTER (type = 'Sale (Full)') AS s, min(age) AS r, count(*) FILTER (type = 'Purchase' AND age <= {b}) AS p30
    FROM ctx WHERE age <= {a} AND type IN ('Purchase', 'Sale (Full)') GROUP BY cid"""


@query("F27_congress_score", statement("ctx", f"SELECT c_custkey AS cid, round({congress('p', 's', 'r')}, 6) AS score FROM customer LEFT JOIN ({CONGRESS_SQL.format(a=730, b=180)}) z ON c_custkey = cid"))
def _(t):
    s = events.congress_summary(t.congress_rows(730), "cid", 730)
    j = t.customer.select(c("c_custkey").alias("cid")).join(s, "cid", "left")
    return j.select("cid", r6(ownership.congress("purchases", "sales", "recency_days")).alias("score"))


@query("F28_congress_surge", statement("ctx", f"""SELECT cid, round(CASE WHEN p30 / greatest(1.0, p * 30.0 / 180.0) > 1 THEN 1.0 + 0.25 * least(1.0, (p30 / greatest(1.0, p * 30.0 / 180.0) - 1.0) / 2.0) ELSE 1.0 END, 6) AS multiplier
    FROM ({CONGRESS_SQL.format(a=1460, b=365)}) z"""))
def _(t):
    kind = t.congress_rows(1460).where(c("type").isin("Purchase", "Sale (Full)"))
    buy = c("type") == "Purchase"
    s = kind.groupBy("cid").agg(count_when(buy).alias("p"), count_when(buy & (c("age") <= 365)).alias("p30"))
    return s.select("cid", r6(ownership.congress_surge("p30", "p")).alias("multiplier"))


# --- estimates and ratings -----------------------------------------------------------------

REVPCT = "(CASE WHEN k >= 3 AND abs(e2) >= 1e-6 THEN (e0 - e2) / abs(e2) END)"


@query("F32_analyst_revision", statement("est4", f"SELECT pid, round({REVISION.format(n='n', p=REVPCT)}, 6) AS score FROM est4", extra=FACTOR_VIEWS))
def _(t):
    return events.estimate_revision(t.estimates).select("pid", r6(consensus.revision("revision_pct", "n")).alias("score"))


@query("F33_analyst_revision_to_zero", statement("est4", f"SELECT pid, round(coalesce(CASE WHEN n >= 3 THEN ({clip(REVPCT, -0.3, 0.3)} + 0.3) / 0.6 * least(1.0, n / 10.0) END, 0.0), 6) AS score FROM est4", extra=FACTOR_VIEWS))
def _(t):
    return events.estimate_revision(t.estimates).select("pid", r6(consensus.revision_to_zero("revision_pct", "n")).alias("score"))


@query("F34_revision_percent", statement("est4", f"SELECT pid, round({REVPCT}, 6) AS revision_pct, n FROM est4", extra=FACTOR_VIEWS))
def _(t):
    return events.estimate_revision(t.estimates).select("pid", r6("revision_pct").alias("revision_pct"), "n")


@query("F36_revision_velocity", statement("vel", "SELECT pid, round(revision_velocity, 6) AS score FROM vel", extra=FACTOR_VIEWS))
def _(t):
    return events.estimate_velocity(t.estimates).select("pid", r6("revision_velocity").alias("score"))


REPORT_DAY = dt.date(2001, 6, 30)
REPORT_SQL = """SELECT pid, make_date(yr, 6, 15) AS d, CASE WHEN n % 4 <> 0 THEN est END AS eps_actual, lag(est) OVER (PARTITION BY pid ORDER BY yr) AS eps_est FROM est"""
SURPRISE_SQL = f"""SELECT pid, (eps_actual - eps_est) / abs(eps_est) AS surprise_pct, DATE '2001-06-30' - d AS days_since
    FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d DESC) AS rn FROM ({REPORT_SQL}) r WHERE eps_actual IS NOT NULL AND abs(eps_est) > 1e-6 AND d <= DATE '2001-06-30') z WHERE rn = 1"""


def reports(t):
    """Reported against expected figures per year; a quarter of the reports is still open."""
    from pyspark.sql import Window

    prev = F.lag("est").over(Window.partitionBy("pid").orderBy("yr"))
    return t.estimates.select(
        "pid", F.make_date(c("yr"), F.lit(6), F.lit(15)).alias("d"), F.when(c("n") % 4 != 0, c("est")).alias("eps_actual"), prev.alias("eps_est")
    )


@query("F37_earnings_surprise", statement("est", f"SELECT pid, round(surprise_pct, 6) AS surprise_pct, days_since FROM ({SURPRISE_SQL}) z"))
def _(t):
    return events.earnings_surprise(reports(t), "pid", REPORT_DAY).select("pid", r6("surprise_pct").alias("surprise_pct"), c("days_since").cast("long"))


LABEL_SQL = "(CASE n_lines % 7 WHEN 0 THEN 'Strong Buy' WHEN 1 THEN 'Buy' WHEN 2 THEN 'Hold' WHEN 3 THEN 'Sell' WHEN 4 THEN 'Strong Sell' END)"
CONS_SQL = """(CASE WHEN {t} < 2 THEN 0.0 WHEN {l} IS NOT NULL THEN CASE {l} WHEN 'Strong Buy' THEN 1.0 WHEN 'Buy' THEN 0.75 WHEN 'Hold' THEN 0.5 WHEN 'Sell' THEN 0.25 ELSE 0.0 END
    ELSE (r1 * 1.0 + r2 * 0.75 + r3 * 0.5 + r4 * 0.25)::DOUBLE / nullif({t}, 0) END)"""
SRC_SQL = "(CASE WHEN {t} < 2 THEN 'insufficient_coverage:' || {t} WHEN {l} IS NOT NULL THEN 'consensus:' || {l} || ':' || {t} ELSE 'consensus_computed:' || {t} END)"
COUNTS = ["r1", "r2", "r3", "r4", "r5"]


@query("F39_analyst_consensus", statement("entries", f"""SELECT ticker, round({CONS_SQL.format(t='(r1 + r2 + r3 + r4 + r5)', l=LABEL_SQL)}::DOUBLE, 6) AS score,
    {SRC_SQL.format(t='(r1 + r2 + r3 + r4 + r5)', l=LABEL_SQL)} AS source FROM entries WHERE n_lines IS NOT NULL"""))
def _(t):
    m = c("n_lines") % 7
    label = F.when(m == 0, "Strong Buy").when(m == 1, "Buy").when(m == 2, "Hold").when(m == 3, "Sell").when(m == 4, "Strong Sell")
    e = t.entries.where("n_lines IS NOT NULL").withColumn("label", label)
    return e.select("ticker", r6(consensus.consensus_score("label", COUNTS)).alias("score"), consensus.consensus_source("label", COUNTS).alias("source"))


BULK_SQL = """SELECT o_custkey, count(*) FILTER (o_orderpriority LIKE '1%') AS r1, count(*) FILTER (o_orderpriority LIKE '2%') AS r2, count(*) FILTER (o_orderpriority LIKE '3%') AS r3,
    count(*) FILTER (o_orderpriority LIKE '4%') AS r4, count(*) FILTER (o_orderpriority LIKE '5%') AS r5 FROM orders GROUP BY 1"""


def ratings(t):
    return t.orders.groupBy("o_custkey").agg(*[count_when(c("o_orderpriority").startswith(str(i))).alias(f"r{i}") for i in range(1, 6)])


@query("F40_consensus_by_symbol", f"""SELECT c_custkey AS cid, round(coalesce(CASE WHEN r1 + r2 + r3 + r4 + r5 < 2 THEN 0.0 ELSE (r1 * 1.0 + r2 * 0.75 + r3 * 0.5 + r4 * 0.25)::DOUBLE / (r1 + r2 + r3 + r4 + r5) END, 0.0), 6) AS score,
    CASE WHEN r1 IS NULL THEN 'no_coverage' WHEN r1 + r2 + r3 + r4 + r5 < 2 THEN 'insufficient_coverage:' || (r1 + r2 + r3 + r4 + r5) ELSE 'consensus_computed:' || (r1 + r2 + r3 + r4 + r5) END AS source
    FROM customer LEFT JOIN ({BULK_SQL}) b ON c_custkey = o_custkey""")
def _(t):
    none = F.lit(None).cast("string")
    j = t.customer.select("c_custkey").join(ratings(t), c("c_custkey") == c("o_custkey"), "left")
    covered = c("r1").isNotNull()
    return j.select(
        c("c_custkey").alias("cid"),
        r6(F.when(covered, consensus.consensus_score(none, COUNTS)).otherwise(0.0)).alias("score"),
        F.when(covered, consensus.consensus_source(none, COUNTS)).otherwise("no_coverage").alias("source"),
    )


GRADE_SQL = "(CASE substr({0}, 1, 1) WHEN '1' THEN 1.0 WHEN '2' THEN 0.75 WHEN '3' THEN 0.5 WHEN '4' THEN 0.10 ELSE 0.0 END)::DOUBLE"


@query("F41_rating_change", f"""SELECT cid, action, days_ago, round({GRADE_SQL.format('p')} - {GRADE_SQL.format('prev')}, 6) + 0.0 AS score_delta FROM (
    SELECT o_custkey AS cid, CASE o_orderstatus WHEN 'F' THEN 'upgrade' WHEN 'O' THEN 'downgrade' ELSE 'initiate' END AS action, DATE '2001-08-01' - CAST(o_orderdate AS DATE) AS days_ago, o_orderpriority AS p,
           CASE o_orderkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '4' ELSE '5' END AS prev,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders WHERE DATE '2001-08-01' - CAST(o_orderdate AS DATE) <= 60) z WHERE rn = 1""")
def _(t):
    def grade(i):
        return F.when(i == 1, "strongbuy").when(i == 2, "buy").when(i == 3, "hold").when(i == 4, "sell").otherwise("strongsell")

    s = c("o_orderstatus")
    rows = t.orders.select(
        c("o_custkey").alias("cid"), "o_orderkey", "o_orderdate",
        consensus.rating_action(F.when(s == "F", "Upgrade to").when(s == "O", "Downgrade to").otherwise("Initiated coverage")).alias("action"),
        grade(c("o_orderpriority").substr(1, 1).cast("int")).alias("to_grade"), grade(c("o_orderkey") % 5 + 1).alias("from_grade"),
        F.datediff(F.lit(dt.date(2001, 8, 1)), F.to_date("o_orderdate")).cast("long").alias("days_ago"),
    ).where((c("days_ago") <= 60) & c("action").isNotNull())
    top = events.newest_n(rows, ["cid"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 1)
    from ..functions.common import lookup

    delta = lookup(consensus.GRADE_SCORE, "to_grade") - lookup(consensus.GRADE_SCORE, "from_grade")
    return top.select("cid", "action", "days_ago", r6(delta).alias("score_delta"))


# --- news and text -------------------------------------------------------------------------

NEWS_SQL = "(CASE WHEN directional = 1 THEN (vw / nullif(ww, 0) + 1) / 2 ELSE 0.0 END)"


@query("F42_news_sentiment", statement("news", f"SELECT pid AS uid, round({NEWS_SQL}, 6) AS score FROM news"))
def _(t):
    return events.news_sentiment(t.articles).select("uid", r6("sentiment").alias("score"))


@query("F43_news_buzz", statement("news", f"SELECT pid AS uid, round({log_sat('n_recent::DOUBLE', 50)}, 6) AS score FROM news"))
def _(t):
    return events.news_sentiment(t.articles).select("uid", r6(text.buzz("n_recent")).alias("score"))


@query("F44_sentiment_with_surprise", statement("news est", f"""
    SELECT pid, round(CASE WHEN n_articles > 0 AND surprise_pct IS NOT NULL AND days_since <= 90 THEN greatest(0.0, least(1.0, {NEWS_SQL} + greatest(-0.2, least(0.2, surprise_pct * 0.5 * exp(-days_since * ln(2.0) / 20.0)))))
           ELSE {NEWS_SQL} END, 6) AS score FROM news LEFT JOIN ({SURPRISE_SQL}) s USING (pid)"""))
def _(t):
    n = events.news_sentiment(t.articles).withColumnRenamed("uid", "pid")
    s = events.earnings_surprise(reports(t), "pid", REPORT_DAY)
    j = n.join(s, "pid", "left").withColumn("covered", c("n_articles") > 0)
    return j.select("pid", r6(consensus.sentiment_with_surprise("sentiment", "surprise_pct", "days_since", "covered")).alias("score"))


def has(words):
    return " + ".join(f"(CASE WHEN list_contains(w, '{x}') THEN 1 ELSE 0 END)" for x in words)


def planted_headlines(t):
    """Documents with known words appended: one good word, two bad ones, one of each, or none, by doc_id."""
    def word(words, k):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(k, F.lit(len(words))) + 1).cast("int"))

    k = F.floor(c("doc_id") / 4)
    end = F.when(c("doc_id") % 4 == 0, word(text.BULL_WORDS, k)).when(c("doc_id") % 4 == 1, F.concat_ws(" ", word(text.BEAR_WORDS, k), word(text.BEAR_WORDS, k + 1)))
    return t.documents.withColumn("text", F.concat_ws(" ", "text", end.when(c("doc_id") % 4 == 2, F.concat_ws(" ", word(text.BEAR_WORDS, k), word(text.BULL_WORDS, k)))))


def word_sql(words, k):
    return f"([{', '.join(repr(w) for w in words)}])[1 + ({k}) % {len(words)}]"


PLANTED_SQL = f"""SELECT source, concat_ws(' ', text, CASE doc_id % 4 WHEN 0 THEN {word_sql(text.BULL_WORDS, 'doc_id // 4')} WHEN 1 THEN {word_sql(text.BEAR_WORDS, 'doc_id // 4')} || ' ' || {word_sql(text.BEAR_WORDS, 'doc_id // 4 + 1')}
    WHEN 2 THEN {word_sql(text.BEAR_WORDS, 'doc_id // 4')} || ' ' || {word_sql(text.BULL_WORDS, 'doc_id // 4')} END) AS text, doc_id % 4 AS kind FROM documents"""


@query("F45_headline_lexicon", f"""SELECT source, kind, round(avg(s), 6) AS score, count(s) AS n FROM (SELECT source, kind, CASE WHEN up + dn > 0 THEN greatest(0.1, least(0.9, 0.5 + 0.2 * (up - dn)))::DOUBLE END AS s
    FROM (SELECT source, kind, {has(text.BULL_WORDS)} AS up, {has(text.BEAR_WORDS)} AS dn FROM (SELECT source, kind, regexp_split_to_array(lower(text), '\\s+') AS w FROM ({PLANTED_SQL}) p) a) b) q GROUP BY source, kind""")
def _(t):
    d = planted_headlines(t).select("source", (c("doc_id") % 4).alias("kind"), text.headline_score("text").alias("s"))
    return d.groupBy("source", "kind").agg(r6(F.avg("s")).alias("score"), F.count("s").alias("n"))


@query("F46_headline_buzz", f"SELECT source, lang, count(*) AS n, round({log_sat('count(*)::DOUBLE', 50)}, 6) AS score FROM documents GROUP BY source, lang")
def _(t):
    return t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).select("source", "lang", "n", r6(text.buzz("n")).alias("score"))


UP, DOWN, KEEP = ("the ", "and "), ("of ", "ing "), ("that ", "with ", "ouque")


def n_of(phrases):
    return " + ".join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in phrases)


@query("F47_transcript_tone", f"""SELECT doc_id, up::BIGINT AS n_raise, dn::BIGINT AS n_lower, ke::BIGINT AS n_keep,
    (CASE WHEN up + dn + ke = 0 THEN NULL WHEN up > dn AND up > ke THEN 0.80 WHEN dn > up AND dn > ke THEN 0.20 ELSE 0.55 END)::DOUBLE AS score
    FROM (SELECT doc_id, {n_of(UP)} AS up, {n_of(DOWN)} AS dn, {n_of(KEEP)} AS ke FROM documents WHERE length(text) > 0) z""")
def _(t):
    said = t.documents.where(F.length("text") > 0).select("doc_id", text.phrase_counts(F.lower("text"), n_raise=UP, n_lower=DOWN, n_keep=KEEP).alias("n"))
    d = said.select("doc_id", *[c(f"n.{n}").cast("long").alias(n) for n in ("n_raise", "n_lower", "n_keep")])
    return d.withColumn("score", text.tone("n_raise", "n_lower", "n_keep"))


PHRASES = (("n_raise", text.RAISE_PHRASES), ("n_lower", text.LOWER_PHRASES), ("n_keep", text.MAINTAIN_PHRASES))
# turns by (conv_id + turn) % 4: a raise, two lowerings, a maintained guidance and a lowering, nothing
PLANTED_TURNS = "CASE (conv_id + turn) % 4 WHEN 0 THEN {r} WHEN 1 THEN {l} || '; ' || {l2} WHEN 2 THEN {k} || '; ' || {l} END".format(
    r=word_sql(text.RAISE_PHRASES, "conv_id"), l=word_sql(text.LOWER_PHRASES, "conv_id"), l2=word_sql(text.LOWER_PHRASES, "conv_id + 3"), k=word_sql(text.MAINTAIN_PHRASES, "conv_id"))


@query("F47_transcript_tone_conversations", """SELECT conv_id, turn, up AS n_raise, dn AS n_lower, ke AS n_keep, (CASE WHEN up + dn + ke = 0 THEN NULL WHEN up > dn AND up > ke THEN 0.80 WHEN dn > up AND dn > ke THEN 0.20 ELSE 0.55 END)::DOUBLE AS score FROM (
    SELECT conv_id, turn, """ + ", ".join("(" + " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in ps) + f")::BIGINT AS {n}" for n, ps in
    (("up", text.RAISE_PHRASES), ("dn", text.LOWER_PHRASES), ("ke", text.MAINTAIN_PHRASES))) + f" FROM (SELECT conv_id, turn, lower(concat_ws(' ', text, {PLANTED_TURNS})) AS text FROM conversations) y WHERE length(text) > 0) z")
def _(t):
    def phrase(words, k):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(k, F.lit(len(words))) + 1).cast("int"))

    k, id_ = (c("conv_id") + c("turn")) % 4, c("conv_id")
    down = phrase(text.LOWER_PHRASES, id_)
    end = F.when(k == 0, phrase(text.RAISE_PHRASES, id_)).when(k == 1, F.concat_ws("; ", down, phrase(text.LOWER_PHRASES, id_ + 3))).when(k == 2, F.concat_ws("; ", phrase(text.MAINTAIN_PHRASES, id_), down))
    turns = t.conversations.withColumn("text", F.lower(F.concat_ws(" ", "text", end))).where(F.length("text") > 0)
    said = turns.select("conv_id", "turn", text.phrase_counts("text", **dict(PHRASES)).alias("n"))
    d = said.select("conv_id", "turn", *[c(f"n.{n}").cast("long").alias(n) for n, _ in PHRASES])
    return d.withColumn("score", text.tone("n_raise", "n_lower", "n_keep"))


# --- bundles -----------------------------------------------------------------------------

def bundle(name, region):
    """The raw columns of one region's pillars."""
    names = bundles.region_factors(region)
    sql = "SELECT ticker, " + ", ".join(f"round({n}, {digits(n)}) AS {n}" for n in names) + f" FROM pin WHERE region = '{region}'"

    @query(name, statement("pin", sql, extra=FACTOR_VIEWS))
    def _(t):
        p = bundles.all_pillar_inputs(t.entries, t.estimates).where(c("region") == region)
        return p.select("ticker", *[F.round(n, digits(n)).alias(n) for n in names])


bundle("F48_pillar_inputs_us", "US")
bundle("F49_pillar_inputs_intl", "EU")
bundle("F49_pillar_inputs_asia", "ASIA")


@query("F50_all_factors", statement("pin", "SELECT ticker, market, " + ", ".join(f"round({n}, {digits(n)}) AS {n}" for n in PILLAR_SQL) + " FROM pin", extra=FACTOR_VIEWS))
def _(t):
    p = bundles.all_pillar_inputs(t.entries, t.estimates)
    return p.select("ticker", "market", *[F.round(n, digits(n)).alias(n) for n in PILLAR_SQL])


@query("F51_price_only", statement("entries", "SELECT ticker, round(momentum_long, 6) AS momentum_long, round(volume_attention, 6) AS volume_attention, NULL::DOUBLE AS insider_conviction, NULL::DOUBLE AS analyst_consensus FROM entries"))
def _(t):
    p = bundles.price_only(t.entries)
    return p.select("ticker", *[r6(n).alias(n) for n in p.columns[1:]])


@query("F52_guarded_flow", statement("tx", f"""SELECT p_partkey AS pid, round({flow13f('ih', 'dih', 'inc', 'red', 'dih / 2.0')}, 6) AS score FROM part LEFT JOIN (
    SELECT pid, count(*) FILTER (age <= 365) AS ih, count(*) FILTER (age <= 365) - count(*) FILTER (age BETWEEN 366 AND 730) AS dih, count(*) FILTER (code = 'P') AS inc, count(*) FILTER (code = 'S') AS red
    FROM tx WHERE age <= 730 GROUP BY pid HAVING count(*) FILTER (age <= 365) >= 4) z ON p_partkey = pid"""))
def _(t):
    recent = c("age") <= 365
    s = t.insider_rows(730).groupBy("pid").agg(
        count_when(recent).alias("ih"), (count_when(recent) - count_when(~recent)).alias("dih"),
        count_when(c("code") == "P").alias("inc"), count_when(c("code") == "S").alias("red"),
    ).where("ih >= 4")
    j = t.part.select(c("p_partkey").alias("pid")).join(s, "pid", "left")
    return j.select("pid", r6(ownership.flow_13f("ih", "dih", "inc", "red", c("dih") / 2.0)).alias("score"))
