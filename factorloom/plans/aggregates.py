"""Aggregation, research and monitoring queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import INSIDER_CEILING, SUFFIX_CURRENCY, gate_table
from ..functions.common import lookup, r6, ratio
from ..operators import events, quality, ranking, research, xs
from ..operators.positions import positions
from ..oracles.base import statement
from ..views import SNAP_FACTORS, US_FACTORS, count_when
from .composites import PILLAR_VIEWS, pillar_rows
from .joins import BARS_NO, PREV, TURNOVER_SQL, clusters, prev_curr, trades, CLUSTER_SQL
from .predicates import SUFFIX
from .registry import query
from .windows import NEUTRAL_VIEW


def c(name):
    return F.col(name)


N = lambda: F.count(F.lit(1))

# --- transactions ------------------------------------------------------------------------


@query("A01_congress_counts", statement("ctx", """SELECT ticker, count(*) FILTER (type = 'Purchase') AS purchases, count(*) FILTER (type = 'Sale (Full)') AS sales, count(*) AS total
    FROM (SELECT CASE WHEN cid % 50 = 0 THEN 'N/A' ELSE ticker END AS ticker, type, age FROM ctx) z WHERE age <= 1095 AND type <> 'Exchange' AND ticker NOT IN ('N/A', '--', '', 'NONE', 'NO TICKER') GROUP BY ticker"""))
def _(t):
    kind = F.lower("type")
    tx = t.congress_rows(1095).withColumn("ticker", F.upper(F.trim(F.when(c("cid") % 50 == 0, "n/a ").otherwise(c("ticker")))))
    ok = tx.where((kind.contains("purchase") | kind.contains("sale")) & ~c("ticker").isin("N/A", "--", "", "NONE", "NO TICKER"))
    buy = kind.contains("purchase")
    return ok.groupBy("ticker").agg(count_when(buy).alias("purchases"), count_when(~buy).alias("sales"), N().alias("total"))


@query("A02_congress_summary", statement("ctx", """SELECT cid, count(*) FILTER (type = 'Purchase') AS purchases, count(*) FILTER (type = 'Sale (Full)') AS sales, count(*) FILTER (type = 'Purchase') - count(*) FILTER (type = 'Sale (Full)') AS net,
    min(age) AS recency_days, array_to_string(list_sort(list(DISTINCT member)), ',') AS members FROM ctx WHERE age <= 1460 AND type <> 'Exchange' GROUP BY cid"""))
def _(t):
    s = events.congress_summary(t.congress_rows(1460), "cid", 1460)
    return s.select("cid", "purchases", "sales", "net", c("recency_days").cast("long"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query("A03_insider_purchases", statement("tx", "SELECT pid, round(sum(value_c) / 100.0, 2) AS usd, min(age) AS recency FROM tx WHERE code = 'P' AND shares > 0 AND value_c > 0 AND age <= 365 GROUP BY pid"))
def _(t):
    p = t.insider_rows(365, "P").where("shares > 0 AND value_c > 0")
    return p.groupBy("pid").agg(F.round(F.sum("value_c") / 100.0, 2).alias("usd"), F.min("age").cast("long").alias("recency"))


@query("A04_insider_sides", statement("tx", "SELECT pid, insider_id, code AS side, d FROM tx WHERE code IN ('P', 'S') AND age <= 90"))
def _(t):
    return t.insider_rows(90).where("code IN ('P', 'S')").select("pid", "insider_id", c("code").alias("side"), "d")


@query("A05_purchase_windows", statement("tx", """SELECT pid, count(*) FILTER (age <= 30) AS n30, count(*) FILTER (age BETWEEN 31 AND 180) AS n31_180, sum(value_c)::BIGINT AS total_c, coalesce(sum(value_c) FILTER (is_ceo), 0)::BIGINT AS csuite_c
    FROM tx WHERE code = 'P' AND age <= 180 GROUP BY pid"""))
def _(t):
    p = t.insider_rows(180, "P")
    return p.groupBy("pid").agg(
        count_when(c("age") <= 30).alias("n30"), count_when(c("age") > 30).alias("n31_180"), F.sum("value_c").alias("total_c"),
        F.coalesce(F.sum(F.when(c("is_ceo"), c("value_c"))), F.lit(0).cast("long")).alias("csuite_c"),
    )


@query("A06_seasonal_names", """
    WITH dd AS (SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) AS d, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / sum(CAST(l_quantity AS BIGINT))::DOUBLE AS close FROM lineitem WHERE month(l_shipdate) = 3 GROUP BY 1, 2),
         m AS (SELECT sid, year(d) AS y, arg_min(close, d) AS f, arg_max(close, d) AS l, count(*) AS k FROM dd GROUP BY 1, 2)
    SELECT sid, round(avg(CASE WHEN l > f THEN 1 ELSE 0 END), 6) AS win_rate, round(median(l / f - 1), 6) AS median_return, count(*) AS years FROM m WHERE k >= 2 GROUP BY sid HAVING count(*) >= 5
    ORDER BY win_rate DESC, median_return DESC, sid LIMIT 10""")
def _(t):
    daily = t.lineitem.where(F.month("l_shipdate") == 3).groupBy(c("l_suppkey").alias("sid"), F.to_date("l_shipdate").alias("d")).agg(
        (F.sum(F.round(c("l_extendedprice") * 100).cast("long")) / F.sum(c("l_quantity").cast("long"))).alias("close")
    )
    m = daily.groupBy("sid", F.year("d").alias("y")).agg(F.min_by("close", "d").alias("f"), F.max_by("close", "d").alias("l"), N().alias("k")).where("k >= 2")
    s = m.groupBy("sid").agg(
        r6(F.avg((c("l") > c("f")).cast("int"))).alias("win_rate"), r6(F.median(ratio("l", "f") - 1)).alias("median_return"), N().alias("years")
    ).where("years >= 5")  # the median sees one value per calendar year
    return s.orderBy(F.desc("win_rate"), F.desc("median_return"), "sid").limit(10)


@query("A07_buyback_yield", statement("entries tx", """
    SELECT ticker, round(rep / 100.0 / market_cap * 1000, 6) AS buyback_yield, round(px1 / px_low, 6) AS price_vs_low FROM entries JOIN (
        SELECT pid, sum(abs(v)) AS rep FROM (SELECT pid, v, row_number() OVER (PARTITION BY pid ORDER BY q DESC) AS rn FROM (SELECT pid, date_trunc('quarter', d) AS q, sum(value_c) AS v FROM tx WHERE code = 'S' GROUP BY 1, 2) a) b WHERE rn <= 4 GROUP BY pid) r USING (pid)
    WHERE cr * 15 < 25 AND px_low > 0 AND px1 < 3.0 * px_low AND market_cap > 0 ORDER BY rep / 100.0 / market_cap DESC, ticker LIMIT 10"""))
def _(t):
    quarters = t.insider_rows(code="S").groupBy("pid", F.date_trunc("quarter", "d").alias("q")).agg(F.sum("value_c").alias("v"))
    rep = events.newest_n(quarters, ["pid"], [F.desc("q")], 4).groupBy("pid").agg(F.sum(F.abs("v")).alias("rep"))
    e = t.entries.where("cr * 15 < 25 AND px_low > 0 AND px1 < 3.0 * px_low AND market_cap > 0").join(rep, "pid")
    y = c("rep") / 100.0 / c("market_cap")
    return e.withColumn("y", y).orderBy(F.desc("y"), "ticker").limit(10).select("ticker", r6(c("y") * 1000).alias("buyback_yield"), r6(ratio("px1", "px_low")).alias("price_vs_low"))


ADV_SQL = """SELECT sid, median(close * volume) AS adv FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d DESC) AS rn FROM bars) z WHERE rn <= 60 GROUP BY sid HAVING count(*) >= 30"""


def dollar_volume(bars, n=60, min_obs=30):
    """Median dollar volume of the newest n bars per name; a median over at most n values."""
    top = events.newest_n(bars, ["sid"], [F.desc("d")], n)
    return top.groupBy("sid").agg(F.median(c("close") * c("volume")).alias("adv"), N().alias("obs")).where(c("obs") >= min_obs).drop("obs")


@query("A08_median_dollar_volume", statement("bars uni", f"SELECT ticker, round(adv, 4) AS adv FROM ({ADV_SQL}) a JOIN uni USING (sid) WHERE adv >= CASE cap_tier WHEN 'large' THEN 200000.0 ELSE 150000.0 END"))
def _(t):
    floor = F.when(c("cap_tier") == "large", 200000.0).otherwise(150000.0)
    j = dollar_volume(t.bars).join(t.universe.select("sid", "ticker", "cap_tier"), "sid").where(c("adv") >= floor)
    return j.select("ticker", F.round("adv", 4).alias("adv"))


# --- back-test statistics ------------------------------------------------------------------

STATS = """count(*) AS n, round(avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END), 6) AS win_rate, round(avg(ret), 6) AS avg_return, round(median(ret), 6) AS median_return, round(min(ret), 6) AS worst_return,
    round(sum(ret) FILTER (ret > 0) / abs(sum(ret) FILTER (ret < 0)), 6) AS profit_factor, round(coalesce(avg(alpha), 0.0), 6) AS avg_alpha"""
STAT_COLUMNS = ["win_rate", "avg_return", "median_return", "worst_return", "profit_factor", "avg_alpha"]


@query("A09_horizon_stats", statement("trades", f"SELECT horizon, {STATS} FROM trades WHERE ret IS NOT NULL GROUP BY horizon", extra=BARS_NO))
def _(t):
    s = research.horizon_stats(trades(t), ["horizon"])
    return s.select("horizon", "n", *[r6(k).alias(k) for k in STAT_COLUMNS])


@query("A10_backtest_metrics", statement("trades", f"""
    SELECT 'badge' AS kind, badge AS label, horizon, {STATS} FROM trades WHERE ret IS NOT NULL GROUP BY badge, horizon UNION ALL SELECT 'cap_tier', cap_tier, horizon, {STATS} FROM trades WHERE ret IS NOT NULL AND horizon = 3 GROUP BY cap_tier, horizon
    UNION ALL SELECT 'era', era, horizon, {STATS} FROM trades WHERE ret IS NOT NULL AND horizon = 3 GROUP BY era, horizon""", extra=BARS_NO))
def _(t):
    s = research.horizon_stats_by(trades(t), ["badge", "cap_tier", "era"]).where("kind = 'badge' OR horizon = 3")
    return s.select("kind", "label", "horizon", "n", *[r6(k).alias(k) for k in STAT_COLUMNS])


@query("A10_worst_trades", statement("trades", "SELECT sid, anchor, round(ret, 6) AS ret FROM trades WHERE ret IS NOT NULL AND horizon = 3 ORDER BY trades.ret, sid, anchor LIMIT 3", extra=BARS_NO))
def _(t):
    w = trades(t).where("ret IS NOT NULL AND horizon = 3").orderBy("ret", "sid", "anchor").limit(3)
    return w.select("sid", "anchor", r6("ret").alias("ret"))


CCY = f"CASE {SUFFIX.format('ticker')} " + " ".join(f"WHEN '{s}' THEN '{k}'" for s, k in SUFFIX_CURRENCY.items()) + " ELSE 'USD' END"
REGION_VIEW = {
    **PILLAR_VIEWS,
    "rm": (("v3", "entries"), "SELECT v.ticker, v.market, round(v.final_v3, 6) AS s, v.coverage, v.low_coverage, e.mom_ret AS fwd, e.pid FROM v3 v JOIN entries e USING (ticker)"),
}


def region_rows(t):
    """Pillar scores next to the forward return, stored once: every figure of a report reads them, and the join is not made again for each."""
    return t.stored("region-rows", lambda: pillar_rows(t).select("ticker", "market", r6("final_score").alias("s"), "coverage", "low_coverage").join(
        t.entries.select("ticker", "pid", c("mom_ret").alias("fwd")), "ticker"
    ))


RANKED_RM = """SELECT *, rank() OVER (PARTITION BY market ORDER BY s) + (count(*) OVER (PARTITION BY market, s) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY market ORDER BY fwd) + (count(*) OVER (PARTITION BY market, fwd) - 1) / 2.0 AS rb,
    row_number() OVER (PARTITION BY market ORDER BY s DESC, pid) - 1 AS pos, count(*) OVER (PARTITION BY market) AS n FROM rm WHERE s IS NOT NULL AND fwd IS NOT NULL"""


@query("A11_region_metrics", statement("rm", f"""
    SELECT market, n, score_mean, score_sigma, coverage_mean, low_coverage_count, mix AS top20_currency_mix, round(ic, 6) AS ic FROM (
        SELECT market, count(*) AS n, round(avg(s), 9) AS score_mean, round(stddev_pop(s), 6) AS score_sigma, round(avg(coverage), 6) AS coverage_mean, count(*) FILTER (low_coverage) AS low_coverage_count FROM rm WHERE s IS NOT NULL GROUP BY market) a
    JOIN (SELECT market, string_agg(ccy || ':' || k, ',' ORDER BY ccy) AS mix FROM (SELECT market, ccy, count(*) AS k FROM (SELECT market, {CCY} AS ccy, row_number() OVER (PARTITION BY market ORDER BY s DESC, ticker) AS rn FROM rm WHERE s IS NOT NULL) q WHERE rn <= 20 GROUP BY 1, 2) w GROUP BY market) b USING (market)
    LEFT JOIN (SELECT market, CASE WHEN count(*) >= 5 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS ic FROM ({RANKED_RM}) z GROUP BY market) d USING (market)""", extra=REGION_VIEW))
def _(t):
    rows = region_rows(t).where("s IS NOT NULL")
    s = rows.groupBy("market").agg(
        N().alias("n"), F.round(F.avg("s"), 9).alias("score_mean"), r6(F.stddev_pop("s")).alias("score_sigma"), r6(F.avg("coverage")).alias("coverage_mean"),
        count_when(c("low_coverage")).alias("low_coverage_count"),
    )
    top = ranking.top_per(rows, ["market"], 20, "s").groupBy("market", quality.currency_of("ticker").alias("ccy")).agg(N().alias("k"))
    mix = top.groupBy("market").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "ccy", c("k").cast("string")))), ",").alias("top20_currency_mix"))
    ic = xs.spearman(rows, ["market"], "s", "fwd", "ic").where("n >= 5").select("market", r6("ic").alias("ic"))
    return s.join(mix, "market").join(ic, "market", "left")


@query("A12_quintile_spread", statement("rm", f"""
    SELECT market, round(avg(fwd) FILTER (pos < greatest(1, n // 5)) - avg(fwd) FILTER (pos >= n - greatest(1, n // 5)), 6) AS spread FROM ({RANKED_RM}) z GROUP BY market""", extra=REGION_VIEW))
def _(t):
    rows = region_rows(t).where("s IS NOT NULL AND fwd IS NOT NULL").select("market", "pid", "s", "fwd")
    p = positions(rows, ["market"], "s", "pid")
    q = F.greatest(F.lit(1), F.floor(c("n") / 5))
    ends = p.groupBy("market").agg(F.avg(F.when(c("pos0") < q, c("fwd"))).alias("top"), F.avg(F.when(c("pos0") >= c("n") - q, c("fwd"))).alias("bottom"))
    return ends.select("market", r6(c("top") - c("bottom")).alias("spread"))


@query("A13_sparsity_map", statement("ls", "SELECT market, factor, round(avg(CASE WHEN score IS NULL THEN 1 ELSE 0 END), 6) AS none_rate, round(avg(CASE WHEN score = 0 THEN 1 ELSE 0 END), 6) AS dead_rate FROM ls GROUP BY 1, 2"))
def _(t):
    dead = F.coalesce(c("score") == 0, F.lit(False)).cast("int")
    return t.long_scores.groupBy("market", "factor").agg(r6(F.avg(c("score").isNull().cast("int"))).alias("none_rate"), r6(F.avg(dead)).alias("dead_rate"))


@query("A14_bucket_sigma", statement("entries", "SELECT market, sector, cap_tier, round(stddev_pop(final_score), 6) AS sigma FROM entries GROUP BY 1, 2, 3 HAVING count(*) >= 2"))
def _(t):
    s = t.entries.groupBy("market", "sector", "cap_tier").agg(r6(F.stddev_pop("final_score")).alias("sigma"), N().alias("n"))
    return s.where("n >= 2").drop("n")


OVERLAP = {**REGION_VIEW, "bothv": (("rm", "entries"), "SELECT e.ticker, e.market, e.final_score AS a, r.s AS b, r.coverage FROM entries e LEFT JOIN rm r USING (ticker)")}


def both_scores(t):
    b = region_rows(t).select("ticker", c("s").alias("b"), "coverage")
    return t.entries.select("ticker", "market", c("final_score").alias("a")).join(b, "ticker", "left")


@query("T10_top_n_overlap", statement("bothv", """SELECT market, n_rows, CASE WHEN n_rows >= 20 THEN k / 20.0::DOUBLE END AS overlap FROM (SELECT market, count(*) AS n_rows, count(*) FILTER (ra <= 20 AND rb <= 20) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY market ORDER BY a DESC, ticker) AS ra, row_number() OVER (PARTITION BY market ORDER BY b DESC, ticker) AS rb FROM bothv WHERE b IS NOT NULL) z GROUP BY market) q""", extra=OVERLAP))
def _(t):
    return ranking.overlap(both_scores(t), "a", "b", 20, ["market"]).select("market", "n_rows", "overlap")


@query("A15_version_report", statement("bothv", """SELECT market, count(*) AS n_rows, count(b) AS paired, round(avg(coverage), 6) AS coverage_mean, round(min(coverage), 6) AS coverage_min,
    round(max(rho), 6) AS rho, max(k) / 20.0::DOUBLE AS overlap FROM bothv LEFT JOIN (SELECT market, covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) AS rho, count(*) FILTER (ta <= 20 AND tb <= 20) AS k FROM (
        SELECT market, rank() OVER (PARTITION BY market ORDER BY a) + (count(*) OVER (PARTITION BY market, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY market ORDER BY b) + (count(*) OVER (PARTITION BY market, b) - 1) / 2.0 AS rb,
               row_number() OVER (PARTITION BY market ORDER BY a DESC, ticker) AS ta, row_number() OVER (PARTITION BY market ORDER BY b DESC, ticker) AS tb FROM bothv WHERE b IS NOT NULL) z GROUP BY market) q USING (market) GROUP BY market""", extra=OVERLAP))
def _(t):
    rows = both_scores(t)
    s = rows.groupBy("market").agg(N().alias("n_rows"), F.count("b").alias("paired"), r6(F.avg("coverage")).alias("coverage_mean"), r6(F.min("coverage")).alias("coverage_min"))
    rho = xs.spearman(rows, ["market"], "a", "b").select("market", r6("rho").alias("rho"))
    top = ranking.overlap(rows, "a", "b", 20, ["market"]).select("market", "overlap")
    return s.join(rho, "market", "left").join(top, "market", "left")


# --- information coefficients ----------------------------------------------------------------

IC_SQL = """SELECT d, factor, n, covar / (sa * sb) AS ic FROM (SELECT d, factor, count(*) AS n, covar_pop(ra, rb) AS covar, stddev_pop(ra) AS sa, stddev_pop(rb) AS sb FROM (
    SELECT d, factor, rank() OVER (PARTITION BY d, factor ORDER BY score) + (count(*) OVER (PARTITION BY d, factor, score) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY d, factor ORDER BY fwd_x) + (count(*) OVER (PARTITION BY d, factor, fwd_x) - 1) / 2.0 AS rb
    FROM sl WHERE score IS NOT NULL AND fwd_x IS NOT NULL) r GROUP BY d, factor) z WHERE sa > 1e-12 AND sb > 1e-12"""
IC_VIEWS = {"ics": (("sl",), IC_SQL)}


def ic_rows(t):
    """IC per (date, factor), stored once for the aggregate reports."""
    return t.stored("ic", lambda: research.snapshot_ic(t.snaps_long, "fwd_x"))


@query("W13_spearman_by_market", statement("sl", """SELECT d, market, factor, n, round(CASE WHEN sa > 1e-12 AND sb > 1e-12 THEN covar / (sa * sb) END, 6) AS rho FROM (SELECT d, market, factor, count(*) AS n, covar_pop(ra, rb) AS covar, stddev_pop(ra) AS sa, stddev_pop(rb) AS sb FROM (
    SELECT d, market, factor, rank() OVER (PARTITION BY d, market, factor ORDER BY score) + (count(*) OVER (PARTITION BY d, market, factor, score) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY d, market, factor ORDER BY fwd_x) + (count(*) OVER (PARTITION BY d, market, factor, fwd_x) - 1) / 2.0 AS rb
    FROM sl WHERE score IS NOT NULL AND fwd_x IS NOT NULL) r GROUP BY 1, 2, 3) z"""))
def _(t):
    """Every factor of every snapshot and market in one pass."""
    return xs.spearman(t.snaps_long, ["d", "market", "factor"], "score", "fwd_x").select("d", "market", "factor", "n", r6("rho").alias("rho"))


@query("W14_snapshot_ic", statement("ics", "SELECT d, factor, n, round(ic, 6) AS ic FROM ics", extra=IC_VIEWS))
def _(t):
    return research.snapshot_ic(t.snaps_long, "fwd_x").select("d", "factor", "n", r6("ic").alias("ic"))


@query("W15_ic_series", statement("ics", "SELECT d, round(ic, 6) AS ic FROM ics WHERE factor = 'mom' ORDER BY d", extra=IC_VIEWS))
def _(t):
    return ic_rows(t).where("factor = 'mom'").orderBy("d").select("d", r6("ic").alias("ic"))


CORR_SQL = """
    SELECT market, factor_a, factor_b, round(rho, 6) AS rho, round(density_a, 6) AS density_a, round(density_b, 6) AS density_b,
           CASE WHEN density_a < 0.2 OR density_b < 0.2 THEN 'sparse' WHEN abs(rho) >= 0.75 THEN 'error' WHEN abs(rho) >= 0.5 THEN 'warn' ELSE 'ok' END AS level
    FROM (SELECT market, factor_a, factor_b, CASE WHEN sa > 1e-12 AND sb > 1e-12 THEN cv / (sa * sb) END AS rho, density_a, density_b FROM (
        SELECT a.market, a.factor AS factor_a, b.factor AS factor_b, covar_pop(a.r, b.r) AS cv, stddev_pop(a.r) AS sa, stddev_pop(b.r) AS sb, avg(CASE WHEN a.s <> 0 THEN 1 ELSE 0 END) AS density_a, avg(CASE WHEN b.s <> 0 THEN 1 ELSE 0 END) AS density_b
        FROM rk a JOIN rk b ON a.ticker = b.ticker AND a.factor < b.factor GROUP BY 1, 2, 3) z) y"""
CORR_VIEWS = {
    "fl": (("ls",), "SELECT ticker, market, factor, round(coalesce(score, med), 9) AS s FROM ls JOIN (SELECT market, factor, median(score) AS med FROM ls GROUP BY 1, 2 HAVING avg(CASE WHEN score IS NULL THEN 1 ELSE 0 END) <= 0.5) m USING (market, factor)"),
    "rk": (("fl",), "SELECT *, rank() OVER (PARTITION BY market, factor ORDER BY s) + (count(*) OVER (PARTITION BY market, factor, s) - 1) / 2.0 AS r FROM fl"),
}


@query("W16_factor_correlations", statement("rk", CORR_SQL, extra=CORR_VIEWS))
def _(t):
    m = research.factor_correlations(t.long_scores, list(US_FACTORS))
    return m.select("market", "factor_a", "factor_b", *[r6(k).alias(k) for k in ("rho", "density_a", "density_b")], "level")


@query("Q12_orthogonality_alert", statement("rk", f"SELECT market, factor_a, factor_b, rho FROM ({CORR_SQL}) q WHERE abs(rho) > 0.50 AND level <> 'sparse'", extra=CORR_VIEWS))
def _(t):
    m = research.factor_correlations(t.long_scores, list(US_FACTORS)).where("abs(rho) > 0.50 AND level <> 'sparse'")
    return m.select("market", "factor_a", "factor_b", r6("rho").alias("rho"))


BREADTH_CTE = {
    "dd": (("ics",), "SELECT factor, d, row_number() OVER (PARTITION BY factor ORDER BY d) AS i FROM (SELECT DISTINCT factor, d FROM ics) q"),
}
BREADTH_SQL = """, walk AS (SELECT factor, d AS anchor, 1 AS n FROM dd WHERE i = 1 UNION ALL SELECT w.factor, x.d, w.n + 1 FROM walk w JOIN LATERAL (SELECT min(d) AS d FROM dd WHERE dd.factor = w.factor AND dd.d >= w.anchor + 63) x ON x.d IS NOT NULL)"""
AGG_IC = """SELECT factor, avg(ic) AS mean_ic, coalesce(stddev_samp(ic), 0.0) AS ic_std, avg(CASE WHEN ic > 0 THEN 1 ELSE 0 END) AS hit_rate, count(*) AS n_snapshots, max(n_eff) AS n_effective
    FROM ics JOIN (SELECT factor, max(n) AS n_eff FROM walk GROUP BY factor) e USING (factor) GROUP BY factor"""


def ic_statement(body):
    head = statement("ics dd", "", recursive=True, extra={**IC_VIEWS, **BREADTH_CTE})
    return head + BREADTH_SQL + " " + body


@query("A16_aggregate_ic", ic_statement(f"""SELECT factor, round(mean_ic, 6) AS mean_ic, round(ic_std, 6) AS ic_std, round(mean_ic / ic_std, 6) AS ic_ir, round(hit_rate, 6) AS hit_rate, n_snapshots, n_effective::BIGINT AS n_effective,
    round(mean_ic / ic_std * sqrt(n_effective), 6) AS t_stat FROM ({AGG_IC}) a"""))
def _(t):
    s = research.aggregate_ic(ic_rows(t), 63)
    return s.select("factor", *[r6(k).alias(k) for k in ("mean_ic", "ic_std", "ic_ir", "hit_rate", "t_stat")], "n_snapshots", "n_effective")


@query("A17_effective_breadth", ic_statement("SELECT factor, max(n)::BIGINT AS n_effective FROM walk GROUP BY factor"))
def _(t):
    return ic_rows(t).groupBy("factor").agg(research.effective_breadth(F.collect_set("d"), 63).alias("n_effective"))


REC = "CASE WHEN mean_ic < 0 THEN 'investigate' WHEN mean_ic / ic_std > 0.5 AND hit_rate >= 0.6 THEN 'increase' WHEN mean_ic / ic_std >= 0.3 THEN 'hold' ELSE 'decrease' END"


@query("A18_ic_report", ic_statement(f"SELECT factor, round(mean_ic, 6) AS mean_ic, n_snapshots, {REC} AS recommendation FROM ({AGG_IC}) a"))
def _(t):
    s = research.aggregate_ic(research.snapshot_ic(t.snaps_long, "fwd_x"), 63)
    return s.select("factor", r6("mean_ic").alias("mean_ic"), "n_snapshots", research.recommendation().alias("recommendation"))


@query("A19_weight_recommendation", ic_statement(f"SELECT factor, {REC} AS recommendation FROM ({AGG_IC}) a"))
def _(t):
    return research.aggregate_ic(ic_rows(t), 63).select("factor", research.recommendation().alias("recommendation"))


@query("A20_excess_labels", statement("snaps", "SELECT d, ticker, round(fwd - bench_fwd, 6) AS excess FROM snaps"))
def _(t):
    return t.snaps.select("d", "ticker", r6(c("fwd") - c("bench_fwd")).alias("excess"))


ARCH = {**BARS_NO, "arch": (("trades", "snaps"), """SELECT t.anchor, factor, f.score, ret FROM trades t JOIN (SELECT sid, d + (sid % 28)::INT AS anchor, 'mom' AS factor, mom AS score FROM snaps UNION ALL SELECT sid, d + (sid % 28)::INT, 'vz', vz FROM snaps
    UNION ALL SELECT sid, d + (sid % 28)::INT, 'rev', rev FROM snaps UNION ALL SELECT sid, d + (sid % 28)::INT, 'val', val FROM snaps) f USING (sid, anchor) WHERE horizon = 3 AND ret IS NOT NULL""")}


def archive_long(t):
    """Archived signals with a realised 3-bar return, one row per factor."""
    f = t.snaps.withColumn("anchor", F.date_add("d", (c("sid") % 28).cast("int"))).select("sid", "anchor", *SNAP_FACTORS)
    priced = trades(t).where("horizon = 3 AND ret IS NOT NULL").select("sid", "anchor", "ret")
    return priced.join(f, ["sid", "anchor"]).unpivot(["sid", "anchor", "ret"], list(SNAP_FACTORS), "factor", "score")


@query("A21_archive_ic_input", statement("arch", "SELECT anchor, factor, count(*) AS n, round(sum(score), 5) AS score_sum, round(sum(ret), 5) AS ret_sum FROM arch GROUP BY 1, 2", extra=ARCH))
def _(t):
    return archive_long(t).groupBy("anchor", "factor").agg(N().alias("n"), F.round(F.sum("score"), 5).alias("score_sum"), F.round(F.sum("ret"), 5).alias("ret_sum"))


@query("A21_archive_ic_report", statement("arch", """SELECT factor, count(*) AS months, round(avg(cv / (sa * sb)), 6) AS mean_ic FROM (SELECT m, factor, covar_pop(ra, rb) AS cv, stddev_pop(ra) AS sa, stddev_pop(rb) AS sb FROM (
    SELECT m, factor, rank() OVER (PARTITION BY m, factor ORDER BY score) + (count(*) OVER (PARTITION BY m, factor, score) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY m, factor ORDER BY ret) + (count(*) OVER (PARTITION BY m, factor, ret) - 1) / 2.0 AS rb
    FROM (SELECT date_trunc('month', anchor) AS m, factor, score, ret FROM arch WHERE score IS NOT NULL) a) r GROUP BY 1, 2) z WHERE sa > 1e-12 AND sb > 1e-12 GROUP BY factor""", extra=ARCH))
def _(t):
    rows = archive_long(t).withColumn("m", F.date_trunc("month", "anchor"))
    ic = research.snapshot_ic(rows, "ret", ("m", "factor"))
    return ic.groupBy("factor").agg(N().alias("months"), r6(F.avg("ic")).alias("mean_ic"))


# --- monitoring ----------------------------------------------------------------------------

STRESS = """SELECT market, ceo_ratio, mean_filings, breadth_ratio, CASE WHEN f = 3 THEN 'CRITICAL' WHEN f = 2 THEN 'WARNING' WHEN f = 1 OR w >= 1 THEN 'WATCH' ELSE 'CLEAR' END AS level FROM (SELECT *,
    (CASE WHEN ceo_ratio >= 0.4 THEN 1 ELSE 0 END) + (CASE WHEN mean_filings >= 5 THEN 1 ELSE 0 END) + (CASE WHEN breadth_ratio >= 0.5 THEN 1 ELSE 0 END) AS f, (CASE WHEN ceo_ratio >= 0.2 THEN 1 ELSE 0 END) + (CASE WHEN mean_filings >= 3 THEN 1 ELSE 0 END) + (CASE WHEN breadth_ratio >= 0.25 THEN 1 ELSE 0 END) AS w
    FROM (SELECT market, round(avg(CASE WHEN ceo_c > 0 THEN 1 ELSE 0 END), 6) AS ceo_ratio, round(avg(coalesce(n_1y, 0)), 6) AS mean_filings, round(avg(CASE WHEN insider_breadth >= 0.7 THEN 1 ELSE 0 END), 6) AS breadth_ratio FROM entries GROUP BY market) a) b"""


def flag_sum(*conditions):
    total = F.lit(0)
    for x in conditions:
        total = total + F.coalesce(x, F.lit(False)).cast("int")
    return total


@query("A22_insider_stress", statement("entries", STRESS))
def _(t):
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    s = t.entries.groupBy("market").agg(
        r6(F.avg(yes(c("ceo_c") > 0))).alias("ceo_ratio"), r6(F.avg(F.coalesce("n_1y", F.lit(0)))).alias("mean_filings"),
        r6(F.avg(yes(c("insider_breadth") >= 0.7))).alias("breadth_ratio"),
    )
    flags = flag_sum(c("ceo_ratio") >= 0.40, c("mean_filings") >= 5.0, c("breadth_ratio") >= 0.50)
    watch = flag_sum(c("ceo_ratio") >= 0.20, c("mean_filings") >= 3.0, c("breadth_ratio") >= 0.25)
    level = F.when(flags == 3, "CRITICAL").when(flags == 2, "WARNING").when((flags == 1) | (watch >= 1), "WATCH").otherwise("CLEAR")
    return s.withColumn("level", level)


CORE5 = ["insider_conviction", "insider_breadth", "congress", "news_sentiment", "momentum_long"]


@query("A23_score_distribution", statement("entries", f"""SELECT round(density, 6) AS density, round(sd, 6) AS std_dev, live::BIGINT AS live_factors, density >= 0.2 AND sd >= 0.05 AND live > 0 AS healthy FROM (SELECT avg(CASE WHEN final_score > 0 THEN 1 ELSE 0 END) AS density,
    stddev_samp(final_score) AS sd, {' + '.join(f"(CASE WHEN avg(CASE WHEN {f} > 0 THEN 1 ELSE 0 END) > 0.05 THEN 1 ELSE 0 END)" for f in CORE5)} AS live FROM entries WHERE market = 'USA') z"""))
def _(t):
    on = lambda f: F.avg(F.coalesce(c(f) > 0, F.lit(False)).cast("int"))
    s = t.entries.where("market = 'USA'").agg(on("final_score").alias("density"), F.stddev_samp("final_score").alias("sd"), *[on(f).alias(f"d_{f}") for f in CORE5])
    live = flag_sum(*[c(f"d_{f}") > 0.05 for f in CORE5])
    return s.select(r6("density").alias("density"), r6("sd").alias("std_dev"), live.cast("long").alias("live_factors"), ((c("density") >= 0.2) & (c("sd") >= 0.05) & (live > 0)).alias("healthy"))


@query("A24_degenerate_list_gate", statement("entries", """SELECT n, round(sd, 6) AS std_dev, mx AS max_score, n < 3 OR (sd >= 0.05 AND mx >= 0.4) AS healthy FROM (SELECT count(*) AS n, stddev_samp(s) AS sd, max(s) AS mx FROM (SELECT DISTINCT final_score AS s FROM entries) a) b"""))
def _(t):
    s = t.entries.select("final_score").distinct().agg(N().alias("n"), F.stddev_samp("final_score").alias("sd"), F.max("final_score").alias("max_score"))
    return s.select("n", r6("sd").alias("std_dev"), "max_score", ((c("n") < 3) | ((c("sd") >= 0.05) & (c("max_score") >= 0.40))).alias("healthy"))


@query("A25_feed_density", statement("entries", """SELECT market, round(a, 6) AS conviction_density, round(b, 6) AS breadth_density, CASE WHEN n < 10 THEN 'SKIPPED' WHEN a < 0.01 AND b < 0.01 THEN 'DEAD' WHEN a < 0.03 THEN 'LOW' ELSE 'OK' END AS level
    FROM (SELECT market, count(*) AS n, avg(CASE WHEN insider_conviction > 0 THEN 1 ELSE 0 END) AS a, avg(CASE WHEN insider_breadth > 0 THEN 1 ELSE 0 END) AS b FROM entries GROUP BY market) z"""))
def _(t):
    on = lambda f: F.avg(F.coalesce(c(f) > 0, F.lit(False)).cast("int"))
    s = t.entries.groupBy("market").agg(N().alias("n"), on("insider_conviction").alias("a"), on("insider_breadth").alias("b"))
    level = F.when(c("n") < 10, "SKIPPED").when((c("a") < 0.01) & (c("b") < 0.01), "DEAD").when(c("a") < 0.03, "LOW").otherwise("OK")
    return s.select("market", r6("a").alias("conviction_density"), r6("b").alias("breadth_density"), level.alias("level"))


MANDATORY = ["momentum_long", "volume_attention", "analyst_consensus"]


@query("A26_mandatory_factors", statement("ls", "SELECT market, factor, max(CASE WHEN market = 'EUROPE' AND factor = 'volume_attention' THEN 0.0 ELSE coalesce(score, 0.0) END) = 0 AS dead FROM ls WHERE factor IN ('momentum_long', 'volume_attention', 'analyst_consensus') GROUP BY 1, 2"))
def _(t):
    """One factor of one market is planted as dead."""
    m = t.long_scores.where(c("factor").isin(*MANDATORY))
    planted = F.when((c("market") == "EUROPE") & (c("factor") == "volume_attention"), 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
    return m.groupBy("market", "factor").agg((F.max(planted) == 0).alias("dead"))


RUNS = "(SELECT date_trunc('hour', ts) AS run, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses FROM events GROUP BY 1)"


def runs(t):
    kind = c("event_type")
    return t.events.groupBy(F.date_trunc("hour", "ts").alias("run")).agg(
        N().alias("calls"), count_when(kind == "error").alias("errors"), count_when(kind == "view").alias("hits"), count_when(kind == "click").alias("misses")
    )


@query("A27_run_gate", f"SELECT run, coverage >= 0.6 AND errors <= 3 AS ok, concat_ws('; ', CASE WHEN coverage < 0.6 THEN 'coverage below threshold' END, CASE WHEN errors > 3 THEN 'error_count ' || errors || ' exceeds max_errors 3' END) AS reasons FROM (SELECT *, (calls - errors)::DOUBLE / calls AS coverage FROM {RUNS} r) z")
def _(t):
    r = runs(t).withColumn("coverage", ratio(c("calls") - c("errors"), "calls"))
    reasons = F.concat_ws("; ", F.when(c("coverage") < 0.6, "coverage below threshold"), F.when(c("errors") > 3, F.concat(F.lit("error_count "), c("errors").cast("string"), F.lit(" exceeds max_errors 3"))))
    return r.select("run", ((c("coverage") >= 0.6) & (c("errors") <= 3)).alias("ok"), reasons.alias("reasons"))


TELEMETRY = "(SELECT CAST(ts AS DATE) AS d, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses FROM events GROUP BY 1)"


def telemetry(t):
    s = runs(t).groupBy(F.to_date("run").alias("d")).agg(*[F.sum(k).alias(k) for k in ("calls", "errors", "hits", "misses")])
    return s.select(
        "d", "calls", F.coalesce(ratio("errors", "calls"), F.lit(0.0)).alias("error_rate"), (c("hits") + c("misses")).alias("cache_lookups"),
        F.coalesce(ratio("hits", c("hits") + c("misses")), F.lit(0.0)).alias("cache_hit_rate"), (c("calls") * 0.0005).alias("cost"),
    )


@query("A28_call_telemetry", f"SELECT d, calls, round(errors::DOUBLE / calls, 6) AS error_rate, hits + misses AS cache_lookups, round(coalesce(hits::DOUBLE / nullif(hits + misses, 0), 0.0), 6) AS cache_hit_rate, round(calls * 0.0005::DOUBLE, 6) AS cost FROM {TELEMETRY} r")
def _(t):
    return telemetry(t).select("d", "calls", "cache_lookups", *[r6(k).alias(k) for k in ("error_rate", "cache_hit_rate", "cost")])


@query("A29_telemetry_warnings", f"""SELECT d, concat_ws('; ', CASE WHEN errors::DOUBLE / calls > 0.2 THEN 'error_rate' END, CASE WHEN hits + misses >= 50 AND hits::DOUBLE / (hits + misses) < 0.5 THEN 'cache_hit_rate' END) AS warnings FROM {TELEMETRY} r""")
def _(t):
    w = F.array_compact(F.array(F.when(c("error_rate") > 0.2, F.lit("error_rate")), F.when((c("cache_lookups") >= 50) & (c("cache_hit_rate") < 0.5), F.lit("cache_hit_rate"))))
    return telemetry(t).select("d", F.array_join(w, "; ").alias("warnings"))


@query("A30_region_gate", statement("rm", f"""SELECT market, round(ic, 6) AS ic, round(cov, 6) AS coverage, concat_ws(',', CASE WHEN ic < CASE market WHEN 'USA' THEN 0.03 WHEN 'EUROPE' THEN 0.025 ELSE 0.02 END THEN 'ic' END,
    CASE WHEN cov < CASE market WHEN 'USA' THEN 0.6 WHEN 'EUROPE' THEN 0.45 ELSE 0.4 END THEN 'coverage' END) AS failures
    FROM (SELECT market, avg(coverage) AS cov FROM rm WHERE s IS NOT NULL GROUP BY market) a LEFT JOIN (SELECT market, covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) AS ic FROM ({RANKED_RM}) z GROUP BY market) b USING (market)""", extra=REGION_VIEW))
def _(t):
    rows = region_rows(t).where("s IS NOT NULL")
    cov = rows.groupBy("market").agg(F.avg("coverage").alias("cov"))
    j = cov.join(xs.spearman(rows, ["market"], "s", "fwd", "ic").drop("n"), "market", "left").join(F.broadcast(gate_table(t.spark)), "market")  # 3 literal rows
    fails = F.array_compact(F.array(F.when(c("ic") < c("ic_target"), F.lit("ic")), F.when(c("cov") < c("coverage_gate"), F.lit("coverage"))))
    return j.select("market", r6("ic").alias("ic"), r6("cov").alias("coverage"), F.array_join(fails, ",").alias("failures"))


@query("A31_best_per_sector", statement("entries", "SELECT sector, ticker, final_score FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY final_score DESC, ticker) AS rn FROM entries) z WHERE rn = 1"))
def _(t):
    best = F.min_by(F.struct("ticker", "final_score"), F.struct(-c("final_score"), c("ticker")))
    return t.entries.groupBy("sector").agg(best.alias("b")).select("sector", "b.ticker", "b.final_score")


POOL_SQL = """SELECT sid, market AS pool, row_number() OVER (PARTITION BY market ORDER BY market_cap DESC, sid) AS slot FROM uni"""
COV_VIEWS = {
    "pool": (("uni",), f"SELECT * FROM ({POOL_SQL}) z WHERE slot <= 10"),
    "pb": (("pool", "bars"), "SELECT pool, slot, sid, d, close, row_number() OVER (PARTITION BY pool, sid ORDER BY d DESC) AS rn FROM pool JOIN bars USING (sid)"),
    "pr": (("pb",), """SELECT pool, slot, j / 2 AS obs, ln(nx / close + 1e-10) AS r FROM (SELECT *, len - rn AS j, lead(close, 2) OVER (PARTITION BY pool, sid ORDER BY len - rn) AS nx, len AS ln FROM pb JOIN (
        SELECT pool, min(k) AS len FROM (SELECT pool, sid, max(rn) AS k FROM pb GROUP BY 1, 2) a GROUP BY pool) l USING (pool) WHERE rn <= len AND len >= 21) q WHERE j % 2 = 0 AND j <= ln - 3"""),
    "px": (("pr",), "SELECT pool, slot, obs, r - avg(r) OVER (PARTITION BY pool, slot) AS x FROM pr"),
    "ps": (("px",), "SELECT a.pool, a.slot AS i, b.slot AS j, sum(a.x * b.x) / count(*) AS s, count(*) AS n FROM px a JOIN px b ON a.pool = b.pool AND a.obs = b.obs GROUP BY 1, 2, 3"),
    "pt": (("ps", "px"), """SELECT pool, sum(s * s) AS ds, sum(CASE WHEN i = j THEN s END) AS tr, max(n) AS n, max(i) AS p, max(bs) AS bs FROM ps JOIN (SELECT pool, sum(q * q) AS bs FROM (SELECT pool, obs, sum(x * x) AS q FROM px GROUP BY 1, 2) a GROUP BY pool) b USING (pool) GROUP BY pool"""),
    "pcov": (("ps", "pt"), """SELECT pool, i, j, (1 - sh) * s + CASE WHEN i = j THEN sh * mu ELSE 0 END AS cov FROM ps JOIN (SELECT pool, tr / p AS mu, coalesce(least((bs / n - ds) / (p * n), dl) / nullif(dl, 0), 0.0) AS sh
        FROM (SELECT *, (ds - 2 * (tr / p) * tr + p * (tr / p) * (tr / p)) / p AS dl FROM pt) a) b USING (pool)"""),
}


def pools(t, n=10):
    """The n largest names per market as a sizing pool, numbered; n is at most 20."""
    w = Window.partitionBy("market").orderBy(F.desc("market_cap"), "sid")
    return t.universe.withColumn("slot", F.row_number().over(w)).where(c("slot") <= n).select("sid", "ticker", "sector", c("market").alias("pool"), "slot", "market_cap")


@query("A32_shrunk_covariance", statement("pcov", "SELECT pool, i, j, round(cov, 8) AS cov FROM pcov", extra=COV_VIEWS))
def _(t):
    r = research.two_bar_returns(t.bars, pools(t).select("sid", "pool", "slot"))
    return research.shrunk_covariance(r).select("pool", c("i").cast("long"), c("j").cast("long"), F.round("cov", 8).alias("cov"))


@query("A33_positive_pair_pearson", statement("entries", "SELECT market, n, round(CASE WHEN n >= 5 THEN r END, 6) AS r FROM (SELECT market, count(*) AS n, covar_pop(insider_conviction, insider_breadth) / (stddev_pop(insider_conviction) * stddev_pop(insider_breadth)) AS r FROM entries WHERE insider_conviction > 0 AND insider_breadth > 0 GROUP BY market) z"))
def _(t):
    both = t.entries.where("insider_conviction > 0 AND insider_breadth > 0")
    p = xs.pearson(both, ["market"], "insider_conviction", "insider_breadth", "r")
    return p.select("market", "n", r6(F.when(c("n") >= 5, c("r"))).alias("r"))


@query("A34_raw_vs_neutral", statement("neu", "SELECT factor, count(*) AS n, round(covar_pop(score, neutral) / (stddev_pop(score) * stddev_pop(neutral)), 6) AS r FROM neu WHERE score > 0 GROUP BY factor", extra=NEUTRAL_VIEW))
def _(t):
    p = xs.pearson(xs.neutralise(t.long_scores).where("score > 0"), ["factor"], "score", "neutral", "r")
    return p.select("factor", "n", r6("r").alias("r"))


@query("A35_neutral_coverage", statement("neu", "SELECT factor, level, count(*) AS n, round(avg(neutral), 6) AS mean, round(stddev_pop(neutral), 6) AS sigma FROM neu GROUP BY 1, 2", extra=NEUTRAL_VIEW))
def _(t):
    return xs.neutralise(t.long_scores).groupBy("factor", "level").agg(N().alias("n"), r6(F.avg("neutral")).alias("mean"), r6(F.stddev_pop("neutral")).alias("sigma"))


@query("A36_anomaly_scan", statement("entries ctx", f"""
    SELECT ticker, 'VOLUME_SPIKE' AS flag, round(coalesce(volume_spike, 0.0), 6) AS value FROM entries WHERE coalesce(volume_spike, 0.0) > 3.0 * (SELECT avg(coalesce(volume_spike, 0.0)) FROM entries)
    UNION ALL SELECT ticker, 'INSIDER_CAP_LIMIT', round(buy_c * 10.0 / market_cap, 6) FROM entries WHERE buy_c * 10.0 / market_cap > CASE cap_tier WHEN 'small' THEN 0.02 WHEN 'mid' THEN 0.01 ELSE 0.005 END
    UNION ALL SELECT ticker, 'SENTIMENT_EXTREME', round(momentum_long, 6) FROM entries WHERE momentum_long > 0.95 OR momentum_long < 0.05
    UNION ALL SELECT ticker, 'CONGRESS_CLUSTER', members::DOUBLE FROM entries JOIN ({CLUSTER_SQL}) k USING (pid) UNION ALL SELECT ticker, 'STALE_DATA', 0.0 FROM entries WHERE buy_age > 300"""))
def _(t):
    e = t.entries.join(clusters(t), "pid", "left")
    mean = t.entries.agg(F.avg(F.coalesce("volume_spike", F.lit(0.0)))).scalar()
    spike, share = F.coalesce(c("volume_spike"), F.lit(0.0)), c("buy_c") * 10.0 / c("market_cap")

    def hit(flag, when, value):
        return F.when(when, F.struct(F.lit(flag).alias("flag"), value.cast("double").alias("value")))

    hits = F.array_compact(F.array(
        hit("VOLUME_SPIKE", spike > 3.0 * mean, spike), hit("INSIDER_CAP_LIMIT", share > lookup(INSIDER_CEILING, "cap_tier"), share),
        hit("SENTIMENT_EXTREME", (c("momentum_long") > 0.95) | (c("momentum_long") < 0.05), c("momentum_long")),
        hit("CONGRESS_CLUSTER", c("members") >= 3, c("members")), hit("STALE_DATA", c("buy_age") > 300, F.lit(0.0)),
    ))
    return e.select("ticker", F.explode(hits).alias("h")).select("ticker", "h.flag", r6("h.value").alias("value"))


@query("A15_turnover_inflation", statement("pc", f"SELECT round(avg(churn), 6) AS mean_churn, round(avg(autocorrelation), 6) AS mean_autocorrelation FROM ({TURNOVER_SQL}) q", extra=PREV))
def _(t):
    out = research.turnover(prev_curr(t), ["d"], "prev", "curr", 20)
    return out.agg(r6(F.avg("churn")).alias("mean_churn"), r6(F.avg("autocorrelation")).alias("mean_autocorrelation"))
