"""Scalar-function coverage: JSON cells and evidence lines."""

from pyspark.sql import functions as F

from ..functions.common import metric_cell
from ..functions.text import evidence_line, narrative
from ..oracles.base import statement
from .registry import query


def c(name):
    return F.col(name)


@query("C07_metric_cells", "SELECT event_id, CASE event_id % 5 WHEN 3 THEN 0.0 WHEN 4 THEN NULL ELSE value END AS metric FROM events")
def _(t):
    k, v = c("event_id") % 5, c("value").cast("string")
    cell = (
        F.when(k == 0, F.concat(F.lit(' {"score": '), v, F.lit("}"))).when(k == 1, F.concat(F.lit("["), v, F.lit(", 1]")))
        .when(k == 2, v).when(k == 3, "n/a")
    )
    return t.events.select("event_id", metric_cell(cell).alias("metric"))


@query("P30_props_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("F18_evidence_line", statement("entries", """
    SELECT ticker, concat_ws(' · ', a, b, k, CASE WHEN a IS NULL OR b IS NULL OR k IS NULL THEN m END) AS line FROM (SELECT ticker, CASE WHEN buy_c > 0 THEN 'Insider $' || (buy_c // 100) END AS a,
        CASE WHEN surprise_pct < 0 AND surprise_days <= 90 THEN 'EPS miss' WHEN surprise_pct IS NOT NULL AND surprise_days <= 90 THEN 'EPS beat ' || surprise_days || 'd ago' END AS b,
        CASE WHEN buys_1y > 0 AND market = 'USA' THEN buys_1y || 'x congress buy' END AS k, CASE WHEN mom_ret > 0.05 THEN 'momentum up' WHEN mom_ret < -0.05 THEN 'momentum down' END AS m FROM entries) z"""))
def _(t):
    text = lambda n: c(n).cast("string")
    fresh = c("surprise_days") <= 90
    parts = [
        F.when(c("buy_c") > 0, F.concat(F.lit("Insider $"), F.floor(c("buy_c") / 100).cast("string"))),
        F.when((c("surprise_pct") < 0) & fresh, "EPS miss").when(c("surprise_pct").isNotNull() & fresh, F.concat(F.lit("EPS beat "), text("surprise_days"), F.lit("d ago"))),
        F.when((c("buys_1y") > 0) & (c("market") == "USA"), F.concat(text("buys_1y"), F.lit("x congress buy"))),
        F.when(c("mom_ret") > 0.05, "momentum up").when(c("mom_ret") < -0.05, "momentum down"),
    ]
    return t.entries.select("ticker", narrative(parts).alias("line"))


TENTHS = "(round({x} * 10)::BIGINT // 10) || '.' || (round({x} * 10)::BIGINT % 10)"
REL = "(CASE WHEN alone THEN mom_ret ELSE rel END)"


@query("F18_evidence_line_full", statement("entries", f"""
    SELECT ticker, CASE WHEN flags <> '' THEN left(line || ' | ' || flags, 80) ELSE line END AS line FROM (
    SELECT ticker, CASE WHEN pid % 7 = 0 THEN left(line, 65) || ' ⚠double-signal' ELSE line END AS line,
           array_to_string(list_slice(list_filter([CASE WHEN {REL} < -0.10 THEN '⚠ mom ' || round({REL} * 100)::BIGINT || '%' END, CASE WHEN revenue_revision > 0 AND revenue_revision < 0.35 THEN '⚠ rev↓' END,
               CASE WHEN quality_piotroski > 0 AND quality_piotroski < 0.30 THEN '⚠ F-Score↓' END], lambda x: x IS NOT NULL), 1, 2), ' ') AS flags
    FROM (SELECT *, left(coalesce(nullif(array_to_string(list_slice(list_filter([a, b, u, k, m], lambda x: x IS NOT NULL), 1, 3), ' · '), ''), CASE WHEN n_1y >= 5 THEN 'analyst revision (' || n_1y || ' analysts)' END, 'no primary catalyst detected'), 80) AS line
    FROM (SELECT *, CASE WHEN usd > 0 THEN 'Insider $' || CASE WHEN usd >= 100000 THEN round(usd / 1000)::BIGINT || 'k' ELSE {TENTHS.format(x='(usd / 1000)')} || 'k' END || CASE pid % 3 WHEN 0 THEN ' [CEO high]' ELSE '' END END AS a,
        CASE WHEN surprise_pct < 0 AND coalesce(surprise_days, 0) <= 90 THEN 'EPS miss ' || {TENTHS.format(x='(abs(surprise_pct) * 100)')} || '%' WHEN surprise_pct IS NOT NULL AND coalesce(surprise_days, 0) <= 90 THEN 'EPS +' || {TENTHS.format(x='(abs(surprise_pct) * 100)')} || '% · ' || coalesce(surprise_days, 0) || 'd ago' END AS b,
        CASE pid % 5 WHEN 0 THEN 'UPGRADE Meridianston ' || (pid % 60) || 'd' WHEN 1 THEN 'DOWNGRADE ' || (pid % 60) || 'd' END AS u,
        CASE WHEN buys_1y > 0 AND market = 'USA' THEN buys_1y || 'x congress buy · ' || CASE WHEN pid % 4 = 0 THEN 'members' ELSE left('Member ' || pid || ' of the House', 12) END END AS k,
        CASE WHEN abs({REL}) > 0.05 THEN CASE WHEN {REL} >= 0 THEN '+' ELSE '-' END || {TENTHS.format(x=f'(abs({REL}) * 100)')} || '% ' || CASE WHEN alone THEN '12-1m abs' ELSE 'vs SPY 12m' END END AS m
    FROM (SELECT *, CASE WHEN pid % 2 = 0 THEN buy_c / 5000.0 ELSE 0.0 END AS usd, CASE WHEN market = 'USA' THEN coalesce(mom_ret, 0.0) ELSE 0.0 END AS rel, market <> 'USA' AND mom_ret IS NOT NULL AS alone FROM entries) w) x) y) z"""))
def _(t):
    """Every part of the line; ratings, tiers, members and the doubled-signal mark stand in by the name's number."""
    e, usa = t.entries, c("market") == "USA"
    kind = lambda n, *cases: F.element_at(F.array(*[F.lit(x) for x in cases]), (c("pid") % n + 1).cast("int"))
    line = evidence_line(
        F.when(c("pid") % 2 == 0, c("buy_c") / 5000.0), kind(3, "CEO high", "none", None), c("surprise_pct"), c("surprise_days"),
        kind(5, "upgrade", "downgrade", "init", None, ""), F.when(c("pid") % 5 == 0, "Meridianstone Securities"), c("pid") % 60,
        F.when(usa, c("buys_1y")), F.when(c("pid") % 4 != 0, F.concat(F.lit("Member "), c("pid").cast("string"), F.lit(" of the House"))),
        F.when(usa, c("mom_ret")), c("mom_ret"), ~usa & c("mom_ret").isNotNull(), c("n_1y"), c("pid") % 7 == 0, c("revenue_revision"), c("quality_piotroski"),
    )
    return e.select("ticker", line.alias("line"))
