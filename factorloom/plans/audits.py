"""Audit queries over the published lists, on copies with planted errors."""

from pyspark.sql import functions as F

from ..config import WEIGHTS
from ..functions import regime
from ..functions.common import r6
from ..operators import audit
from ..oracles.base import BADGE, statement
from .composites import VOL
from .predicates import FORMAT, LISTS, lists
from .registry import query


def c(name):
    return F.col(name)


def planted(t):
    """Published lists with errors put in by ticker number, so that every check has something to find."""
    k = c("pid") % 10
    rows = lists(t).withColumns({
        "final_score": F.when(k == 1, c("final_score") + 0.6).when(k == 2, None).otherwise(c("final_score")),
        "badge": F.when(k == 3, "HIGH BUY").otherwise(c("badge")),
        "market": F.when(k == 4, "USA").when(k == 5, "ASIA").otherwise(c("market")),
        "congress": F.when(k == 6, 0.4).otherwise(F.coalesce("congress", F.lit(0.0))),
        "d": F.add_months(F.lit("1995-01-01").cast("date"), (c("pid") % 83).cast("int")),
    })
    return rows.join(t.vix, "d", "left")


PLANT = {**LISTS, "pl": (("lists", "vix"), """
    SELECT * EXCLUDE (final_score, badge, market, congress), CASE pid % 10 WHEN 1 THEN final_score + 0.6 WHEN 2 THEN NULL ELSE final_score END AS final_score, CASE pid % 10 WHEN 3 THEN 'HIGH BUY' ELSE badge END AS badge,
           CASE pid % 10 WHEN 4 THEN 'USA' WHEN 5 THEN 'ASIA' ELSE market END AS market, CASE pid % 10 WHEN 6 THEN 0.4 ELSE coalesce(congress, 0.0) END AS congress FROM lists LEFT JOIN vix ON d = CAST(DATE '1995-01-01' + to_months((pid % 83)::INT) AS DATE)""")}

A = "SELECT 'A_SCORE_RANGE' AS code, bucket, ticker FROM pl WHERE final_score IS NULL OR final_score NOT BETWEEN 0 AND 1"
B = f"SELECT 'B_BADGE' AS code, bucket, ticker FROM pl WHERE badge IS DISTINCT FROM {BADGE.format('final_score')}"
C = "SELECT 'C_SORTING' AS code, bucket, ticker FROM (SELECT *, lag(final_score) OVER (PARTITION BY bucket ORDER BY pos) AS prev FROM pl WHERE bucket LIKE 'top_buys%') z WHERE prev < final_score"
D = "SELECT 'D_GEOGRAPHY' AS code, bucket, ticker FROM pl WHERE (ticker LIKE '%.%') <> (market IN ('EUROPE', 'ASIA'))"
E1 = "SELECT 'E_CONGRESS' AS code, bucket, ticker FROM pl WHERE market IN ('EUROPE', 'ASIA') AND congress > 0"
TOPS = {r: round(sum(w for f, w in WEIGHTS[r].items() if f not in ("congress", "transcript_tone")), 6) for r in ("US", "EU", "ASIA")}
E2 = f"SELECT 'E2_CEILING' AS code, bucket, ticker FROM pl WHERE market IN ('EUROPE', 'ASIA') AND final_score > CASE WHEN ticker LIKE '%.PA' THEN {TOPS['EU']} WHEN ticker LIKE '%.T' THEN {TOPS['ASIA']} ELSE {TOPS['US']} END + 1e-4"
G = f"SELECT 'G_FORMAT' AS code, bucket, ticker FROM pl WHERE bucket LIKE 'top_buys%' AND NOT regexp_matches(ticker, {FORMAT})"
I1 = f"SELECT 'I_OVERLAY' AS code, bucket, ticker FROM pl WHERE {VOL} < 1.0 AND final_score > {VOL} + 1e-4"


def check(name, sql, *codes):
    @query(name, statement("pl", sql, extra=PLANT))
    def _(t):
        return audit.violations(planted(t), codes or tuple(audit.CHECKS))


check("Q01_score_range", A, "A_SCORE_RANGE")
check("Q02_badge", B, "B_BADGE")
check("Q03_sorting", C, "C_SORTING")
check("Q04_geography", D, "D_GEOGRAPHY")
check("Q05_congress_leak", E1, "E_CONGRESS")
check("Q06_ceiling", E2, "E2_CEILING")
check("Q08_ticker_format", G, "G_FORMAT")
check("Q10_overlay", I1, "I_OVERLAY")
check("Q11_all_violations", " UNION ALL ".join((A, B, C, D, E1, E2, G, I1)))


@query("Q07_vix_range", statement("vix", "SELECT d, v AS vix FROM (SELECT d, CASE month(d) WHEN 3 THEN NULL WHEN 5 THEN vix + 200 WHEN 8 THEN -vix - 1 ELSE vix END AS v FROM vix) z WHERE v IS NULL OR v NOT BETWEEN 0 AND 200"))
def _(t):
    m = F.month("d")
    rows = t.vix.select("d", F.when(m == 3, None).when(m == 5, c("vix") + 200).when(m == 8, -c("vix") - 1).otherwise(c("vix")).alias("vix"))
    return audit.bad_vix(rows)


@query("Q09_single_name_rules", statement("entries", f"""
    SELECT pid, CASE WHEN tk IS NULL OR tk = '' THEN 'TICKER_MISSING' WHEN NOT regexp_matches(tk, {FORMAT}) THEN 'TICKER_FORMAT' WHEN pid % 13 = 0 THEN 'PIPELINE' WHEN pid % 17 = 0 THEN 'SCORING_MODE' WHEN fs NOT BETWEEN 0 AND 1 THEN 'SCORE_RANGE'
           WHEN pid % 23 = 0 AND 'HIGH BUY' <> {BADGE.format('fs')} THEN 'BADGE' WHEN (tk LIKE '%.%') <> (market IN ('EUROPE', 'ASIA')) THEN 'GEOGRAPHY' WHEN market <> 'USA' AND pid % 29 = 0 THEN 'CONGRESS' END AS code
    FROM (SELECT *, CASE WHEN pid % 11 = 0 THEN '' ELSE translate(ticker, '0123456789', 'ABCDEFGHIJ') END AS tk, CASE WHEN pid % 19 = 0 THEN final_score + 1 ELSE final_score END AS fs FROM entries) z"""))
def _(t):
    p = c("pid")
    score = F.when(p % 19 == 0, c("final_score") + 1).otherwise(c("final_score"))
    rows = t.entries.select(
        "pid", "market", F.when(p % 11 == 0, "").otherwise(F.translate("ticker", "0123456789", "ABCDEFGHIJ")).alias("ticker"),
        F.when(p % 13 == 0, "OTHER").otherwise(c("pipeline")).alias("pipeline"), F.when(p % 17 == 0, None).otherwise("absolute").alias("scoring_mode"),
        score.alias("final_score"), F.when(p % 23 == 0, "HIGH BUY").otherwise(regime.badge(score)).alias("badge"), F.when(p % 29 == 0, 0.2).otherwise(0.0).alias("congress"),
    )
    return audit.single_name(rows).select("pid", "code")


@query("Q13_flat_signals", statement("ls", "SELECT market, factor, count(*) AS n FROM (SELECT market, factor, CASE WHEN factor = 'news_buzz' THEN 0.5 ELSE score END AS score FROM ls) z GROUP BY 1, 2 HAVING count(*) > 5 AND count(DISTINCT round(score, 2)) = 1"))
def _(t):
    rows = t.long_scores.withColumn("score", F.when(c("factor") == "news_buzz", 0.5).otherwise(c("score")))
    return audit.flat_signals(rows, ["market", "factor"]).select("market", "factor", "n")


@query("Q14_flat_quality", statement("entries", "SELECT market, round(max(k)::DOUBLE / sum(k), 6) AS share, max(k)::DOUBLE / sum(k) > 0.25 AS flat FROM (SELECT market, quality_raw, count(*) AS k FROM entries GROUP BY 1, 2) z GROUP BY market"))
def _(t):
    return audit.flat_share(t.entries, ["market"], "quality_raw", 0.25).select("market", r6("share").alias("share"), "flat")
