"""SQL expressions of the pillar factors, over columns of the entries view."""

from .base import clip, flow13f, log_sat

C13 = (
    "(CASE WHEN ({1}) IS NOT NULL THEN greatest(0.0, least(1.0, 0.4 * greatest(0.0, least(80.0, ({0}))) / 80.0 + 0.3 * least(1.0, ln(1 + ({1})) / ln(501.0)) "
    "+ 0.3 * (0.5 + 0.5 * (({2}) - ({3})) / greatest(1.0, ({2}) + ({3}))))) END)"
)
DIVIDEND = (
    "(CASE WHEN {y} IS NULL AND {po} IS NULL AND {f} IS NULL AND {d} IS NULL THEN NULL WHEN coalesce({y}, 0) <= 0 AND abs(coalesce({d}, 0)) <= 0 THEN 0.0 "
    "WHEN {y} IS NULL OR {po} IS NULL OR {f} IS NULL OR {d} IS NULL OR abs({d}) <= 0 THEN NULL ELSE greatest(0.0, least(1.0, "
    "0.45 * (1.0 - greatest(0.0, least(1.0, abs({po} - 0.45) / 0.55))) + 0.35 * greatest(0.0, least(2.0, {f} / nullif(abs({d}), 0) - 1.0)) / 2.0 "
    "+ 0.20 * greatest(0.0, least(0.08, {y})) / 0.08)) END)"
)
DUPONT = """coalesce(greatest(0.0, least(1.0, (coalesce(0.5 * ({roa} + 0.10) / 0.30, 0) + coalesce(0.3 * ({npm} + 0.10) / 0.35, 0) + coalesce(0.2 * {lev}, 0))
    / nullif((CASE WHEN npm * turnover IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN npm IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN de IS NOT NULL THEN 0.2 ELSE 0 END)::DOUBLE, 0))), 0.0)""".format(
    roa=clip("npm * turnover", -0.10, 0.20), npm=clip("npm", -0.10, 0.25),
    lev="(CASE WHEN de >= 0 AND de < 0.5 THEN 1.0 WHEN de < 1 THEN 0.6 WHEN de < 2 THEN 0.2 WHEN de IS NOT NULL THEN 0.0 END)::DOUBLE",
)
DUPONT = (
    "(CASE WHEN npm IS NULL AND de IS NULL THEN 0.0 ELSE " + DUPONT + " END)"
)
RESIDUAL = "greatest(0.0, least(1.0, insider_breadth - 0.547 * insider_conviction))"
ALPHA = (
    "(CASE WHEN coalesce(buy30, 0) + coalesce(buy180, 0) > 0 THEN greatest(0.0, least(1.0, 0.55 * coalesce(insider_conviction, 0.0) + 0.30 * coalesce(" + RESIDUAL + ", 0.0) "
    "+ 0.15 * (0.6 * " + log_sat("coalesce(buy30, 0) / greatest(1.0, coalesce(buy180, 0) * 30.0 / 150.0)", 5) + " + 0.4 * (CASE WHEN buy_c > 0 THEN "
    "least(1.0, 0.5 + 0.5 * greatest(0.0, ceo_c / 100.0) / (buy_c / 100.0)) ELSE 0.5 END)))) ELSE 0.0 END)"
)
REVISION = "(CASE WHEN {n} >= 3 THEN 0.5 + " + clip("{p}", -0.30, 0.30) + " / 0.60 * least(1.0, {n} / 10.0) END)"
PEAD = (
    "(CASE WHEN {d} BETWEEN 0 AND 90 THEN 0.5 + " + clip("{p}", -0.50, 0.50) + " * (CASE WHEN {d} <= 60 THEN 1.0 ELSE (90 - {d}) / 30.0 END) END)"
)
UPSIDE = "(CASE WHEN {t} <> 0 AND {p} <> 0 THEN " + clip("({t} - {p}) / nullif({p}, 0)", -0.5, 0.5) + " + 0.5 END)"
PB = (
    "(CASE WHEN {b} > 0 AND {p} > 0 THEN least(1.0, 1.0 - (greatest(0.5, least(3.0, {p} / {b})) - 0.5) / 2.5 + (CASE WHEN {p} / {b} < 1.0 THEN 0.10 ELSE 0.0 END)) ELSE 0.0 END)"
)
ROIC = (
    "(CASE WHEN {e} > 0 THEN greatest(0.0, least(0.5, CASE WHEN {c} > 0 THEN ({e} + {c}) / 2.0 ELSE {e} END)) / 0.5 ELSE 0.0 END)"
)
FCF = "(CASE WHEN {f} > 0 AND {e} > 0 THEN greatest(0.0, least(0.2, {f} / {e})) / 0.2 ELSE 0.0 END)"
SHOCK = "(CASE WHEN {0} >= 1.0 THEN least(1.0, ({0} - 1.0) / 2.0) ELSE 0.0 END)"
VELOCITY = (
    "(CASE WHEN k >= 4 AND abs(e2) >= 1e-4 AND abs(e3) >= 1e-4 THEN 0.5 + greatest(-0.30, least(0.30, (e0 - e2) / abs(e2) - (e1 - e3) / abs(e3))) / 0.60 * least(1.0, coalesce(n, 0) / 8.0) END)"
)
EST4 = """SELECT pid, count(*) AS k, max(est) FILTER (rn = 1) AS e0, max(est) FILTER (rn = 2) AS e1, max(est) FILTER (rn = 3) AS e2, max(est) FILTER (rn = 4) AS e3,
        max(n) FILTER (rn = 1) AS n FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY yr DESC) AS rn FROM est) z WHERE rn <= 4 GROUP BY pid"""

PILLAR_SQL = {
    "quality_dupont": DUPONT,
    "fcf_yield": FCF.format(f="((c_1y - c_0y) / 100.0)", e="(c_all / 100.0)"),
    "quality_piotroski": "quality_piotroski",
    "analyst_revision": REVISION.format(n="n_1y", p="((px1 - px0) / nullif(px0, 0))"),
    "pead_surprise": PEAD.format(p="surprise_pct", d="surprise_days"),
    "price_target_upside": UPSIDE.format(t="px1", p="px"),
    "insider_alpha": ALPHA,
    "congress": "congress",
    "inst_flow_13f": "inst_flow_13f",
    "pb_value_up": PB.format(b="px0", p="px1"),
    "analyst_consensus": "analyst_consensus",
    "inst_concentration": C13.format("n_1y * 5.0", "n_lines", "buys_1y", "sells_1y"),
    "dividend_sustain": DIVIDEND.format(y="npm", po="de", f="(c_1y / 100.0)", d="(CASE WHEN n_0y > 0 THEN c_0y / 100.0 END)"),
    "amihud_shock": SHOCK.format("((px1 / nullif(q_1y, 0)) / nullif(px * 3.0 / q_all, 0))"),
    "margin_expansion": "0.5 + " + clip("npm - opm", -0.10, 0.10) + " / 0.20",
    "roic_quality": ROIC.format(e="(npm * 5.0)", c="(opm * 3.0)"),
    "revision_velocity": "revision_velocity",
}
US_ONLY = ("congress", "inst_flow_13f", "pead_surprise", "insider_alpha", "quality_dupont", "transcript_tone")
FACTOR_VIEWS = {
    "est4": (("est",), EST4),
    "vel": (("est4",), f"SELECT pid, {VELOCITY} AS revision_velocity FROM est4"),
    "pin": (("entries", "vel"), "SELECT pid, ticker, market, region, sector, cap_tier, quality_raw, " + ", ".join(
        f"({f'CASE WHEN market = {chr(39)}USA{chr(39)} THEN {e} END' if n in US_ONLY else e})::DOUBLE AS {n}" for n, e in PILLAR_SQL.items()
    ) + " FROM entries LEFT JOIN vel USING (pid)"),
}
__all__ = ["PILLAR_SQL", "FACTOR_VIEWS", "flow13f"]
