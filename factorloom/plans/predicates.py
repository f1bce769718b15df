"""Row rules, validation and lookup queries."""

import datetime as dt

from pyspark.sql import functions as F

from ..config import ASIA_SUFFIXES, EU_SUFFIXES, SUFFIX_CURRENCY, WEIGHTS, weight_table
from ..functions import ownership, regime
from ..functions.common import r6
from ..operators import bundles, quality, ranking
from ..operators.distribution import attach
from ..operators.scan import Scan
from ..oracles.base import BADGE, FACTORS, statement
from ..oracles.factors import FACTOR_VIEWS, PILLAR_SQL
from ..session import materialize
from ..views import US_FACTORS
from .composites import DATED, dated, values
from .factors import digits
from .registry import query

def c(name):
    return F.col(name)


def quoted(items):
    return ", ".join(f"'{x}'" for x in items)


SUFFIX = "regexp_extract(upper({0}), '\\.([^.]*)$', 1)"
REGION = f"(CASE WHEN {SUFFIX} IN ({quoted(EU_SUFFIXES)}) THEN 'EU' WHEN {SUFFIX} IN ({quoted(ASIA_SUFFIXES)}) THEN 'ASIA' ELSE 'US' END)"


@query("P01_region_from_suffix", statement("uni", f"SELECT ticker, {REGION.format('ticker')} AS region FROM uni"))
def _(t):
    return t.universe.select("ticker", quality.region_of("ticker").alias("region"))


@query("P02_weight_set_per_region", statement("uni", f"SELECT ticker, factor, weight FROM (SELECT ticker, {REGION.format('ticker')} AS r FROM uni) u JOIN (" + " UNION ALL ".join(
    f"SELECT '{r}' AS r, factor, weight FROM {values(r, WEIGHTS[r])} x{i}" for i, r in enumerate(("US", "EU", "ASIA"))) + ") w USING (r)"))
def _(t):
    u = t.universe.select("ticker", quality.region_of("ticker").alias("weight_set"))
    return u.join(F.broadcast(weight_table(t.spark)), "weight_set").select("ticker", "factor", "weight")  # 41 literal rows


@query("P03_congress_eligible", statement("uni", f"SELECT ticker FROM uni WHERE {REGION.format('ticker')} = 'US'"))
def _(t):
    return t.universe.where(quality.region_of("ticker") == "US").select("ticker")


@query("P04_currency", statement("uni", f"SELECT ticker, CASE {SUFFIX.format('ticker')} " + " ".join(f"WHEN '{s}' THEN '{k}'" for s, k in SUFFIX_CURRENCY.items()) + " ELSE 'USD' END AS currency FROM uni"))
def _(t):
    return t.universe.select("ticker", quality.currency_of("ticker").alias("currency"))


@query("P05_region_guard", statement("uni", f"SELECT ticker, listed FROM (SELECT ticker, CASE WHEN sid % 10 = 0 THEN 'EU' WHEN market = 'USA' THEN 'US' WHEN market = 'EUROPE' THEN 'EU' ELSE 'ASIA' END AS listed FROM uni) z WHERE {REGION.format('ticker')} <> listed"))
def _(t):
    home = F.when(c("market") == "USA", "US").when(c("market") == "EUROPE", "EU").otherwise("ASIA")
    listed = t.universe.withColumn("listed", F.when(c("sid") % 10 == 0, "EU").otherwise(home))
    return quality.misplaced(listed, c("listed")).select("ticker", "listed")


FORMAT = "'^([A-Z]{1,5}|[A-Z0-9]{1,6}\\.[A-Z]{1,2})$'"


@query("P06_ticker_format", statement("parts", f"SELECT ticker, 'INVALID_TICKER' AS code FROM parts WHERE NOT regexp_matches(ticker, {FORMAT})"))
def _(t):
    bad = t.parts.where(~c("ticker").rlike(quality.TICKER_FORMAT))
    return bad.select("ticker", F.lit("INVALID_TICKER").alias("code"))


def amounts(t):
    cap = F.when(c("pid") % 17 == 0, None).when(c("pid") % 19 == 0, float("nan")).when(c("pid") % 23 == 0, 0.0).otherwise(c("market_cap"))
    usd = F.when(c("pid") % 29 == 0, None).when(c("pid") % 31 == 0, float("inf")).otherwise(c("c_all") / 100.0)
    return t.entries.select("pid", "ticker", cap.alias("market_cap"), usd.alias("insider_usd"))


AMOUNTS = """SELECT pid, ticker, CASE WHEN pid % 17 = 0 OR pid % 19 = 0 OR pid % 23 = 0 THEN NULL ELSE market_cap END AS cap, CASE WHEN pid % 29 = 0 OR pid % 31 = 0 THEN NULL ELSE c_all / 100.0 END AS usd FROM entries"""


@query("P07_amount_check", statement("entries", f"SELECT ticker, 'market_cap' AS field FROM ({AMOUNTS}) a WHERE cap IS NULL UNION ALL SELECT ticker, 'insider_usd' FROM ({AMOUNTS}) b WHERE usd IS NULL"))
def _(t):
    fields = F.array_compact(F.array(
        F.when(quality.unusable("market_cap", True), F.lit("market_cap")), F.when(quality.unusable("insider_usd", False), F.lit("insider_usd"))
    ))
    return amounts(t).select("ticker", F.explode(fields).alias("field"))


NOW = dt.datetime(2024, 1, 29)


def event_issues(t):
    """Events with a text time stamp, some of it broken, checked against their source's last update."""
    raw = F.when(c("event_id") % 50 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    rows = t.events.select("event_id", c("event_type").alias("source"), raw.alias("computed_at"))
    last = t.events.groupBy(c("event_type").alias("source")).agg(F.max("ts").alias("last"))
    last = last.withColumn("last", F.when(c("source") == "error", c("last") - F.expr("INTERVAL 5 DAYS")).otherwise(c("last")))
    age = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros("last")) / 3.6e9
    j = attach(rows, last.select("source", age.alias("source_age")), ["source"])
    ts = F.try_to_timestamp("computed_at", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return j.select("event_id", "source", quality.date_issue(ts, c("source_age"), NOW).alias("code"))


DATE_CODES = {"codes": ((), """
    SELECT event_id, e.event_type AS source, CASE WHEN epoch(TIMESTAMP '2024-01-29' - last) / 3600 > 48 THEN 'STALE_SOURCE' WHEN event_id % 50 = 0 THEN 'INVALID_DATE'
           WHEN epoch(TIMESTAMP '2024-01-29' - ts) < -60 THEN 'FUTURE_DATE' WHEN epoch(TIMESTAMP '2024-01-29' - ts) > 5 * 86400 THEN 'STALE_DATA' END AS code
    FROM events e JOIN (SELECT event_type, CASE WHEN event_type = 'error' THEN max(ts) - INTERVAL 5 DAY ELSE max(ts) END AS last FROM events GROUP BY 1) m USING (event_type)""")}


@query("P08_date_check", statement("codes", "SELECT event_id, source, code FROM codes", extra=DATE_CODES))
def _(t):
    return event_issues(t)


@query("P09_quarantine_split", statement("codes", "SELECT event_id, source FROM codes WHERE code IS NULL OR code = 'STALE_DATA'", extra=DATE_CODES))
def _(t):
    clean, _ = quality.split_quarantine(event_issues(t), max_share=0.95)
    return clean.select("event_id", "source")


@query("P09_quarantine_in_force", statement("codes", "SELECT event_id, source FROM codes WHERE source <> 'error' AND (code IS NULL OR code = 'STALE_DATA')", extra=DATE_CODES))
def _(t):
    """The share of failed rows stays below the stop."""
    return quality.split_quarantine(event_issues(t).where("source <> 'error'"))[0].select("event_id", "source")


@query("P09_quarantine_stops", statement("codes", "SELECT source, count(*) AS n, count(*) FILTER (code IN ('STALE_SOURCE', 'INVALID_DATE', 'FUTURE_DATE')) > 0.2 * count(*) AS stopped FROM codes GROUP BY source", extra=DATE_CODES))
def _(t):
    """Each source by itself, as a run of its own: the stop holds for the one whose feed is stale, and for no other."""
    issues = materialize(event_issues(t), "issues")
    out = []
    for r in issues.groupBy("source").count().collect():
        try:
            quality.split_quarantine(issues.where(c("source") == r["source"]))
            out.append((r["source"], r["count"], False))
        except quality.IntegrityError:
            out.append((r["source"], r["count"], True))
    return t.spark.createDataFrame(out, "source string, n long, stopped boolean")


@query("P09_issue_counts", statement("codes", "SELECT code, count(*) AS n FROM codes WHERE code IS NOT NULL GROUP BY code", extra=DATE_CODES))
def _(t):
    return event_issues(t).where("code IS NOT NULL").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("U09_reassemble", statement("codes", "SELECT event_id, source, coalesce(code IN ('STALE_SOURCE', 'INVALID_DATE', 'FUTURE_DATE'), false) AS quarantined FROM codes", extra=DATE_CODES))
def _(t):
    clean, failed = quality.split_quarantine(event_issues(t), max_share=None)
    both = clean.withColumn("quarantined", F.lit(False)).unionByName(failed.withColumn("quarantined", F.lit(True)))
    return both.select("event_id", "source", "quarantined")


N_MISSING = " + ".join(f"(CASE WHEN coalesce({f}, 0.0) = 0 THEN 1 ELSE 0 END)" for f in FACTORS)
MISSING = "concat_ws(',', " + ", ".join(f"CASE WHEN coalesce({f}, 0.0) = 0 THEN '{f}' END" for f in FACTORS) + ")"


@query("P10_completeness_gate", statement("scored", f"SELECT ticker, ({N_MISSING})::BIGINT AS n_missing, {MISSING} AS missing, ({N_MISSING}) <= 5 AS is_complete, coalesce(rsi < 30, false) AS esg_flag FROM entries".replace("FROM entries", "FROM (SELECT *, 100.0 * n_a / (n_a + n_r) AS rsi FROM scored) z")))
def _(t):
    m = quality.completeness(t.entries, list(US_FACTORS), 5)
    quality.require_complete(m, 0.40)
    return m.select("ticker", c("n_missing").cast("long"), F.array_join("missing", ",").alias("missing"), "is_complete", F.coalesce(c("rsi") < 30, F.lit(False)).alias("esg_flag"))


EU_MASK = bundles.region_factors("EU")
LEAK = [f for f in PILLAR_SQL if f not in EU_MASK]


@query("P11_region_isolation", statement("entries vel", "SELECT ticker, " + ", ".join(f"round({PILLAR_SQL[f]}, {digits(f)}) AS {f}" for f in EU_MASK) + ", concat_ws(',', " + ", ".join(
    f"CASE WHEN ({PILLAR_SQL[f]}) IS NOT NULL THEN '{f}' END" for f in sorted(LEAK)) + ") AS leaked FROM entries LEFT JOIN vel USING (pid) WHERE region = 'EU'", extra=FACTOR_VIEWS))
def _(t):
    from ..operators import events

    wide = t.entries.where("region = 'EU'").join(events.estimate_velocity(t.estimates).select("pid", "revision_velocity"), "pid", "left")
    cols = bundles.factor_columns()
    rows = wide.select("ticker", *[e.alias(n) for n, e in cols.items()])
    leaked = F.array_join(F.array_compact(F.array(*[F.when(c(f).isNotNull(), F.lit(f)) for f in sorted(LEAK)])), ",")
    return rows.select("ticker", *[F.round(f, digits(f)).alias(f) for f in EU_MASK], leaked.alias("leaked"))


@query("P12_factor_blackout", statement("parts ls", """
    SELECT market, factor, round(r, 6) AS none_rate FROM (SELECT market, factor, avg(CASE WHEN score IS NULL THEN 1 ELSE 0 END) AS r FROM ls GROUP BY 1, 2) z WHERE r >= 0.9"""))
def _(t):
    return quality.blackouts(t.long_scores, "market").select("market", "factor", r6("none_rate").alias("none_rate"))


SECTOR_ALIAS = {"Health Care": "Healthcare"}


@query("P13_canonical_sector", statement("uni", "SELECT ticker, sector FROM uni"))
def _(t):
    raw = t.universe.withColumn("sector", F.when(c("sector") == "Healthcare", "Health Care").otherwise(c("sector")))
    return raw.replace(SECTOR_ALIAS, subset=["sector"]).select("ticker", "sector")


@query("P14_badge", statement("scored", f"SELECT ticker, {BADGE.format('momentum_long')} AS badge FROM scored"))
def _(t):
    return t.entries.select("ticker", regime.badge("momentum_long").alias("badge"))


@query("P15_cap_tier_guarded", statement("parts", "SELECT ticker, CASE WHEN market_cap <= 500e6 THEN cap_tier WHEN market_cap >= 10e9 THEN 'large' WHEN market_cap >= 2e9 THEN 'mid' ELSE 'small' END AS cap_tier FROM parts"))
def _(t):
    return t.parts.select("ticker", regime.cap_tier_guarded("market_cap", "cap_tier").alias("cap_tier"))


@query("P16_cap_tier", statement("parts", "SELECT ticker, CASE WHEN market_cap >= 10e9 THEN 'large' WHEN market_cap >= 2e9 THEN 'mid' ELSE 'small' END AS tier FROM parts"))
def _(t):
    return t.parts.select("ticker", regime.cap_tier("market_cap").alias("tier"))


@query("P17_cap_segments", statement("parts", "SELECT ticker, CASE WHEN market_cap > 10e9 THEN 'large' WHEN market_cap >= 2e9 THEN 'mid' ELSE 'small' END AS bracket FROM parts WHERE market = 'USA' AND market_cap >= 300e6"))
def _(t):
    b = t.parts.where("market = 'USA'").select("ticker", regime.cap_bracket("market_cap").alias("bracket"))
    return b.where("bracket IS NOT NULL")


SURVIVES = "(coalesce(beta <= 1.2, true) AND (coalesce(de <= 0.30, false) OR coalesce(quality_piotroski, 0.0) >= 0.70))"


@query("P18_capitulation_survivor", statement("entries", f"SELECT ticker, {SURVIVES} AS survives FROM entries"))
def _(t):
    return t.entries.select("ticker", regime.survives_capitulation("beta", "de", "quality_piotroski").alias("survives"))


@query("P19_capitulation_filter", statement("dated", f"SELECT ticker, d, CASE WHEN vix >= 30 THEN 'WATCHLIST' ELSE badge END AS badge FROM dated WHERE vix < 30 OR {SURVIVES}", extra=DATED))
def _(t):
    panic = c("vix") >= 30
    rows = dated(t).where(~panic | regime.survives_capitulation("beta", "de", "quality_piotroski"))
    return rows.select("ticker", "d", F.when(panic, "WATCHLIST").otherwise(c("badge")).alias("badge"))


EXT = "coalesce(return_5d >= CASE WHEN cap_tier IN ('small', 'mid') THEN 0.18 ELSE 0.10 END, false)"
PASSED = "coalesce(target_price > 0 AND px > 0 AND target_price < px, false)"
STALE = "coalesce(surprise_pct > 0 AND surprise_days > 60, false)"
WHALE = "(coalesce(inst_flow_13f, 0.0) >= 0.80 OR coalesce(npr_spike, 0.0) >= 0.30)"
OFF = f"({EXT} OR ({PASSED} AND NOT {WHALE}) OR {STALE})"


def off_desk():
    target = regime.target_passed("target_price", "px") & ~ownership.whale_signal("inst_flow_13f", "npr_spike")
    return regime.is_extended("return_5d", "cap_tier") | target | regime.catalyst_stale("surprise_pct", "surprise_days")


def flag(name, expr, sql):
    @query(name, statement("entries", f"SELECT ticker, {sql} AS flag FROM entries"))
    def _(t):
        return t.entries.select("ticker", expr().alias("flag"))


flag("P20_extended", lambda: regime.is_extended("return_5d", "cap_tier"), EXT)
flag("P22_target_passed", lambda: regime.target_passed("target_price", "px"), PASSED)
flag("P23_catalyst_stale", lambda: regime.catalyst_stale("surprise_pct", "surprise_days"), STALE)
flag("P24_off_desk", off_desk, OFF)
flag("P25_whale_signal", lambda: ownership.whale_signal("inst_flow_13f", "npr_spike"), WHALE)
flag("P32_us_listing", lambda: quality.is_us_listing("ticker"), "(ticker NOT LIKE '%.%')")

LISTS = {"lists": (("entries",), """
    SELECT * FROM (SELECT *, row_number() OVER (ORDER BY final_score DESC, ticker) AS pos, 'top_buys' AS bucket FROM entries) a WHERE pos <= 20
    UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY final_score DESC, ticker) AS pos, 'top_buys_' || lower(market) AS bucket FROM entries) b WHERE pos <= 20
    UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cap_tier ORDER BY final_score DESC, ticker) AS pos, cap_tier || '_caps' AS bucket FROM entries
                             WHERE market = 'USA' AND cap_tier IN ('mid', 'small')) c WHERE pos <= 20""")}


def lists(t):
    return ranking.list_buckets(t.entries, 20)


@query("P26_suppress_no_upside", statement("lists", f"SELECT bucket, ticker FROM lists WHERE NOT (bucket LIKE 'top_buys%' AND {PASSED})", extra=LISTS))
def _(t):
    listed = c("bucket").startswith("top_buys")
    return lists(t).where(~(listed & regime.target_passed("target_price", "px"))).select("bucket", "ticker")


@query("P27_fresh_and_watch", statement("lists", f"SELECT bucket, ticker, CASE WHEN {EXT} THEN 'watch' ELSE 'fresh' END AS split, NOT {OFF} AS actionable FROM lists", extra=LISTS))
def _(t):
    split = F.when(regime.is_extended("return_5d", "cap_tier"), "watch").otherwise("fresh")
    return lists(t).select("bucket", "ticker", split.alias("split"), (~off_desk()).alias("actionable"))


SESSION = "(dayofweek(ny) BETWEEN 1 AND 5 AND hour(ny) * 60 + minute(ny) BETWEEN 570 AND 959)"
NY = "(SELECT *, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS ny, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quoted FROM events)"


@query("P28_stale_quote_reject", f"SELECT event_id, coalesce({SESSION} AND epoch(ts - quoted) > 900, false) AS reject FROM {NY} z")
def _(t):
    age = F.unix_micros("ts") - F.unix_micros("quoted")
    return quotes(t).select("event_id", F.coalesce(quality.is_us_session("ts") & (age > 900_000_000), F.lit(False)).alias("reject"))


def quotes(t):
    """Events with the previous event of the same user as the standing quote, however many events a user has in an hour."""
    return Scan(t.events.select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"]).previous("ts", "quoted").done()


@query("P29_us_session", f"SELECT event_id, {SESSION} AS open FROM {NY} z")
def _(t):
    return t.events.select("event_id", quality.is_us_session("ts").alias("open"))


@query("P30_quote_age", f"SELECT event_id, (epoch_us(ts) - epoch_us(quoted)) / 1e6 AS age_seconds FROM {NY} z")
def _(t):
    age = (F.unix_micros("ts") - F.unix_micros("quoted")) / 1e6
    return quotes(t).select("event_id", age.alias("age_seconds"))


@query("P31_series_age", statement("daily", "SELECT uid, DATE '2024-01-31' - max(d) AS age_days, DATE '2024-01-31' - max(d) > 4 AS stale FROM daily GROUP BY uid"))
def _(t):
    last = t.daily_bars.groupBy("uid").agg(F.max("d").alias("d"))
    age = F.datediff(F.lit(dt.date(2024, 1, 31)), "d").cast("long")
    return last.select("uid", age.alias("age_days"), (age > 4).alias("stale"))


@query("P33_price_lag", statement("bars bench", "SELECT sid, (SELECT max(d) FROM bench) - max(d) AS lag_days, (SELECT max(d) FROM bench) - max(d) > 1 AS uniquely_stale FROM bars GROUP BY sid"))
def _(t):
    newest = t.bench_bars.agg(F.max("d").alias("d")).scalar()
    last = t.bars.groupBy("sid").agg(F.max("d").alias("d"))
    behind = F.datediff(newest, c("d")).cast("long")
    return last.select("sid", behind.alias("lag_days"), (behind > 1).alias("uniquely_stale"))


@query("P34_search_universe", statement("entries", "SELECT ticker, final_score, badge FROM entries WHERE final_score >= 0.70 AND market = 'EUROPE'"))
def _(t):
    return t.entries.where("final_score >= 0.70 AND market = 'EUROPE'").orderBy(*ranking.order_by_score()).select("ticker", "final_score", "badge")


@query("P35_list_query", statement("lists", "SELECT bucket, pos, ticker FROM lists WHERE market = 'USA' AND badge = 'TACTICAL BUY'", extra=LISTS))
def _(t):
    return lists(t).where("market = 'USA' AND badge = 'TACTICAL BUY'").select("bucket", c("pos").cast("long"), "ticker")


LOOKUP = "P18"


@query("P36_point_lookup", statement("entries lists", f"""
    SELECT coalesce(s.ticker, r.ticker) AS ticker, s.final_score, r.buckets FROM entries s FULL JOIN (SELECT ticker, count(*) AS buckets FROM lists GROUP BY ticker) r ON s.ticker = r.ticker
    WHERE coalesce(s.ticker, r.ticker) = '{LOOKUP}'""", extra=LISTS))
def _(t):
    """One name, filtered on both sides of the join."""
    r = lists(t).where(c("ticker") == LOOKUP).groupBy("ticker").agg(F.count(F.lit(1)).alias("buckets"))
    return t.entries.where(c("ticker") == LOOKUP).select("ticker", "final_score").join(r, "ticker", "full")


@query("P37_schema_upgrade", statement("scored", """
    SELECT ticker, CASE WHEN pid % 2 = 0 THEN 1 ELSE 2 END AS version, congress AS congress_score, news_sentiment AS news_sentiment_score, CASE WHEN pid % 2 = 1 THEN insider_conviction END AS insider_conviction_score FROM scored""".replace("congress AS", "round(congress, 6) AS").replace("news_sentiment AS", "round(news_sentiment, 6) AS").replace("THEN insider_conviction END", "THEN round(insider_conviction, 6) END")))
def _(t):
    old = t.entries.where("pid % 2 = 0").select("ticker", r6("congress").alias("congress_score"), r6("news_sentiment").alias("news_score"), r6("momentum_long").alias("momentum_score"))
    new = t.entries.where("pid % 2 = 1").select("ticker", r6("congress").alias("congress_score"), r6("news_sentiment").alias("news_sentiment_score"), r6("insider_conviction").alias("insider_conviction_score"))
    return upgrade_schema(old).withColumn("version", F.lit(1)).unionByName(new.withColumn("version", F.lit(2)), allowMissingColumns=True)


# First-version column names and their successors; the others have none and stay missing.
OLD_NAMES = {"congress_score": "congress_score", "news_score": "news_sentiment_score"}
OLD_WITHOUT_SUCCESSOR = ("edgar_score", "insider_score", "momentum_score")


def upgrade_schema(df):
    """Rename first-version columns; columns without a successor are dropped, so they read as missing, not 0."""
    return df.withColumnsRenamed(OLD_NAMES).drop(*OLD_WITHOUT_SUCCESSOR)


@query("P38_factor_aliases", statement("ls", "SELECT ticker, CASE factor WHEN 'momentum_long' THEN 'momentum' ELSE factor END AS factor, round(score, 6) AS score FROM ls WHERE factor IN ('momentum_long', 'congress', 'news_buzz') AND score IS NOT NULL"))
def _(t):
    m = t.entries.select("ticker", F.create_map(*[x for f in ("momentum_long", "congress", "news_buzz", "volume_attention") for x in (F.lit(f), c(f))]).alias("m"))
    known = F.array(*map(F.lit, ("momentum", "congress", "news_buzz")))
    named = F.transform_keys("m", lambda k, v: F.when(k == "momentum_long", "momentum").otherwise(k))
    kept = F.map_filter(named, lambda k, v: v.isNotNull() & F.array_contains(known, k))
    return m.select("ticker", F.explode(kept).alias("factor", "score")).select("ticker", "factor", r6("score").alias("score"))


@query("P39_retroactive_discount", statement("entries", "SELECT ticker, CASE WHEN market <> 'USA' AND pid % 4 = 0 THEN final_score * 0.6 ELSE final_score END AS final_score FROM entries"))
def _(t):
    no_gate = c("market").isin("EUROPE", "ASIA") & F.when(c("pid") % 4 == 0, None).otherwise(c("quality_raw")).isNull()
    return t.entries.select("ticker", F.when(no_gate, c("final_score") * 0.6).otherwise(c("final_score")).alias("final_score"))


ERA_SQL = "CASE WHEN e IS NULL THEN 'unknown' WHEN e = 30 THEN 'v1 (macro, 30/25/20/15/10)' WHEN e = 28 THEN 'v2 (momentum, 28/23/22/15/12)' ELSE 'custom (' || e || '/' || n || ')' END"


@query("P40_era_label", statement("pstat", f"SELECT pid, {ERA_SQL} AS era FROM (SELECT pid, CASE WHEN n_a % 3 = 0 THEN 30 WHEN n_a % 3 = 1 THEN 28 ELSE n_a % 20 END AS e, n_r % 50 AS n FROM pstat) z"))
def _(t):
    e = F.when(c("n_a") % 3 == 0, 30).when(c("n_a") % 3 == 1, 28).otherwise(c("n_a") % 20)
    w = F.create_map(F.lit("edgar"), e / 100.0, F.lit("news"), (c("n_r") % 50) / 100.0)
    return t.entries.where("n_lines IS NOT NULL").select("pid", era_label(w).alias("era"))


def era_label(weights):
    """Strategy era from its weight map: two known fingerprints, else the weights in name order."""
    pct = F.transform(F.array_sort(F.map_entries(weights)), lambda kv: F.round(kv["value"] * 100).cast("int").cast("string"))
    lead = F.round(F.try_element_at(weights, F.lit("edgar")), 2)
    return (
        F.when(weights.isNull() | (F.size(weights) == 0), "unknown")
        .when(lead == 0.30, "v1 (macro, 30/25/20/15/10)").when(lead == 0.28, "v2 (momentum, 28/23/22/15/12)")
        .otherwise(F.concat(F.lit("custom ("), F.array_join(pct, "/"), F.lit(")")))
    )


@query("P41_latest_macro", """SELECT coalesce((SELECT arg_max(value, (ts, event_id)) FROM events WHERE event_type = 'signup'), (SELECT arg_max(value, (ts, event_id)) FROM events WHERE event_type = 'view')) AS vix,
    (SELECT count(*) FROM events) AS n""")
def _(t):
    def latest(kind):
        return F.max_by(F.when(c("event_type") == kind, c("value")), F.when(c("event_type") == kind, F.struct("ts", "event_id")))

    s = t.events.agg(latest("signup").alias("a"), latest("view").alias("b"), F.count(F.lit(1)).alias("n"))
    return s.select(F.coalesce("a", "b").alias("vix"), "n")


@query("P42_data_age", "SELECT event_id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3.6e9 AS age_hours, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3.6e9 > 25 AS stale FROM events")
def _(t):
    age = (F.unix_micros(F.lit(dt.datetime(2024, 1, 31)).cast("timestamp")) - F.unix_micros(F.try_to_timestamp(F.col("ts").cast("string")))) / 3.6e9
    return t.events.select("event_id", age.alias("age_hours"), (age > 25).alias("stale"))


@query("P43_missing_factor_set", statement("scored", "SELECT ticker, " + MISSING.replace("'congress' END", "'congress' END") + " AS missing FROM scored"))
def _(t):
    m = quality.completeness(t.entries, list(US_FACTORS), 5)
    tagged = F.transform("missing", lambda f: F.concat(f, F.lit(":no_data")))
    names = F.array_distinct(F.transform(tagged, lambda s: F.split_part(s, F.lit(":"), F.lit(1))))
    return m.select("ticker", F.array_join(names, ",").alias("missing"))
