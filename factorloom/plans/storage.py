"""Source and sink queries. Inputs are written from the given tables first, then read back whole."""

import datetime as dt

from pyspark.sql import functions as F

from ..config import WEIGHTS
from ..functions.common import r6
from ..operators import events
from ..operators.distribution import attach
from ..oracles.base import US, statement
from ..session import new_path
from ..sources import readers, writers
from ..views import AS_OF, midnight
from .predicates import LISTS, lists
from .registry import query


def c(name):
    return F.col(name)


N = lambda: F.count(F.lit(1))


def raw_universe(t):
    k = c("pid") % 9
    return t.parts.select(
        F.when(k == 0, F.concat(F.lit("  "), F.lower("ticker"))).when(k == 1, "   ").otherwise(c("ticker")).alias("ticker"),
        F.when(k == 2, "").otherwise(c("sector")).alias("sector"), F.when(k == 3, None).otherwise(c("cap_tier")).alias("cap_tier"),
    )


UNIVERSE_SQL = "SELECT ticker, CASE WHEN pid % 9 = 2 THEN 'Unknown' ELSE sector END AS sector, CASE WHEN pid % 9 = 3 THEN 'large' ELSE cap_tier END AS cap_tier FROM parts WHERE pid % 9 <> 1"


@query("S01_universe_csv", statement("parts", UNIVERSE_SQL))
def _(t):
    path = new_path(t.spark, "universe")
    raw_universe(t).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_universe_csv(t.spark, path)


@query("S01_ticker_csv", statement("parts", "SELECT DISTINCT ticker FROM parts WHERE pid % 9 <> 1"))
def _(t):
    path = new_path(t.spark, "tickers")
    raw_universe(t).write.option("header", True).csv(path)
    return readers.read_universe_csv(t.spark, path).select("ticker").distinct()


@query("S02_registry_json", statement("uni", "SELECT market, ticker, sector, cap_tier FROM uni WHERE market <> 'USA'"))
def _(t):
    path = new_path(t.spark, "registry")
    item = F.struct("ticker", "sector", "cap_tier")
    # One document per slice of names: a registry file of any size never needs to fit one row.
    docs = t.universe.where("market <> 'USA'").groupBy(F.pmod("sid", F.lit(64)).alias("slice"), F.floor(c("sid") / 6400).alias("block")).agg(
        F.collect_list(F.when(c("market") == "EUROPE", item)).alias("europe"), F.collect_list(F.when(c("market") == "ASIA", item)).alias("asia")
    )
    docs.select("europe", "asia").write.json(path)
    return readers.read_registry(t.spark, path, {"europe": "EUROPE", "asia": "ASIA"}).select("market", "ticker", "sector", "cap_tier")


BULK = "row_id long, symbol string, price double"


def bulk_rows(t):
    return t.parts.select(c("pid").alias("row_id"), c("ticker").alias("symbol"), c("market_cap").alias("price"))


@query("S03_mixed_bulk_dumps", statement("parts", "SELECT pid AS row_id, ticker AS symbol, market_cap AS price FROM parts"))
def _(t):
    rows, path = bulk_rows(t), new_path(t.spark, "bulk")
    turn = lambda k: rows.where(c("row_id") % 4 == k)
    broken = t.spark.range(3).select(F.element_at(F.array(F.lit("{broken"), F.lit(""), F.lit('{"row_id": 1, "sym')), c("id").cast("int") + 1).alias("value"))
    turn(0).select(F.to_json(F.struct(*rows.columns)).alias("value")).unionByName(broken).write.text(f"{path}/lines")
    other = turn(1).select("price", F.concat(F.lit("x, "), "symbol").alias("note, quoted"), c("symbol").alias("Symbol"), "row_id")
    other.write.csv(f"{path}/csv", header=True, quoteAll=True)
    # one array a file, of at most 5,000 rows
    for k, pretty in ((2, "false"), (3, "true")):
        chunks = turn(k).groupBy(F.floor(c("row_id") / 20_000).alias("chunk")).agg(F.to_json(F.collect_list(F.struct(*rows.columns)), {"pretty": pretty}).alias("value"))
        chunks.repartition("chunk").write.partitionBy("chunk").text(f"{path}/array{k}")
    return readers.sniff_bulk(t.spark, path, BULK).where("bad IS NULL").drop("bad")


@query("S04_cell_coercion", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN TRY_CAST(event_id AS BIGINT) END AS as_long, CASE WHEN event_id % 4 = 1 THEN value END AS as_double, CASE WHEN event_id % 4 = 2 THEN event_type END AS as_text FROM events""")
def _(t):
    k = c("event_id") % 4
    cell = F.when(k == 0, F.concat(F.lit(" "), c("event_id").cast("string"))).when(k == 1, F.concat(c("value").cast("string"), F.lit(" "))).when(k == 2, c("event_type")).otherwise("  ")
    v = t.events.select("event_id", readers.coerce_cell(cell).alias("v")).select("event_id", "v.*")
    return v.withColumn("as_double", F.when(k == 1, F.coalesce("as_double", c("as_long").cast("double"))).otherwise(c("as_double"))).withColumn("as_long", F.when(k != 1, c("as_long")))


@query("S05_tolerant_load", statement("parts", "SELECT pid AS row_id, ticker AS symbol, market_cap AS price FROM parts"))
def _(t):
    path = new_path(t.spark, "dump")
    bulk_rows(t).write.json(path)
    there = readers.read_tolerant(t.spark, path, BULK)
    absent = readers.read_tolerant(t.spark, f"{path}-absent", BULK)
    return there.unionByName(absent)


@query("S06_ndjson", "SELECT event_id, user_id, event_type, value FROM events")
def _(t):
    path = new_path(t.spark, "nd")
    t.events.select("event_id", "user_id", "event_type", "value").write.json(path)
    return t.spark.read.schema("event_id long, user_id long, event_type string, value double").json(path)


@query("S07_filings_xml", statement("tx", "SELECT pid, count(*) AS n, round(sum(shares * (value_c / 100.0)), 2) AS value FROM tx WHERE code = 'P' GROUP BY pid"))
def _(t):
    path = new_path(t.spark, "filings")
    p = t.insider_rows(code="P")
    # A filing holds one owner's transactions of one day.
    one = p.groupBy("pid", "insider_id", "d").agg(F.collect_list(F.struct(c("code"), c("shares").cast("double").alias("shares"), (c("value_c") / 100.0).alias("price"), c("d").cast("string").alias("day"))).alias("tx"))
    filings = one.select(
        c("pid").cast("string").alias("issuer"), c("d").cast("string").alias("filed"), F.struct(c("insider_id").cast("string").alias("id"), F.lit("CEO").alias("title")).alias("owner"), "tx"
    )
    writers.write_filings_xml(filings, path)
    rows = readers.read_filings_xml(t.spark, path)
    return rows.groupBy(c("issuer").cast("long").alias("pid")).agg(N().alias("n"), F.round(F.sum("value"), 2).alias("value"))


ROLE = "CASE l_linenumber WHEN 1 THEN 'Chief Executive Officer' WHEN 2 THEN 'CFO' WHEN 3 THEN 'Director' ELSE 'Analyst' END"


@query("S08_filing_index", f"""SELECT pid, count(*) FILTER (f = 'A' AND key) AS n_buy, count(*) FILTER (f = 'R' AND key) AS n_sell, coalesce(sum(v) FILTER (f = 'A' AND key), 0)::BIGINT AS buy_c FROM (
    SELECT l_partkey AS pid, l_returnflag AS f, CAST(round(l_extendedprice * 100) AS BIGINT) AS v, l_linenumber <= 3 AS key, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn
    FROM lineitem WHERE l_linestatus = 'F' AND DATE '2001-11-05' - CAST(l_shipdate AS DATE) <= 900) z WHERE rn <= 10 GROUP BY pid""")
def _(t):
    n = c("l_linenumber")
    title = F.when(n == 1, "Chief Executive Officer").when(n == 2, "CFO").when(n == 3, "Director").otherwise("Analyst")
    rows = t.lineitem.where((c("l_linestatus") == "F") & (c("l_shipdate") >= F.lit(midnight(AS_OF, 900)))).withColumnRenamed("l_partkey", "pid")
    top = events.newest_n(rows, ["pid"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_extendedprice")], 10)
    key = readers.is_key_role(title)
    buy, sell = key & (c("l_returnflag") == "A"), key & (c("l_returnflag") == "R")
    cents = F.round(c("l_extendedprice") * 100).cast("long")
    return top.groupBy("pid").agg(
        F.sum(buy.cast("long")).alias("n_buy"), F.sum(sell.cast("long")).alias("n_sell"), F.coalesce(F.sum(F.when(buy, cents)), F.lit(0).cast("long")).alias("buy_c")
    )


SNAP_ROWS = "sid long, ticker string, score double"


def stored_snapshots(t):
    path = new_path(t.spark, "snapshots")
    writers.write_snapshot(t.snaps.select("sid", "ticker", "score", c("d").alias("snapshot_date")), path)
    return path


@query("S09_dated_snapshots", statement("snaps", "SELECT sid, score, d AS snapshot_date FROM snaps WHERE d BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' AND d IN (SELECT d FROM snaps GROUP BY d HAVING count(*) >= 9)"))
def _(t):
    return readers.read_snapshots(t.spark, stored_snapshots(t), SNAP_ROWS, "1998-01-01", "2000-12-31", 9, 12).select("sid", "score", "snapshot_date")


@query("S10_idempotent_snapshot_sink", statement("snaps", "SELECT d AS snapshot_date, count(*) AS n, round(sum(score), 6) AS total FROM snaps GROUP BY d"))
def _(t):
    """Other scores for dates that are there are kept out."""
    path = stored_snapshots(t)
    writers.write_snapshot(t.snaps.where("d < DATE'1999-01-01'").select("sid", "ticker", (c("score") + 1).alias("score"), c("d").alias("snapshot_date")), path)
    return readers.committed(t.spark, path, SNAP_ROWS).groupBy("snapshot_date").agg(N().alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query("S11_backfill_artefacts", statement("snaps", "SELECT d AS snapshot_date, count(*) AS n, round(sum(score), 6) AS total FROM snaps GROUP BY d"))
def _(t):
    src, dst = new_path(t.spark, "artefacts"), new_path(t.spark, "backfill")
    t.snaps.select("sid", "ticker", "score", F.date_format("d", "yyyy-MM-dd").alias("run")).write.partitionBy("run").json(src)
    found = t.spark.read.schema(SNAP_ROWS).option("recursiveFileLookup", "true").json(src)
    dated = found.withColumn("snapshot_date", F.to_date(F.regexp_extract(F.input_file_name(), r"run=(\d{4}-\d{2}-\d{2})", 1)))
    writers.write_snapshot(dated, dst)
    back = readers.committed(t.spark, dst, SNAP_ROWS)
    return back.groupBy("snapshot_date").agg(N().alias("n"), F.round(F.sum("score"), 6).alias("total"))


def archive(t):
    """Two dated list documents per list slice, as archived runs."""
    path = new_path(t.spark, "archive")
    e = lists(t).withColumn("day", F.explode(F.array(F.lit("2024-03-01 09:00:00"), F.lit("2024-03-02 22:00:00")))).withColumn("generated_at", F.to_timestamp("day"))
    item = F.struct("ticker", "final_score", "badge", "market", "cap_tier")
    docs = e.groupBy("generated_at").pivot("bucket", list(readers.ARCHIVE_LISTS)).agg(F.collect_list(item))
    docs.withColumn("day", F.to_date("generated_at")).write.partitionBy("day").json(path)
    return path


@query("S12_archive_signals", statement("lists", """SELECT DISTINCT ticker, day::DATE AS signal_date, badge, final_score, day >= TIMESTAMP '2024-03-02' AS entry_next_day FROM lists CROSS JOIN (VALUES (TIMESTAMP '2024-03-01 09:00:00'), (TIMESTAMP '2024-03-02 22:00:00')) v(day)
    WHERE bucket IN ('top_buys', 'top_buys_usa', 'top_buys_europe', 'top_buys_asia', 'mid_caps', 'small_caps') AND badge <> 'WATCHLIST'""", extra=LISTS))
def _(t):
    return readers.archive_signals(readers.read_archive(t.spark, archive(t))).select("ticker", "signal_date", "badge", "final_score", "entry_next_day")


@query("S13_archive_walk", statement("lists", "SELECT bucket, 2 * count(*) AS n FROM lists GROUP BY bucket", extra=LISTS))
def _(t):
    return readers.read_archive(t.spark, archive(t)).groupBy("bucket").agg(N().alias("n"))


@query("S14_previous_scores", statement("snaps", "SELECT sid, score, d AS snapshot_date FROM snaps WHERE d = (SELECT max(d) FROM snaps WHERE d < DATE '2001-03-15')"))
def _(t):
    s = readers.committed(t.spark, stored_snapshots(t), SNAP_ROWS)
    before = s.where("snapshot_date < DATE'2001-03-15'")
    last = before.agg(F.max("snapshot_date")).scalar()
    return before.where(c("snapshot_date") == last).groupBy("sid", "snapshot_date").agg(F.min("score").alias("score")).select("sid", "score", "snapshot_date")


@query("S15_rows_of_any_shape", statement("entries", "SELECT ticker, final_score FROM entries"))
def _(t):
    path = new_path(t.spark, "shapes")
    item = F.struct("ticker", "final_score")
    slices = t.entries.groupBy((c("pid") % 3).alias("shape"), F.floor(c("pid") / 600).alias("block")).agg(F.collect_list(item).alias("items"))
    slices.select(*[F.when(c("shape") == i, c("items")).alias(n) for i, n in enumerate(("results", "rankings", "rows"))]).write.json(path)
    return readers.read_rows_any(t.spark, path, "struct<ticker:string,final_score:double>")


@query("S16_trade_ledger", statement("snaps", "SELECT sid, d, score, fwd FROM snaps WHERE score >= 0.62"))
def _(t):
    path = new_path(t.spark, "ledger")
    writers.write_ledger(t.snaps.where("score >= 0.62").select("sid", "d", "score", "fwd"), path)
    return t.spark.read.csv(path, header=True, schema="sid long, d date, score double, fwd double")


@query("S17_json_report", statement("snaps", "SELECT market, count(*) AS n, round(avg(score), 9) AS mean FROM snaps GROUP BY market"))
def _(t):
    path = new_path(t.spark, "report")
    stats = t.snaps.groupBy("market").agg(F.struct(N().alias("n"), F.round(F.avg("score"), 9).alias("mean")).alias("stats"))
    writers.write_report(stats, path)
    return t.spark.read.schema("market string, stats struct<n long, mean double>").json(path).select("market", "stats.*")


@query("S18_append_log", statement("entries", "SELECT action, count(*) AS n FROM (SELECT CASE WHEN final_score >= 0.7 THEN 'added' ELSE 'cooldown' END AS action FROM entries) z GROUP BY action"))
def _(t):
    path = new_path(t.spark, "log")
    e = t.entries.select("ticker", F.when(c("final_score") >= 0.7, "added").otherwise("cooldown").alias("action"), c("final_score").alias("score"))
    writers.append_log(e.where("action = 'added'"), path)
    writers.append_log(e.where("action = 'cooldown'"), path)
    return t.spark.read.schema("ticker string, action string, score double").json(path).groupBy("action").agg(N().alias("n"))


STATUS = "(SELECT event_type AS source, count(*) AS n, CASE WHEN event_type = 'error' THEN 'failed' WHEN max(ts) < TIMESTAMP '2024-01-30 21:00:00' THEN 'stale' ELSE 'fresh' END AS status FROM events GROUP BY 1)"


def source_status(t):
    """fresh / stale / failed per source, from its newest record."""
    s = t.events.groupBy(c("event_type").alias("source")).agg(F.max("ts").alias("last"), N().alias("n"))
    status = F.when(c("source") == "error", "failed").when(c("last") < F.lit(dt.datetime(2024, 1, 30, 21)).cast("timestamp"), "stale").otherwise("fresh")
    return s.select("source", "n", status.alias("status"))


@query("S20_source_status", f"SELECT source, n, status FROM {STATUS} s")
def _(t):
    return source_status(t)


@query("S21_usable_sources", f"SELECT e.event_id, s.status NOT IN ('stale', 'failed') AS usable, CASE WHEN s.status NOT IN ('stale', 'failed') THEN e.value ELSE -1.0 END AS value FROM events e LEFT JOIN {STATUS} s ON e.event_type = s.source")
def _(t):
    j = attach(t.events, source_status(t).select(c("source").alias("event_type"), "status"), ["event_type"])
    usable = ~F.coalesce(c("status").isin("stale", "failed"), F.lit(False))
    return j.select("event_id", usable.alias("usable"), F.coalesce(F.when(usable, c("value")), F.lit(-1.0)).alias("value"))


@query("S22_explain_store", statement("entries", "SELECT ticker, final_score, " + ", ".join(f"round({f} * {US[f]}, 9) AS {f}" for f in ("momentum_long", "congress", "news_sentiment")) + f", ({' + '.join(f'(CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END)' for f in US)})::BIGINT AS n FROM entries"))
def _(t):
    path = new_path(t.spark, "explain")
    writers.write_explain(t.entries, WEIGHTS["US"], path)
    x = t.spark.read.schema("ticker string, final_score double, contributions map<string,double>").parquet(path)
    parts = [F.round(F.try_element_at("contributions", F.lit(f)), 9).alias(f) for f in ("momentum_long", "congress", "news_sentiment")]
    return x.select("ticker", "final_score", *parts, F.size("contributions").cast("long").alias("n"))


@query("S23_market_cap_lookup", statement("parts", "SELECT ticker, CASE WHEN pid % 6 = 0 THEN 0.0 ELSE market_cap END AS market_cap FROM parts"))
def _(t):
    quotes = t.parts.where("pid % 6 <> 0").select("ticker", "market_cap")
    return t.parts.select("ticker").join(quotes, "ticker", "left").select("ticker", F.coalesce("market_cap", F.lit(0.0)).alias("market_cap"))
