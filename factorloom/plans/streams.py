"""Streaming queries over the events and line-item files, and the batch forms of the stateful ones."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import regime
from ..functions.common import ratio
from ..oracles.base import statement
from ..operators import quality, ranking
from ..session import new_path
from ..streaming import jobs, ordered
from ..views import SCHEMAS, count_when
from .registry import query


def c(name):
    return F.col(name)


N = lambda: F.count(F.lit(1))


def events_stream(t):
    return jobs.file_stream(t.spark, f"{t.folder}/events.parquet", SCHEMAS["events"])


@query("R01_sliding_article_counts", """SELECT CAST(start AS TIMESTAMP) AS start, user_id, count(*) AS n FROM (SELECT user_id, unnest(generate_series(CAST(ts AS DATE) - INTERVAL 6 DAY, CAST(ts AS DATE), INTERVAL 1 DAY)) AS start FROM events) z GROUP BY 1, 2""")
def _(t):
    return jobs.windowed_counts(events_stream(t), "user_id", "ts", 7, "1 day", "article-counts")


def window_sql(days, slide):
    return f"""SELECT pid, {days} AS days, TIMESTAMP '1970-01-01' + to_days(((k - i) * {slide})::INT) AS start, count(*) AS n FROM (SELECT l_partkey AS pid, (CAST(l_shipdate AS DATE) - DATE '1970-01-01') // {slide} AS k FROM lineitem WHERE l_returnflag = 'A') a
        CROSS JOIN range({days // slide}) r(i) GROUP BY ALL"""


@query("R02_rolling_purchase_counts", f"SELECT * FROM ({window_sql(30, 30)}) a UNION ALL SELECT * FROM ({window_sql(180, 30)}) b")
def _(t):
    buys = jobs.file_stream(t.spark, f"{t.folder}/lineitem.parquet", SCHEMAS["lineitem"]).where("l_returnflag = 'A'").select(c("l_partkey").alias("pid"), "l_shipdate")
    slots = jobs.slot_counts(buys, "pid", "l_shipdate", "30 days", "purchases")
    parts = [jobs.sliding(slots, "pid", days // 30, "30 days").select("pid", F.lit(days).alias("days"), "start", "n") for days in (30, 180)]
    return parts[0].unionByName(parts[1])


NOW = dt.datetime(2024, 1, 29)


@query("R03_record_routing", """SELECT code, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'INVALID_DATE' WHEN epoch(TIMESTAMP '2024-01-29' - ts) < -60 THEN 'FUTURE_DATE'
    WHEN epoch(TIMESTAMP '2024-01-29' - ts) > 5 * 86400 THEN 'STALE_DATA' ELSE 'OK' END AS code FROM events) z GROUP BY code""")
def _(t):
    ts = F.when(c("event_id") % 50 != 0, c("ts"))
    rows = events_stream(t).select("event_id", "user_id", "value", F.coalesce(quality.date_issue(ts, F.lit(0.0), NOW), F.lit("OK")).alias("code"))
    return jobs.route(rows, "code", "routed").groupBy("code").agg(N().alias("n"), F.min("event_id").alias("first_id"))


@query("R04_regime_transitions", statement("vix", """SELECT d, prev, label FROM (SELECT d, label, lag(label) OVER (ORDER BY d) AS prev FROM (SELECT d, CASE WHEN vix >= 30 THEN 'CAPITULATION' WHEN vix >= 20 THEN 'BEAR' ELSE 'NORMAL' END AS label FROM vix) a) b WHERE prev <> label"""))
def _(t):
    v = t.vix.select("d", regime.regime("vix").alias("label"))  # one row per calendar month
    prev = v.withColumn("prev", F.lag("label").over(Window.partitionBy(F.lit(0)).orderBy("d")))
    return prev.where("prev <> label").select("d", "prev", "label")


TRANSITION_SQL = "SELECT event_id, user_id, prev, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) z WHERE prev <> event_type"


def staged(t, df, ts, parts, label, ahead=None):
    """(path, deliveries): the rows as a feed would bring them in any order, dealt by hash of all columns; if wanted, a last delivery far ahead in time."""
    path = new_path(t.spark, label)

    def delivery(i):
        return lambda: df.where(F.pmod(F.xxhash64(*df.columns), F.lit(parts)) == i).write.mode("append").parquet(path)

    end = [lambda: ordered.heartbeat(df, ts, ahead).write.mode("append").parquet(path)] if ahead else []
    return path, [*map(delivery, reversed(range(parts))), *end]


@query("R04_transition_stream", TRANSITION_SQL)
def _(t):
    """The labels of a user in event order from deliveries in any order."""
    path, feed = staged(t, t.events, "ts", 3, "feed", "90 DAYS")

    def fold(key, state, row):
        _, tie, label = row
        changed = state is not None and state[0] is not None and label is not None and state[0] != label
        return (label,), [(tie, key[0], state[0], label)] if changed else []

    out = "event_id long, user_id long, prev string, event_type string"
    return ordered.in_order(lambda: jobs.file_stream(t.spark, path, SCHEMAS["events"]), "user_id", "ts", "event_id", ["event_type"], "60 days", "last string", out, fold, "transitions", feed)


@query("R04_transition_batch", TRANSITION_SQL)
def _(t):
    return jobs.transitions(t.events, "user_id", "ts", "event_id", "event_type").select("event_id", "user_id", "prev", "event_type")


RUN_SQL = "(SELECT user_id % 5 AS feed, date_trunc('hour', ts) AS run, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) < 0.3 AS ok FROM events GROUP BY 1, 2)"
STREAK_SQL = f"""SELECT feed, run, streak, streak >= 3 AS escalate FROM (SELECT feed, run, count(*) FILTER (NOT ok) OVER (PARTITION BY feed, g ORDER BY run ROWS UNBOUNDED PRECEDING) AS streak FROM (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY feed ORDER BY run ROWS UNBOUNDED PRECEDING) AS g FROM {RUN_SQL} r) a) b"""


def feed_runs(events):
    """One row per feed and hour: did the run stay under 30 % errors."""
    e = events.groupBy((c("user_id") % 5).alias("feed"), F.date_trunc("hour", "ts").alias("run")).agg(N().alias("n"), count_when(c("event_type") == "error").alias("bad"))
    return e.select("feed", "run", (ratio("bad", "n") < 0.3).alias("ok"))


@query("R05_failure_streak_batch", STREAK_SQL)
def _(t):
    return jobs.failure_streaks(feed_runs(t.events), "feed", "run", "ok").select("feed", "run", "streak", "escalate")


@query("R05_failure_streak_stream", STREAK_SQL)
def _(t):
    """Hourly runs are closed by the watermark, and their streaks follow from the store's count, whatever the order of deliveries."""
    path, feed = staged(t, t.events, "ts", 3, "feed", "90 DAYS")

    def runs():
        e = jobs.file_stream(t.spark, path, SCHEMAS["events"]).withWatermark("ts", "60 days")
        hours = e.groupBy(F.window("ts", "1 hour").alias("w"), (c("user_id") % 5).alias("feed")).agg(N().alias("n"), count_when(c("event_type") == "error").alias("bad"))
        return hours.select("feed", F.window_time("w").alias("t"), F.unix_micros("w.start").alias("run"), (ratio("bad", "n") < 0.3).alias("ok"))

    def fold(key, state, row):
        _, run, ok = row
        streak = 0 if ok else (state[0] if state else 0) + 1
        return (streak,), [(key[0], run, streak, streak >= 3)]

    out = ordered.in_order(runs, "feed", "t", "run", ["ok"], None, "streak long", "feed long, run long, streak long, escalate boolean", fold, "streaks", feed)
    return out.where("feed IS NOT NULL").withColumn("run", F.timestamp_micros("run"))


@query("R06_tenure_batch", statement("snaps", """SELECT market, ticker, d, row_number() OVER (PARTITION BY market, ticker, m - rn ORDER BY m) AS run FROM (SELECT *, row_number() OVER (PARTITION BY market, ticker ORDER BY m) AS rn FROM (
    SELECT market, ticker, d, year(d) * 12 + month(d) AS m, row_number() OVER (PARTITION BY market, d ORDER BY score DESC, ticker) AS pos FROM snaps) a WHERE pos <= 10) b"""))
def _(t):
    top = ranking.top_per(t.snaps, ["market", "d"], 10, "score").select("market", "ticker", "d", (F.year("d") * 12 + F.month("d")).alias("m"))
    return jobs.run_lengths(top, ["market", "ticker"], "m").select("market", "ticker", "d", "run")


YEARS = [dt.date(y, 1, 1) for y in range(1997, 2002)]


def tenure_sql(n=5, most=2):
    """The desk runs chained: each reads the state of the one before."""
    steps, bounds = ["s0 AS (SELECT NULL::VARCHAR AS ticker, 0 AS tenure WHERE false)"], [None, *YEARS, None]
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]), 1):
        span = " AND ".join([f"d >= DATE '{lo}'"] * (lo is not None) + [f"d < DATE '{hi}'"] * (hi is not None))
        steps += [
            f"j{i} AS MATERIALIZED (SELECT k.*, coalesce(s.tenure, 0) AS ten FROM (SELECT market, ticker, round(avg(score), 9) AS f, max(year(d)) AS yr FROM snaps WHERE {span} GROUP BY 1, 2) k LEFT JOIN s{i - 1} s USING (ticker))",
            f"p{i} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY f DESC, ticker) AS pos FROM j{i} WHERE ten < {most}) z WHERE pos <= {n})",
            f"e{i} AS MATERIALIZED (SELECT market, count(*) AS k, arg_max(f, pos) AS lf, arg_max(ticker, pos) AS lt FROM p{i} GROUP BY 1)",
            f"m{i} AS MATERIALIZED (SELECT market, ticker, 'selected' AS action, ten, yr FROM p{i} UNION ALL SELECT market, ticker, 'cooldown', ten, yr FROM j{i} LEFT JOIN e{i} USING (market) WHERE ten >= {most} AND (k IS NULL OR k < {n} OR f > lf OR (f = lf AND ticker < lt)))",
            f"s{i} AS MATERIALIZED (SELECT ticker, CASE WHEN action = 'cooldown' THEN 0 ELSE coalesce(s.tenure, 0) + 1 END AS tenure FROM (SELECT DISTINCT ticker, action FROM m{i}) a LEFT JOIN s{i - 1} s USING (ticker))",
        ]
    body = " UNION ALL ".join(f"SELECT market, ticker, action, ten::INT AS tenure, yr::INT AS year FROM m{i}" for i in range(1, len(YEARS) + 2))
    return statement("snaps", "") + ", " + ", ".join(steps) + " " + body


@query("R06_tenure_stream", tenure_sql())
def _(t):
    """Yearly desks with cooldown: tenure carried over the runs, names on cooldown sit one run out. Years come in any order."""
    fields = (("sid", T.LongType()), ("ticker", T.StringType()), ("market", T.StringType()), ("d", T.DateType()), ("score", T.DoubleType()))
    path, feed = staged(t, t.snaps.select(*[n for n, _ in fields]), "d", 3, "desks")
    rows = T.StructType([T.StructField(n, k) for n, k in fields])
    state = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("tenure", T.IntegerType())])
    out = T.StructType([T.StructField(n, k) for n, k in (("market", T.StringType()), ("ticker", T.StringType()), ("action", T.StringType()), ("tenure", T.IntegerType()), ("year", T.IntegerType()))])

    def step(batch, before):
        desk = batch.groupBy("market", "ticker").agg(F.round(F.avg("score"), 9).alias("final_score"), F.max(F.year("d")).alias("year"))
        moves = ranking.cooled_top_n(desk, before, 5, 2, ["market"])
        return ranking.update_tenure(before, moves), moves.select("market", "ticker", "action", "tenure", "year")

    # desks run from one of YEARS to the next
    period = sum((c("d") >= F.lit(y)).cast("long") for y in YEARS)
    return ordered.in_periods(lambda: jobs.file_stream(t.spark, path, rows), rows, period, len(YEARS), state, ["ticker"], out, "tenure", step, feed)


@query("R07_dead_feed_streak", """SELECT user_id, DATE '2024-01-31' - max(CAST(ts AS DATE)) FILTER (event_type = 'purchase') AS dead_days, count(*) FILTER (event_type = 'purchase') = 0 AS never FROM events GROUP BY user_id""")
def _(t):
    alive = F.max(F.when(c("event_type") == "purchase", F.to_date("ts")))
    s = t.events.groupBy("user_id").agg(alive.alias("last"))
    return s.select("user_id", F.datediff(F.lit(dt.date(2024, 1, 31)), "last").cast("long").alias("dead_days"), c("last").isNull().alias("never"))


@query("R07_dead_streak_history", """SELECT uid, d, row_number() OVER (PARTITION BY uid, m - rn ORDER BY d) AS run FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY d) AS rn, d - DATE '2024-01-01' AS m FROM (
    SELECT user_id AS uid, CAST(ts AS DATE) AS d FROM events GROUP BY 1, 2 HAVING count(*) FILTER (event_type = 'purchase') = 0) a) b""")
def _(t):
    days = t.events.groupBy(c("user_id").alias("uid"), F.to_date("ts").alias("d")).agg(count_when(c("event_type") == "purchase").alias("k")).where("k = 0")
    return jobs.run_lengths(days.withColumn("m", F.datediff("d", F.lit(dt.date(2024, 1, 1)))), ["uid"], "m").select("uid", "d", "run")


@query("R08_data_as_of", "SELECT min(ts) AS as_of, count(*) AS sources FROM (SELECT max(ts) AS ts FROM events GROUP BY event_type UNION ALL SELECT max(l_shipdate) FROM lineitem UNION ALL SELECT max(o_orderdate) FROM orders) z")
def _(t):
    legs = t.events.groupBy("event_type").agg(F.max("ts").alias("ts")).select("ts")
    legs = legs.unionByName(t.lineitem.agg(F.max("l_shipdate").alias("ts"))).unionByName(t.orders.agg(F.max("o_orderdate").alias("ts")))
    return legs.agg(F.min("ts").alias("as_of"), N().alias("sources"))
