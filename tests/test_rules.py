"""Rotation, validation, scorers, storage and streaming rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom import config
from factorloom.functions import consensus, fundamentals, ownership, price, regime, text
from factorloom.operators import audit, quality, ranking
from factorloom.session import names_below, new_path, put_if_absent
from factorloom.sources import readers, writers
from factorloom.streaming import jobs, ordered


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


L = F.lit


def test_weight_sets_add_up():
    config.check_sums()
    with pytest.raises(ValueError):
        config.check_sums({"bad": {"a": 0.5}})


@pytest.mark.parametrize("vix,mult,label", [(10.0, 1.0, "NORMAL"), (20.0, 0.8, "BEAR"), (30.0, 0.5, "CAPITULATION"), (45.0, 0.2, "CAPITULATION")])
def test_regime_bands(spark, vix, mult, label):
    assert one(spark, regime.vol_multiplier(L(vix))) == mult
    assert one(spark, regime.regime(L(vix))) == label


def test_scorer_null_and_bounds(spark):
    none = L(None).cast("double")
    assert one(spark, price.momentum(none)) == 0.0
    assert one(spark, price.momentum(L(float("nan")))) == 0.0
    assert one(spark, price.momentum(L(5.0))) == 1.0
    assert one(spark, price.upside(none, L(10.0))) is None
    assert one(spark, price.upside(L(0.0), L(10.0))) is None
    assert one(spark, price.upside(L(5.0), L(10.0))) == 0.0
    assert one(spark, fundamentals.quality_points(none, none, L(-0.5), none, none, none)) == 0
    assert one(spark, fundamentals.pb_value(L(-1.0), L(10.0))) == 0.0
    assert one(spark, fundamentals.dupont_quality(none, none, none, none)) == 0.0
    assert one(spark, ownership.dividend_sustain(none, none, none, none)) is None
    assert one(spark, ownership.dividend_sustain(L(0.0), none, none, none)) == 0.0
    assert one(spark, ownership.dividend_sustain(L(0.03), none, L(1.0), L(2.0))) is None
    assert one(spark, ownership.congress(none, none, none)) == 0.0
    assert one(spark, ownership.congress(L(0), L(0), none)) == 0.5
    assert one(spark, consensus.surprise_drift(L(0.3), L(91))) is None
    assert one(spark, consensus.surprise_drift(L(0.3), L(75))) == pytest.approx(0.65)
    assert one(spark, consensus.revision(L(0.3), L(2))) is None
    assert one(spark, text.transcript_tone(L(""))) is None
    assert one(spark, text.transcript_tone(L("We are raising guidance. Raised guidance again, headwinds ease."))) == 0.8
    assert one(spark, ownership.conviction(L(1e6), L(1e9), L(10))) > one(spark, ownership.conviction(L(1e6), L(1e9), L(170)))


def test_whole_text_is_scored(spark):
    late = "x " * 5000 + "lowered guidance"
    assert one(spark, text.transcript_tone(L(late))) == 0.2


def entries(spark, rows):
    return spark.createDataFrame(rows, "ticker string, market string, final_score double")


def test_cooldown_event_only_ahead_of_the_last_pick(spark):
    e = entries(spark, [("A", "USA", 0.9), ("B", "USA", 0.8), ("C", "USA", 0.7), ("D", "USA", 0.6)])
    state = spark.createDataFrame([("A", 3), ("D", 3), ("B", 1)], "ticker string, tenure int")
    r = {x["ticker"]: (x["action"], x["added"]) for x in ranking.cooled_top_n(e, state, 2, 3, ["market"]).collect()}
    assert r == {"A": ("cooldown", False), "B": ("selected", False), "C": ("selected", True)}
    moved = ranking.cooled_top_n(e, state, 2, 3, ["market"])
    assert {x["ticker"]: x["tenure"] for x in ranking.update_tenure(state, moved).collect()} == {"A": 0, "B": 2, "C": 1}


def test_cooldown_all_when_list_is_short(spark):
    e = entries(spark, [("A", "USA", 0.9), ("B", "USA", 0.2)])
    state = spark.createDataFrame([("B", 5)], "ticker string, tenure int")
    r = {x["ticker"]: x["action"] for x in ranking.cooled_top_n(e, state, 3, 3, ["market"]).collect()}
    assert r == {"A": "selected", "B": "cooldown"}


def test_ties_go_to_the_smaller_ticker(spark):
    e = entries(spark, [("B", "USA", 0.5), ("A", "USA", 0.5), ("C", "USA", 0.5)])
    assert [x["ticker"] for x in ranking.top_overall(e, 2).orderBy("pos").collect()] == ["A", "B"]


def test_toxic_rows_abort(spark):
    df = spark.createDataFrame([("A", None)] * 7 + [("B", "INVALID_DATE")] * 3, "ticker string, code string")
    with pytest.raises(quality.IntegrityError):
        quality.split_quarantine(df)
    clean, failed = quality.split_quarantine(df, max_share=0.5)
    assert (clean.count(), failed.count()) == (7, 3)


def test_incomplete_universe_aborts(spark):
    df = spark.createDataFrame([(0.0, None)] * 5 + [(0.5, 0.5)], "a double, b double")
    flagged = quality.completeness(df, ["a", "b"], 1)
    with pytest.raises(quality.IntegrityError):
        quality.require_complete(flagged)
    assert {tuple(r["missing"]) for r in flagged.collect()} == {("a", "b"), ()}


def test_audit_raises_on_first_violation(spark):
    row = [("top_buys", 1, "AAA", 0.7, "TACTICAL BUY", "USA", 0.0, 10.0), ("top_buys", 2, "BBB", 0.9, "HIGH BUY", "USA", 0.0, 10.0)]
    lists = spark.createDataFrame(row, "bucket string, pos int, ticker string, final_score double, badge string, market string, congress double, vix double")
    with pytest.raises(quality.IntegrityError, match="C_SORTING"):
        audit.audit(lists)
    audit.audit(lists.where("pos = 1"))


def test_rows_of_another_region_are_found(spark):
    df = spark.createDataFrame([("ABC",), ("ABC.PA",), ("ABC.T",), ("ABC.XX",)], "ticker string")
    assert [r["ticker"] for r in quality.misplaced(df, L("US")).orderBy("ticker").collect()] == ["ABC.PA", "ABC.T"]


def test_cell_coercion(spark):
    df = spark.createDataFrame([("12",), (" 1.5 ",), ("",), (None,), ("abc",), ("1e3",)], "x string")
    got = [tuple(r["v"]) for r in df.select(readers.coerce_cell("x").alias("v")).collect()]
    assert got == [(12, None, None), (None, 1.5, None), (None, None, None), (None, None, None), (None, None, "abc"), (None, 1000.0, None)]


def test_first_write_of_a_date_stays(spark):
    path, schema = new_path(spark, "snap-test"), "ticker string, score double"
    day = lambda d, v: spark.createDataFrame([("A", v, dt.date(2020, 1, d))], f"{schema}, snapshot_date date")
    assert readers.committed(spark, path, schema).collect() == []
    assert writers.write_snapshot(day(1, 0.1).unionByName(day(2, 0.2)), path) == ["2020-01-01", "2020-01-02"]
    assert writers.write_snapshot(day(2, 0.9).unionByName(day(3, 0.3)), path) == ["2020-01-03"]
    # a write that was killed before it committed
    day(4, 0.4).write.partitionBy("snapshot_date").parquet(f"{path}/parts/run=killed")
    day(1, 0.5).write.partitionBy("snapshot_date").parquet(f"{path}/parts/run=late")
    rows = readers.committed(spark, path, schema).orderBy("snapshot_date").collect()
    assert [(r["snapshot_date"].day, r["score"]) for r in rows] == [(1, 0.1), (2, 0.2), (3, 0.3)]
    with pytest.raises(quality.IntegrityError):
        readers.read_snapshots(spark, path, schema, "2020-01-01", "2020-12-31", 1, 60)


def test_only_one_of_two_writers_puts_a_file(spark):
    path = new_path(spark, "commit-test")
    assert [put_if_absent(spark, f"{path}/x", who) for who in ("one", "two")] == [True, False]
    assert [r[0] for r in spark.read.text(f"{path}/x").collect()] == ["one"] and names_below(spark, path) == ["x"]


def test_bulk_files_keep_their_own_long_headers(spark, tmp_path):
    """Two headers that are equal for more than 4,000 characters, and JSON in three layouts."""
    wide = ",".join(f"note_{i:04}" for i in range(500))
    (tmp_path / "a.csv").write_text(f"{wide},row_id,symbol\n" + "x," * 500 + '1,"A, Inc"\n\n' + "y," * 500 + "one,B\n")
    (tmp_path / "b.csv").write_text(f"{wide},Symbol,ROW_ID\n" + "x," * 500 + "C,2\n")
    (tmp_path / "c.json").write_text('\n{"row_id": 3, "symbol": "D"}\n{broken\n')
    (tmp_path / "d.json").write_text('[{"row_id": 4, "symbol": "E"},\n {"row_id": 5}]')
    (tmp_path / "e.json").write_text('{\n"row_id": 6,\n"symbol": "F"}')
    (tmp_path / "f.json").write_text("[{")
    (tmp_path / "g.csv").write_text("")
    got = readers.sniff_bulk(spark, str(tmp_path), "row_id long, symbol string").collect()
    assert {(r["row_id"], r["symbol"]) for r in got if not r["bad"]} == {(1, "A, Inc"), (2, "C"), (3, "D"), (4, "E"), (5, None), (6, "F")}
    assert sorted(r["bad"][-9:] for r in got if r["bad"]) == sorted(["y,y,one,B", "{broken", "[{"])


def test_bulk_arrays_on_one_line_do_not_widen_the_cells(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text("[" + ",".join(f'{{"row_id": {i}, "symbol": "S{i}"}}' for i in range(300)) + "]")
    (tmp_path / "b.csv").write_text("row_id,symbol,note\n300,S300,x\n")
    rows = readers.sniff_bulk(spark, str(tmp_path), "row_id long, symbol string")
    assert {(r["row_id"], r["symbol"], r["bad"]) for r in rows.collect()} == {(i, f"S{i}", None) for i in range(301)}
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    rows.explain(True)
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    plan = capsys.readouterr().out
    assert "StructField(c2," in plan and "StructField(c3," not in plan


def test_filings_are_written_in_bounded_files(spark, tmp_path):
    """A reader takes an XML file whole, so files may not grow with what one task writes."""
    from factorloom.sources import writers

    tx = F.array(F.struct(F.lit("P").alias("code"), F.col("id").cast("double").alias("shares"), F.lit(2.0).alias("price"), F.lit("2001-01-01").alias("day")))
    rows = spark.range(0, 95, 1, 1).select(
        F.col("id").cast("string").alias("issuer"), F.lit("2001-01-02").alias("filed"), F.struct(F.lit("1").alias("id"), F.lit("CEO").alias("title")).alias("owner"), tx.alias("tx"))
    path = str(tmp_path / "filings")
    writers.write_filings_xml(rows, path, 10)
    assert max(r["count"] for r in spark.read.text(path).where("value LIKE '%<filing>%'").groupBy(F.col("_metadata.file_path")).count().collect()) == 10
    back = readers.read_filings_xml(spark, path)
    assert sorted((int(r["issuer"]), r["value"]) for r in back.collect()) == [(i, 2.0 * i) for i in range(95)]


def test_missing_dump_is_empty(spark):
    assert readers.read_tolerant(spark, new_path(spark, "nowhere"), "a long").count() == 0


RUNS = [(1, 1, False), (1, 2, False), (1, 3, False), (1, 4, True), (1, 5, False), (2, 1, True), (2, 2, False), (2, 3, False), (None, 1, False)]
STREAKS = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 0), (1, 5, 1), (2, 1, 0), (2, 2, 1), (2, 3, 2), (None, 1, 1)]


def test_streaks_of_runs(spark):
    got = jobs.failure_streaks(spark.createDataFrame(RUNS, "k long, run int, ok boolean"), "k", "run", "ok").collect()
    assert {(r["k"], r["run"], r["streak"], r["escalate"]) for r in got} == {(*x, x[2] >= 3) for x in STREAKS}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_state_does_not_depend_on_the_order_of_deliveries(spark, order):
    """Streaks of runs from a feed whose files come in any order, against the batch answer."""
    path, at = new_path(spark, "feed-test"), dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(k, at + dt.timedelta(hours=run), run, ok) for k, run, ok in RUNS], "k long, ts timestamp, run long, ok boolean")
    deliver = lambda i: lambda: rows.where(F.col("run") % 3 == i).write.mode("append").parquet(path)
    end = lambda: ordered.heartbeat(rows, "ts", "20 DAYS").write.mode("append").parquet(path)

    def fold(key, state, row):
        _, run, ok = row
        streak = 0 if ok else (state[0] if state else 0) + 1
        return (streak,), [(key[0], run, streak)]

    got = ordered.in_order(lambda: jobs.file_stream(spark, path, rows.schema), "k", "ts", "run", ["ok"], "10 days", "streak long", "k long, run long, streak long", fold, "order-test", [*map(deliver, order), end])
    assert {tuple(r) for r in got.collect()} == set(STREAKS)


def test_rows_beyond_the_lateness_stop_the_run(spark):
    path, at = new_path(spark, "late-test"), dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, at + dt.timedelta(days=d), d) for d in (0, 9, 10)], "k long, ts timestamp, n long")
    deliver = lambda d: lambda: rows.where(F.col("n") == d).write.mode("append").parquet(path)
    with pytest.raises(RuntimeError, match="lateness"):
        ordered.in_order(lambda: jobs.file_stream(spark, path, rows.schema), "k", "ts", "n", [], "2 days", "n long", "k long", lambda k, s, r: ((r[1],), []), "late-test", map(deliver, (9, 10, 0)))


def test_periods_run_in_order_and_log_changed_keys_only(spark):
    path = new_path(spark, "period-test")
    rows = spark.createDataFrame([(p, k) for p, ks in ((1, "ab"), (2, "bc"), (3, "b"), (4, "ab")) for k in ks], "p long, k string")
    deliver = lambda *ps: lambda: rows.where(F.col("p").isin(*ps)).write.mode("append").parquet(path)
    state, out = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())]), T.StructType([T.StructField("p", T.LongType()), T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    logged = []

    def step(batch, before):
        after = batch.join(before, "k", "left").select("p", "k", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
        logged.append(ordered._log(before, after, state, ["k"]).count())
        return after.select("k", "n"), after

    run = lambda *feed: ordered.in_periods(lambda: jobs.file_stream(spark, path, rows.schema), rows.schema, F.col("p"), 1, state, ["k"], out, "period-test", step, feed)
    got = run(deliver(2), deliver(1, 3), deliver(4))
    # a counts one in a row, b four, c one; a key that is not in a period has no state any more
    assert {tuple(r) for r in got.collect()} == {(1, "a", 1), (1, "b", 1), (2, "b", 2), (2, "c", 1), (3, "b", 3), (4, "a", 1), (4, "b", 4)}
    assert logged == [2, 3, 2, 2]
    path = new_path(spark, "period-test")
    with pytest.raises(Exception, match="after it was closed"):
        run(deliver(2), deliver(4), deliver(1))


def test_streams_count_every_row_of_a_table_of_files(spark, tmp_path):
    """Four files out of time order, all in one batch and one file a batch; a lone file too."""
    from factorloom.streaming import jobs
    from factorloom.views import SCHEMAS

    events = spark.read.schema(SCHEMAS["events"]).parquet("/root/testdata/sf0.001/events.parquet")
    folder, lone = str(tmp_path / "events.parquet"), str(tmp_path / "one")
    events.withColumn("p", F.pmod(F.xxhash64("event_id"), F.lit(4))).repartition(4, "p").drop("p").write.parquet(folder)
    events.coalesce(1).write.parquet(lone)
    file = next(str(p) for p in (tmp_path / "one").iterdir() if p.name.startswith("part-"))
    days = events.select("user_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_trunc("day", "ts") - i * F.expr("INTERVAL 1 DAY"))).alias("start"))
    want = {tuple(r) for r in days.groupBy("start", "user_id").count().collect()}
    for path, files in ((folder, None), (folder, 1), (file, None)):
        got = jobs.windowed_counts(jobs.file_stream(spark, path, SCHEMAS["events"], files), "user_id", "ts", 7, "1 day", "stream-test")
        assert {tuple(r) for r in got.collect()} == want
        assert jobs.route(jobs.file_stream(spark, path, SCHEMAS["events"], files), "event_type", "route-test").count() == events.count()


def test_bulk_files_are_read_by_what_they_are(spark, tmp_path):
    from factorloom.sources import readers

    files = {
        "a.json": '[{"row_id": 1, "symbol": "A", "price": 1.5}, {"row_id": 2, "symbol": "B"}, {"price": 3, "row_id": 3}]',
        "b.json": '\n[\n {\n  "row_id": 4,\n  "symbol": "D"\n }\n]\n',
        "c.json": '{"row_id": 5, "symbol": "E"}\n{broken\n\n{"row_id": 6}\n',
        "d.csv": 'price,"Symbol",extra,row_id\n1.5,"F, G",x,7\n,"H",y,8\n',
        "e.csv": "row_id,symbol\n9,I\nnine,J\n",
        "f.json": "[{broken",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    rows = readers.sniff_bulk(spark, str(tmp_path), "row_id long, symbol string, price double").collect()
    good = {(r["row_id"], r["symbol"], r["price"]) for r in rows if r["bad"] is None}
    assert good == {(1, "A", 1.5), (2, "B", None), (3, None, 3.0), (4, "D", None), (5, "E", None), (6, None, None), (7, "F, G", 1.5), (8, "H", None), (9, "I", None)}
    assert len([r for r in rows if r["bad"] is not None]) == 3


def test_region_rows_are_joined_once(spark):
    """Three figures of a report read them."""
    from factorloom.plans import load_all
    from factorloom.plans.aggregates import region_rows
    from factorloom.views import Tables

    load_all()
    rows = region_rows(Tables(spark, "/root/testdata/sf0.001"))
    assert rows.columns == ["ticker", "market", "s", "coverage", "low_coverage", "pid", "fwd"] and rows.count() > 0
    assert "Join" not in rows._jdf.queryExecution().analyzed().toString()


def test_stored_views_follow_their_tables_and_can_be_dropped(spark, tmp_path):
    from factorloom import session, views

    source = "/root/testdata/sf0.001"
    for name in ("supplier", "lineitem"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    before = views.Tables(spark, str(tmp_path)).stored("suppliers", lambda: spark.read.parquet(str(tmp_path / "supplier.parquet"))).count()
    spark.read.parquet(f"{source}/supplier.parquet").write.mode("append").parquet(str(tmp_path / "supplier.parquet"))
    assert views.Tables(spark, str(tmp_path)).stored("suppliers", lambda: spark.read.parquet(str(tmp_path / "supplier.parquet"))).count() == 2 * before
    kept, session._WRITTEN[spark.sparkContext.applicationId] = session._WRITTEN[spark.sparkContext.applicationId], []
    path = session.new_path(spark, "short-lived")
    spark.range(3).write.parquet(path)
    assert session.drop_tables.__doc__ and len(session._WRITTEN[spark.sparkContext.applicationId]) == 1
    fs, where = session._files(spark, path)
    assert fs.exists(where)
    for p in session._WRITTEN[spark.sparkContext.applicationId]:
        fs.delete(session._files(spark, p)[1], True)
    session._WRITTEN[spark.sparkContext.applicationId] = kept
    assert not fs.exists(where)
