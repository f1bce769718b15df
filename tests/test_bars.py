"""Wilder folds, look-ahead safety and as-of joins on small fixtures, against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import joins, research, ts


def months(n):
    return [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(11)
    series = {}
    for sid in (1, 2, 3):
        close = 100 + np.cumsum(rng.normal(0, 2, 60)) if sid < 3 else np.full(60, 50.0)
        spread = np.abs(rng.normal(1, 0.3, 60)) if sid < 3 else np.zeros(60)
        series[sid] = (close + spread, close - spread, close)
    rows = [(sid, d, float(c[i]), float(h[i]), float(l[i]), 100 + i) for sid, (h, l, c) in series.items() for i, d in enumerate(months(60))]
    return series, spark.createDataFrame(rows, "sid long, d date, close double, high double, low double, volume long")


def smooth(values, p):
    """Wilder running sums, written as a running list."""
    out = [float(np.sum(values[:p]))]
    for v in values[p:]:
        out.append(out[-1] * (1 - 1 / p) + v)
    return np.array(out)


def loop_adx(h, l, c, p):
    up, down = np.diff(h), -np.diff(l)
    plus, minus = np.where((up > down) & (up > 0), up, 0), np.where((down > up) & (down > 0), down, 0)
    tr = np.maximum.reduce([h[1:] - l[1:], np.abs(h[1:] - c[:-1]), np.abs(l[1:] - c[:-1])])
    t, a, b = smooth(tr, p), smooth(plus, p), smooth(minus, p)
    with np.errstate(all="ignore"):
        dx = np.where((t > 0) & (a + b > 0), 100 * np.abs(a - b) / (a + b), 0.0)
    return smooth(dx, p)[-1] / p if len(dx) >= p else None


def loop_rsi(c, p):
    x = np.diff(c)
    g, s = smooth(np.maximum(x, 0), p)[-1], smooth(np.maximum(-x, 0), p)[-1]
    return 50.0 if g == s == 0 else 100 - 100 / (1 + g / s)


def test_adx_matches_loop(walk):
    series, bars = walk
    got = {r["sid"]: r["adx"] for r in ts.adx(bars, 14).collect()}
    for sid, (h, l, c) in series.items():
        assert got[sid] == pytest.approx(loop_adx(h, l, c, 14), abs=1e-9)


def test_rsi_matches_loop(walk):
    series, bars = walk
    got = {r["sid"]: r["rsi"] for r in ts.rsi(bars, 14).collect()}
    for sid, (_, _, c) in series.items():
        assert got[sid] == pytest.approx(loop_rsi(c, 14), abs=1e-9)


def test_windowed_technicals_use_only_the_window(walk):
    series, bars = walk
    rows = {(r["sid"], r["d"]): r for r in ts.windowed_technicals(bars, 36, 6).collect()}
    days = months(60)
    for sid in (1, 2):
        h, l, c = (x[20:56] for x in series[sid])
        r = rows[(sid, days[55])]
        assert r["rsi_score"] == pytest.approx(0.5 + (50 - loop_rsi(c, 6)) / 100, abs=1e-9)
        assert r["adx_score"] == pytest.approx(min(50, loop_adx(h, l, c, 6)) / 50, abs=1e-9)


def test_short_history_has_no_technicals(spark, walk):
    _, bars = walk
    short = bars.where(F.col("d") < dt.date(2001, 1, 1))
    assert ts.rsi(short, 14).count() == 0
    assert {r["adx"] for r in ts.adx(short, 14).collect()} == {None}


def test_flat_volume_window_reads_zero(spark):
    rows = [(1, d, 10.0, 100 if i < 20 else 500) for i, d in enumerate(months(21))]
    z = ts.volume_zscore(spark.createDataFrame(rows, "sid long, d date, close double, volume long"), 20).orderBy("d").collect()
    assert z[19]["volume_z"] is None and z[20]["volume_z"] == 0.0


def test_asof_never_looks_ahead(spark):
    left = spark.createDataFrame([(1, dt.date(2020, 1, 10)), (1, dt.date(2020, 1, 20)), (1, dt.date(2020, 2, 1)), (2, dt.date(2020, 1, 1)), (1, dt.date(2020, 1, 10))], "k long, day date")
    right = spark.createDataFrame([(1, dt.date(2020, 1, 10), 1.0), (1, dt.date(2020, 1, 25), 2.0), (3, dt.date(2019, 1, 1), 9.0)], "k long, filed date, v double")
    got = sorted((r["k"], str(r["day"]), r["v"]) for r in joins.asof_join(left, right, "k", "day", "filed", "v").collect())
    assert [g for g in got if g[0] == 1] == [(1, "2020-01-10", 1.0), (1, "2020-01-10", 1.0), (1, "2020-01-20", 1.0), (1, "2020-02-01", 2.0)]
    assert (2, "2020-01-01", None) in got


def test_rows_are_spread_before_they_are_multiplied(spark):
    """A scan of one task: what each task makes stays bounded, and grows in tasks with the rows."""
    for rows, tasks in ((400, 16), (1600, 63)):
        some = joins.spread(spark.range(0, rows, 1, 1), 39, 1000)
        made = some.select(F.explode(F.sequence(F.lit(1), F.lit(39)))).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(made) == tasks and sum(r["count"] for r in made) == 39 * rows and max(r["count"] for r in made) <= 1100


def test_the_filing_grid_is_not_made_by_one_task(spark, tmp_path):
    from __spark_entry__ import queries
    from factorloom.views import SCHEMAS

    for name in ("customer", "orders"):
        spark.createDataFrame([], SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    plan = queries()["J06_asof_filing"](spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Repartition ") == plan.count("Generate explode") == 2


def test_nth_bar_after_the_last_is_missing(spark, walk):
    _, bars = walk
    sig = spark.createDataFrame([(1, dt.date(2004, 10, 15)), (1, dt.date(2005, 1, 1))], "sid long, anchor date")
    got = {(r["anchor"], r["k"]): r["price"] for r in joins.offset_prices(sig, bars, [0, 1, 2]).collect()}
    series, _ = walk
    assert got[(dt.date(2004, 10, 15), 0)] == pytest.approx(series[1][2][58])
    assert got[(dt.date(2004, 10, 15), 1)] == pytest.approx(series[1][2][59])
    assert got[(dt.date(2004, 10, 15), 2)] is None
    assert got[(dt.date(2005, 1, 1), 0)] is None


def test_effective_breadth_is_greedy(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=x) for x in (0, 10, 20, 22, 41, 43, 100)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert df.agg(research.effective_breadth(F.collect_set("d"), 21).alias("n")).first()["n"] == 4


def test_perfect_rank_gives_unit_ic(spark):
    rows = [(dt.date(2020, m, 1), "f", float(i), float(i) * (1 if m < 3 else -1)) for m in (1, 2, 3) for i in range(10)] + [(dt.date(2020, 1, 1), "f", None, 5.0)]
    ic = research.snapshot_ic(spark.createDataFrame(rows, "d date, factor string, score double, fwd double")).collect()
    assert sorted(round(r["ic"], 9) for r in ic) == [-1.0, 1.0, 1.0]


def test_covariance_matches_numpy(spark, walk):
    series, bars = walk
    pool = spark.createDataFrame([(1, "p", 1), (2, "p", 2)], "sid long, pool string, slot int")
    got = {(r["i"], r["j"]): r["cov"] for r in research.shrunk_covariance(research.two_bar_returns(bars, pool)).collect()}
    x = np.array([[np.log(series[s][2][k + 2] / series[s][2][k] + 1e-10) for k in range(0, 58, 2)] for s in (1, 2)])
    x = (x - x.mean(axis=1, keepdims=True)).T
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(delta, ((np.square(x).T @ np.square(x)).sum() / n - (s ** 2).sum()) / (n * p))
    want = (1 - beta / delta) * s + beta / delta * mu * np.eye(p)
    for i in (1, 2):
        for j in (1, 2):
            assert got[(i, j)] == pytest.approx(want[i - 1, j - 1], rel=1e-6)
