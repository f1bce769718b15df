"""Ordered passes, as-of and nth-row joins along keys of any length, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factorloom.operators import scan

ROWS = "k string, at long, x long"


def rows(seed, n=400):
    """Two thirds of the rows share one key and half of those one hour; null keys and null values."""
    rng, out = random.Random(seed), []
    for i in range(n):
        k = rng.choice(["hot", "hot", "hot", "hot", "a", "b", None])
        out.append((k, i * 7919 % 1000 if k == "hot" else rng.randint(0, 99) * 1000 + i, rng.choice([None, *range(9)])))
    rng.shuffle(out)
    return out


def plain(data):
    want, last = {}, {}
    for k, at, x in sorted(data, key=lambda r: (r[0] is None, r[0] or "", r[1])):
        prev, known, total = last.get(k, (None, None, 0))
        known, total = (known if x is None else x), total + (x or 0)
        want[k, at] = (prev, known, total)
        last[k] = (x, known, total)
    return want


@pytest.mark.parametrize("part_rows", [3, 40, 10_000])
def test_previous_latest_and_total(spark, part_rows):
    data = rows(1)
    s = scan.Scan(spark.createDataFrame(data, ROWS), ["k"], ["at"], part_rows).previous("x", "prev").latest("x", "known").total("x", "total").done()
    assert {(r["k"], r["at"]): (r["prev"], r["known"], r["total"]) for r in s.collect()} == plain(data)


def test_a_hot_key_spreads_over_parts(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("at"))
    s = scan.Scan(df, ["k"], ["at"], 1000)
    parts = [r[0] for r in s.rows.groupBy(scan.PART).agg(F.count(F.when(F.col("k") == "hot", 1))).select(F.col("count(CASE WHEN (k = hot) THEN 1 END)")).collect()]
    assert len([p for p in parts if p]) >= 10 and max(parts) < 40_000 / 3 / 4
    bad = s.previous("at", "prev").done().where("k = 'hot' AND NOT (prev <=> CASE WHEN at > 0 THEN at - 3 END)")
    assert bad.count() == 0


def test_empty_tables(spark):
    s = scan.Scan(spark.createDataFrame([], ROWS), ["k"], ["at"]).previous("x", "p").latest("x", "l").total("x", "t").done()
    assert s.columns == ["k", "at", "x", "p", "l", "t"] and s.count() == 0


def test_joins_against_plain_python(spark):
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    moment = lambda: start + dt.timedelta(seconds=rng.randint(0, 300))
    facts = [(rng.choice(["a", "b", "hot", "hot", None]), moment(), i, float(i)) for i in range(200)] + [("a", None, 999, 0.0)]
    probes = [(i, rng.choice(["a", "c", "hot", "hot", None]), moment()) for i in range(150)] + [(999, "a", None)]
    left, right = spark.createDataFrame(probes, "id long, k string, at timestamp"), spark.createDataFrame(facts, "k string, ts timestamp, tie long, v double")
    want = {}
    for i, k, at in probes:
        ok = [(ts, tie, v) for fk, ts, tie, v in facts if fk == k and ts is not None and at is not None and ts <= at]
        best = max(ok) if ok else (None, None, None)
        want[i] = (best[0], best[2])
    got = scan.asof_scan(left, right, "k", "at", "ts", ["v"], "tie").collect()
    assert {r["id"]: (r["ts"], r["v"]) for r in got} == want and len(got) == len(probes)
    some, ticks = [p for p in probes if p[1] and p[2]], [f for f in facts if f[0] and f[1]]
    want = {}
    for i, k, at in some:
        after = [v for ts, tie, v in sorted((ts, tie, v) for fk, ts, tie, v in ticks if fk == k and ts >= at)]
        want |= {(i, n): (after[n] if n < len(after) else None) for n in (0, 2)}
    a, b = spark.createDataFrame(some, "id long, u string, at timestamp"), spark.createDataFrame(ticks, "u string, ts timestamp, tie long, v double")
    got = scan.nth_after(a, b, [0, 2], "u", "at", "ts", "tie", "v").collect()
    assert {(r["id"], r["k"]): r["v"] for r in got} == want and len(got) == len(want)
