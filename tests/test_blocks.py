"""Blocked covariance, phrase automaton, merged bucket moments, and grouping sets against plain computations."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.functions import text
from factorloom.operators import distribution, research, xs


def plain_shrinkage(x):
    """x: observations by names, centred."""
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    beta = (((x**2).T @ (x**2)).sum() / n - (s**2).sum()) / (p * n)
    delta = ((s**2).sum() - 2 * mu * np.trace(s) + p * mu * mu) / p
    shrink = min(beta, delta) / delta if delta else 0.0
    return (1 - shrink) * s + shrink * mu * np.eye(p)


@pytest.mark.parametrize("names,obs", [(1, 3), (7, 300), (500, 40)])
def test_shrunk_covariance_of_any_number_of_names(spark, names, obs):
    x = np.random.default_rng(names).standard_normal((obs, names)) * np.linspace(0.5, 2, names)
    x -= x.mean(0)
    rows = spark.createDataFrame([("p", int(j), int(i), float(x[i, j])) for i in range(obs) for j in range(names)], "pool string, slot int, obs int, r double")
    got = np.zeros((names, names))
    for r in research.shrunk_covariance(rows).collect():
        got[r["i"], r["j"]] = r["cov"]
    assert np.abs(got - plain_shrinkage(x)).max() < 1e-10


def test_blocks_of_products(spark):
    rng = random.Random(1)
    rows = [(p, s, o, float(rng.randint(-5, 5))) for p in ("a", "b", None) for s in range(9) for o in range(50) if rng.random() < 0.8]
    want = {}
    for p, s, o, v in rows:
        for q, t, u, w in rows:
            if p == q and o == u and s <= t:
                want[p, s, t] = want.get((p, s, t), 0) + v * w
    got = research.gram(spark.createDataFrame(rows, "pool string, slot int, obs int, r double"), "pool", "slot", "obs", "r", 16, 4).collect()
    assert {(r["pool"], r["i"], r["j"]): r["xy"] for r in got} == want


def test_phrases_in_one_pass(spark):
    rng, classes = random.Random(2), {"up": text.RAISE_PHRASES, "down": text.LOWER_PHRASES, "keep": (*text.MAINTAIN_PHRASES, "reaffirm", "a+b (c)")}
    words = [*{w for ps in classes.values() for p in ps for w in p.split()}, "x", "", "a+b"]
    texts = [" ".join(rng.choice([rng.choice(words), rng.choice(rng.choice(list(classes.values())))]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", None, "reaffirming guidancereaffirm", "on track ton track to on track to", "on track to"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["n"] for r in df.select("id", text.phrase_counts("t", **classes).alias("n")).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else tuple(sum(len(re.findall(re.escape(p), t)) for p in ps) for ps in classes.values())
        assert tuple(got[i]) == (want or (None, None, None))
    twice = spark.createDataFrame([("abababab",), ("ab",), ("abab",), ("xaba",)], "t string").select("t", text.phrase_counts("t", up=("abab", "ab")).alias("n")).collect()
    assert {r["t"]: r["n"]["up"] for r in twice} == {"abababab": 6, "ab": 1, "abab": 3, "xaba": 1}
    with pytest.raises(ValueError):
        text.phrase_counts("t", up=("",))


def test_wide_buckets_are_merged_from_narrow_ones(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("fg"), rng.choice(["US", "EU"]), rng.choice([*"abcdefgh", None]), rng.choice(["l", "s"]), rng.choice([None, 0.0, rng.random(), rng.random(), 0.25])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, factor string, market string, sector string, cap_tier string, score double")
    got = {r["id"]: r for r in xs.neutralise(df).collect()}
    narrow, wide = {}, {}
    for i, f, m, s, c, x in rows:
        if x:
            narrow.setdefault((f, m, s, c), []).append(x)
    for (f, m, s, c), v in narrow.items():
        if len(v) < xs.MIN_BUCKET:
            wide.setdefault((f, m, c), []).extend(v)
    squash = lambda x, v: 0.5 if np.std(v) <= 1e-9 else 1 / (1 + np.exp(-(x - np.mean(v)) / np.std(v)))
    seen = set()
    for i, f, m, s, c, x in rows:
        v, u = narrow.get((f, m, s, c), []), wide.get((f, m, c), [])
        if x is None:
            want = (None, "none")
        elif x == 0:
            want = (0.0, "zero")
        elif len(v) >= 5:
            want = (squash(x, v), "sector_cap_tier")
        elif len(u) >= 5:
            want = (squash(x, u), "cap_tier")
        else:
            want = (x, "raw")
        seen.add(want[1])
        assert got[i]["level"] == want[1] and (want[0] is None) == (got[i]["neutral"] is None)
        if want[0] is not None and want[1] in ("sector_cap_tier", "cap_tier"):
            assert abs(got[i]["neutral"] - min(0.99, max(0.01, want[0]))) < 1e-9
    assert {"none", "zero", "sector_cap_tier", "cap_tier"} <= seen
    with pytest.raises(ValueError):
        xs.neutralise(df, primary=("market", "sector"), fallback=("cap_tier",))


def test_grouping_sets_give_each_grouping(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["A", "B", None]), rng.choice(["x", "y"]), rng.choice([1, 3]), rng.choice([None, round(rng.uniform(-1, 1), 2)]), rng.choice([None, 0.5, -0.25])) for _ in range(300)]
    df = spark.createDataFrame(rows, "badge string, era string, horizon int, ret double, alpha double")
    both = research.horizon_stats_by(df, ["badge", "era"]).collect()
    for kind in ("badge", "era"):
        one = {(r[kind], r["horizon"]): r for r in research.horizon_stats(df.where(F.col(kind).isNotNull()), [kind, "horizon"]).collect()}
        mine = {(r["label"], r["horizon"]): r for r in both if r["kind"] == kind and r["label"] is not None}
        assert one.keys() == mine.keys()
        for k, r in one.items():
            assert all(abs(r[x] - mine[k][x]) < 1e-12 for x in ("n", "win_rate", "avg_return", "worst_return", "profit_factor", "avg_alpha", "median_return"))
    assert sum(r["n"] for r in both if r["kind"] == "badge") == sum(r["n"] for r in both if r["kind"] == "era") == sum(r[3] is not None for r in rows)


@pytest.mark.parametrize("cell_rows", [7, 10_000])
def test_ranks_in_one_cell_or_many(spark, cell_rows):
    rows = [(k, float(x)) for k in ("a", None) for x in (3, 1, 2, 2, 5, 9, 9, 9, 4)]
    got = distribution.value_ranks(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", cell_rows).collect()
    assert {(r["k"], r["x"], r["cnt"], r["less"], r["n"]) for r in got} == {(k, float(x), c, b, 9) for k in ("a", None) for x, c, b in ((1, 1, 0), (2, 2, 1), (3, 1, 3), (4, 1, 4), (5, 1, 5), (9, 3, 6))}
