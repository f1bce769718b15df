"""Distributed ranks, percentiles and orderings against NumPy on skewed values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import distribution, xs
from factorloom.operators.positions import positions


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value, the rest has a long tail; group b is constant, group c one row."""
    rng = np.random.default_rng(7)
    a = np.where(rng.random(3000) < 1 / 3, 0.0, np.exp(rng.normal(0, 6, 3000)) * rng.choice([-1, 1], 3000))
    pdf = pd.concat([
        pd.DataFrame({"k": "a", "id": range(3000), "x": a}),
        pd.DataFrame({"k": "b", "id": range(3000, 3040), "x": 2.5}),
        pd.DataFrame({"k": "c", "id": [9000], "x": [-1.0]}),
    ])
    return pdf, spark.createDataFrame(pdf)


def test_average_rank(skewed):
    pdf, df = skewed
    got = distribution.with_average_rank(df, ["k"], "x", "r").toPandas().set_index("id")["r"].sort_index()
    want = pdf.set_index("id").groupby("k")["x"].rank(method="average").sort_index()
    assert np.allclose(got, want)


@pytest.mark.parametrize("rows", [10, 400, 500_000])
def test_percentiles(skewed, monkeypatch, rows):
    monkeypatch.setattr(distribution, "CELL_ROWS", rows)
    pdf, df = skewed
    points = {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = distribution.percentiles(df, ["k"], "x", points).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for n, p in points.items():
            assert got.loc[k, n] == pytest.approx(np.percentile(g["x"], p * 100), rel=1e-9, abs=1e-12)


def test_nulls_are_left_out(spark):
    df = spark.createDataFrame([("a", None), ("a", 1.0), ("a", 3.0)], "k string, x double")
    row = distribution.percentiles(df, ["k"], "x", {"m": 0.5}).first()
    assert row["m"] == 2.0


def test_whole_table_as_one_group(skewed):
    pdf, df = skewed
    got = distribution.value_ranks(df, [], "x").toPandas().set_index("x")
    rank = pdf["x"].rank(method="min") - 1
    assert all(got.loc[x, "less"] == r for x, r in zip(pdf["x"], rank))
    assert set(got["n"]) == {len(pdf)}


def test_positions_break_ties_by_number(skewed):
    pdf, df = skewed
    got = positions(df, ["k"], "x", "id").toPandas()
    want = pdf.sort_values(["k", "x", "id"], ascending=[True, False, True])
    want["pos"] = want.groupby("k").cumcount()
    merged = got.merge(want[["id", "pos"]].astype({"id": float}), on="id")
    assert (merged["pos0"] == merged["pos"]).all()


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 400), "x": rng.integers(0, 20, 400).astype(float)})
    pdf["y"] = pdf["x"] + rng.normal(0, 8, 400)
    got = xs.spearman(spark.createDataFrame(pdf), ["k"], "x", "y").toPandas().set_index("k")["rho"]
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(g["x"].rank().corr(g["y"].rank()))


def test_spearman_of_small_groups_moves_the_pairs_once(spark):
    """Ties, null keys, missing values, both signs of zero: the same by windows and by cells, and the windows take one shuffle of the pairs."""
    rng = np.random.default_rng(4)
    rows = [(k, f, x, y) for k in ("a", "b", None) for f in (1, 2) for x, y in zip(rng.choice([None, -0.0, 0.0, 1.0, 2.5, float("nan")], 60).tolist(), rng.normal(0, 1, 60).tolist())]
    df = spark.createDataFrame([(k, f, x, None if i % 7 == 0 else y) for i, (k, f, x, y) in enumerate(rows)], "k string, f int, x double, y double")
    small, large = xs.spearman(df, ["k", "f"], "x", "y"), xs.spearman(df, ["k", "f"], "x", "y", group_rows=1)
    by = lambda d: {(r["k"], r["f"]): (r["n"], r["rho"]) for r in d.collect()}
    assert by(small).keys() == by(large).keys() and len(by(small)) == 6
    for key, (n, rho) in by(large).items():
        assert by(small)[key] == (n, pytest.approx(rho))
    plan = small._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_spearman_constant_side_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, float(i)) for i in range(6)], "k string, x double, y double")
    assert xs.spearman(df, ["k"], "x", "y").first()["rho"] is None


def test_broadcast_only_below_the_bound(spark):
    df = spark.range(100).select(F.col("id").alias("k"))
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    small = distribution.attach(df, stats, ["k"])
    large = distribution.attach(df, stats, ["k"], small_bytes=10)
    hinted = lambda d: "ResolvedHint (strategy=broadcast)" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(small) and not hinted(large)
    assert small.count() == large.count() == 100


def test_one_outlier_does_not_fill_a_cell(spark):
    rng = np.random.default_rng(3)
    x = np.append(1000 + rng.random(200_000) / 100, 1e9)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x}))
    got = distribution.value_ranks(df, ["k"], "x", cell_rows=5000)
    spread = got.sparkSession.read.parquet(got.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_cell").count().toPandas()["count"]
    assert len(spread) >= 30 and spread.max() <= 3 * spread.mean()
    out = got.orderBy("x").toPandas()
    assert (out["less"].to_numpy() == np.arange(len(x))).all()


def test_null_keys_and_long_ids_stay(spark):
    big = 2**60
    rows = [("a", big + 1, 1.0), ("a", big, 1.0), (None, big + 3, 2.0), (None, big + 2, 2.0), (None, big + 4, None)]
    df = spark.createDataFrame(rows, "k string, id long, x double")
    got = {(r["k"], r["id"]): (r["pos0"], r["n"], r["x"]) for r in positions(df, ["k"], "x", "id").collect()}
    assert got == {("a", big): (0, 2, 1.0), ("a", big + 1): (1, 2, 1.0), (None, big + 2): (0, 3, 2.0), (None, big + 3): (1, 3, 2.0), (None, big + 4): (2, 3, None)}
    ranked = {r["id"]: r["r"] for r in distribution.with_average_rank(df, ["k"], "x", "r").collect()}
    assert ranked == {big: 1.5, big + 1: 1.5, big + 2: 1.5, big + 3: 1.5, big + 4: None}
    bounded = xs.winsorise(df.withColumn("x", F.col("x") * 1.0), ["k"], "x", 0.0, 1.0, "w").where("k IS NULL AND x IS NOT NULL")
    assert {r["w"] for r in bounded.collect()} == {2.0}
