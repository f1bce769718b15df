"""Null, zero, constant and small-bucket rules of the cross-sectional operators."""

import math

import pytest

from factorloom.operators import composite, xs


def long_rows(spark, rows):
    """rows: (ticker, sector, tier, score), all in one market and factor."""
    data = [(t, "USA", s, c, "f", x) for t, s, c, x in rows]
    return spark.createDataFrame(data, "ticker string, market string, sector string, cap_tier string, factor string, score double")


def neutral(spark, rows, **kw):
    out = xs.neutralise(long_rows(spark, rows), **kw).collect()
    return {r["ticker"]: (r["neutral"], r["level"]) for r in out}


def test_five_rows_use_the_narrow_bucket(spark):
    got = neutral(spark, [(str(i), "A", "large", 0.1 * i) for i in range(1, 6)])
    assert {v[1] for v in got.values()} == {"sector_cap_tier"}
    z = (0.5 - 0.3) / math.sqrt(0.02)
    assert got["5"][0] == pytest.approx(1 / (1 + math.exp(-z)))
    assert got["3"][0] == pytest.approx(0.5)


def test_four_rows_fall_back_to_the_tier(spark):
    rows = [(f"a{i}", "A", "large", 0.1 * i) for i in range(1, 5)] + [("b", "B", "large", 0.9)]
    got = neutral(spark, rows)
    assert {v[1] for v in got.values()} == {"cap_tier"}


def test_fallback_statistics_leave_out_handled_rows(spark):
    rows = [(f"a{i}", "A", "large", 0.9 + 0.001 * i) for i in range(5)] + [(f"b{i}", "B", "large", 0.1 * i) for i in range(1, 5)] + [("c", "C", "large", 0.5)]
    got = neutral(spark, rows)
    assert got["a0"][1] == "sector_cap_tier" and got["b1"][1] == "cap_tier"
    xs_ = [0.1, 0.2, 0.3, 0.4, 0.5]
    mean = sum(xs_) / 5
    sd = math.sqrt(sum((x - mean) ** 2 for x in xs_) / 5)
    assert got["c"][0] == pytest.approx(1 / (1 + math.exp(-(0.5 - mean) / sd)))


def test_too_small_everywhere_keeps_the_raw_score(spark):
    assert neutral(spark, [("x", "A", "large", 0.42)]) == {"x": (0.42, "raw")}


def test_zero_is_dead_null_stays_null(spark):
    rows = [(str(i), "A", "large", 0.1 * i) for i in range(1, 6)] + [("z", "A", "large", 0.0), ("n", "A", "large", None)]
    got = neutral(spark, rows)
    assert got["z"] == (0.0, "zero") and got["n"] == (None, "none")


def test_signed_zero_is_a_real_observation(spark):
    from pyspark.sql import functions as F

    rows = [(str(i), "A", "large", 0.1 * i) for i in range(0, 5)]
    got = neutral(spark, rows, zero_is_dead=F.lit(False))
    assert got["0"][1] == "sector_cap_tier" and 0.0 < got["0"][0] < 0.5


def test_constant_bucket_with_float_noise_is_half(spark):
    rows = [(str(i), "A", "large", 0.3 + i * 1e-13) for i in range(6)]
    assert {v[0] for v in neutral(spark, rows).values()} == {0.5}


def test_outliers_are_clipped(spark):
    rows = [(str(i), "A", "large", 0.5 + 1e-6 * i) for i in range(200)] + [("hi", "A", "large", 100.0)]
    assert neutral(spark, rows)["hi"][0] == 0.99


def norm(spark, scores):
    df = spark.createDataFrame([(str(i), "f", x) for i, x in enumerate(scores)], "ticker string, factor string, score double")
    return {r["ticker"]: r["norm"] for r in xs.normalise_factors(df, ["factor"]).collect()}


def test_factor_normalisation_branches(spark):
    assert set(norm(spark, [0.0, 0.0, None]).values()) == {0.0}
    assert norm(spark, [0.7]) == {"0": 0.5}
    assert set(norm(spark, [0.4, 0.4, 0.4]).values()) == {0.5}
    mostly_zero = norm(spark, [0.0] * 19 + [0.2])
    assert mostly_zero["19"] == 1.0 and mostly_zero["0"] == 0.0


def test_weight_of_missing_factor_moves_to_the_rest(spark):
    rows = [("x", "a", 1.0, 0.5), ("x", "b", None, 0.3), ("x", "c", 0.0, 0.2), ("y", "a", None, 0.5), ("y", "b", None, 0.3), ("y", "c", None, 0.2)]
    df = spark.createDataFrame(rows, "ticker string, factor string, score double, weight double")
    got = {(r["ticker"], r["factor"]): r["eff_weight"] for r in composite.renormalise_available(df).collect()}
    assert got[("x", "a")] == pytest.approx(0.5 / 0.7)
    assert got[("x", "b")] == 0.0
    assert got[("x", "c")] == pytest.approx(0.2 / 0.7)  # a zero stays in the denominator
    assert got[("y", "b")] == pytest.approx(1 / 3)


def pillar_input(spark, n=8, region="US", **fixed):
    names = ["quality_dupont", "fcf_yield", "quality_piotroski", "analyst_revision", "pead_surprise", "price_target_upside", "insider_alpha", "congress", "inst_flow_13f"]
    rows = []
    for i in range(n):
        base = {f: 0.1 + 0.1 * ((i + j) % n) for j, f in enumerate(names)}
        base.update({k: v for k, v in fixed.items() if k in names})
        rows.append((f"T{i}", "USA", region, "A", "large", fixed.get("raw", 7), *[base[f] for f in names]))
    schema = "ticker string, market string, region string, sector string, cap_tier string, quality_raw int, " + ", ".join(f"{f} double" for f in names)
    return spark.createDataFrame(rows, schema), names


def test_pillar_gate_and_missing_pillar(spark):
    full, names = pillar_input(spark)
    a = {r["ticker"]: r for r in composite.pillar_scores(full, names).collect()}
    assert all(0 <= r["final_score"] <= 1 and r["coverage"] == pytest.approx(1.0) for r in a.values())
    gated, _ = pillar_input(spark, raw=2)
    assert {r["final_score"] for r in composite.pillar_scores(gated, names).collect()} == {0.0}
    no_consensus, _ = pillar_input(spark, analyst_revision=None, pead_surprise=None, price_target_upside=None)
    b = composite.pillar_scores(no_consensus, names).collect()
    assert all(r["consensus"] is None and r["final_score"] is not None and r["coverage"] == pytest.approx(0.75) for r in b)
