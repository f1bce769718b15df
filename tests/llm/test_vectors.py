"""Operators on embedding vectors against brute force: nearest neighbours, hard negatives, whitening."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import negatives, vptree, whiten

NAN, INF = float("nan"), float("inf")


def clouds(rng, n, d, centres=6, spread=0.05):
    c = rng.standard_normal((centres, d))
    return c[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, d))


def recall(points, queries, k, factor):
    order, nodes, halves = vptree.grow(points, 16)
    found, best, read = vptree.search(points[order], nodes, halves, queries, k, factor)
    exact = np.sort(((queries[:, None] - points[None]) ** 2).sum(2), axis=1)[:, :k]
    got = np.sort(((queries[:, None] - points[order][found]) ** 2).sum(2), axis=1)
    return (got <= exact + 1e-9).mean(), read.mean(), (nodes[:, 3] < 0).sum(), np.sqrt(got[:, -1]), np.sqrt(exact[:, -1])


def test_trees_are_exact_at_factor_one_and_near_beyond():
    rng = np.random.default_rng(1)
    for points in (rng.standard_normal((900, 12)), clouds(rng, 900, 12), clouds(rng, 700, 3, 2, 0.0), np.repeat(rng.standard_normal((1, 8)), 300, 0)):
        u = vptree.unit(points)
        q = u[::7]
        assert recall(u, q, 6, 1.0)[0] == 1
        share, read, leaves, got, exact = recall(u, q, 6, vptree.FACTOR)
        assert share >= 0.9 and np.all(got <= vptree.FACTOR * exact + 1e-6)
    # where there is structure, whole subtrees are skipped
    u = vptree.unit(clouds(rng, 4000, 16, 40, 0.02))
    share, read, leaves, *_ = recall(u, u[::50], 6, 1.0)
    assert share == 1 and read < leaves / 3


def test_scores_do_not_depend_on_place_or_size():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((1, 40)), rng.standard_normal((9, 40))
    s = vptree.cosines(vptree.halved(a), vptree.halved(b))
    for i in range(9):
        assert vptree.cosines(vptree.halved(a), vptree.halved(b[i : i + 1] * 2.0**600))[0] == s[i]
    assert np.allclose(vptree.unit(np.array([[1e300, 1e300], [1e-300, 0]])), [[0.5**0.5, 0.5**0.5], [1, 0]])


def plain_neighbours(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = [x + 0.0 for x in v]
            good[i] = min(good.get(i, v), v)
    d = max(map(len, good.values()), default=0)
    vs = {i: np.array(v + [0.0] * (d - len(v))) for i, v in good.items()}
    out = []
    for q in vs:
        if q % 50 == 0:
            ranked = sorted((-float(vptree.cosines(vs[q][None], vs[i][None])[0]), i) for i in vs if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    return sorted(out)


def vector_rows():
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(-30, 170)]
    # a third of all rows share a vector, others are ties, ragged, or out
    rows += [(i, [1.0, 2.0, 0.0, -0.0, 1.0, 0.5]) for i in range(200, 320)]
    rows += [(400, [1.0]), (401, [2.0, 0.0]), (450, [3.0, 0.0, 0.0]), (500, None), (550, []), (600, [0.0] * 6), (650, [1.0, NAN] + [0.0] * 4), (651, [INF] * 6), (652, [1.0, None] + [1.0] * 4)]
    rows += [(700, [1.0] * 6), (700, [1.0] * 6), (750, [2.0] * 6), (750, [-1.0] * 6), (None, [1.0] * 6)]
    return rows


def test_neighbours_against_all_pairs(frame, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_BYTES", 3000)
    monkeypatch.setattr(vptree, "QUERY_BYTES", 150)
    rows = vector_rows()
    df = frame([(i, v, "x", 7) for i, v in rows], "vec_id long, e array<double>, shard string, Asked int").repartition(5)
    for factor in (1.0, vptree.FACTOR):
        got = sorted(map(tuple, vptree.neighbours(df, "vec_id", "e", F.col("vec_id") % 50 == 0, factor=factor).collect()))
        want = plain_neighbours(rows, 5)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))


def test_few_and_no_vectors(frame):
    for rows in ([], [(0, None)], [(0, [1.0])], [(0, [1.0]), (1, [-1.0])]):
        df = frame(rows, "vec_id long, e array<float>")
        got = sorted(map(tuple, vptree.neighbours(df, "vec_id", "e", F.col("vec_id") % 50 == 0).collect()))
        assert got == plain_neighbours(rows, 5)
        assert vptree.neighbours(df, "vec_id", "e", F.lit(None).cast("boolean")).count() == 0


def test_hilbert_curve_takes_unit_steps():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        keys = negatives.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert np.all(np.abs(np.diff(path, axis=0)).sum(1) == 1)
    assert negatives.hilbert_keys(np.zeros((3, 0)), 2) == [b""] * 3


def test_whole_number_products():
    rng = np.random.default_rng(3)
    for most in (300, 2**30, 2**40):
        a, b = rng.integers(-most, most, (5, 9)), rng.integers(-most, most, (4, 9))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
        assert negatives.products(a, b).tolist() == want
        least, top = negatives.reach(a, np.minimum(b[:2], b[2:]), np.maximum(b[:2], b[2:]))
        inner = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        assert all(least[i, j % 2] <= inner[i][j] <= top[i, j % 2] for i in range(5) for j in range(4))


def plain_negatives(rows):
    good = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            one = (lab, [math.floor(256 * x) for x in v])
            good[i] = min(good.get(i, one), one)
    score = lambda a, b: sum(x * y for x, y in zip(good[a][1], good[b][1]))
    out = []
    for a in good:
        if a % 100 == 0:
            ranked = sorted((-score(a, b), b) for b in good if b != a)
            for s, p in [(s, p) for s, p in ranked if good[p][0] == good[a][0]][:5]:
                inside = [(t, n) for t, n in ranked if good[n][0] != good[a][0] and 80 * -s <= 100 * -t <= 100 * -s][:5]
                out += [(a, p, r + 1, n, -s, -t) for r, (t, n) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["noise", "clouds", "one"])
def test_hard_negatives_against_all_pairs(frame, monkeypatch, kind):
    monkeypatch.setattr(negatives, "STRIPE", 60)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "GROUP", 1)
    monkeypatch.setattr(negatives, "SHEET", 1)
    rng = np.random.default_rng(5)
    m = {"noise": rng.standard_normal((420, 5)), "clouds": clouds(rng, 420, 5), "one": np.repeat(rng.standard_normal((1, 5)), 420, 0)}[kind]
    # a third of all rows share a label and a vector
    m[140:280] = m[140]
    rows = [(i * 10 - 500, [float(x) for x in v], 3 if 140 <= i < 280 else int(rng.integers(0, 4))) for i, v in enumerate(m)]
    rows += [(9000, None, 1), (9100, [1.0, NAN, 1.0, 1.0, 1.0], 1), (9200, [1.0] * 5, None), (9300, [None] * 5, 1), (None, [1.0] * 5, 1), (9400, [], 1), (9500, [1.0, 2.0], 1)]
    rows += [(9600, [1.0] * 5, 1), (9600, [1.0] * 5, 1), (9600, [2.0] * 5, 0)]
    df = frame([(*r, 1.5, "x") for r in rows], "id long, e array<double>, label int, X double, block string").repartition(4)
    got = sorted(map(tuple, negatives.hard_negatives(df, "id", "e", "label", F.col("id") % 100 == 0).collect()))
    want = plain_negatives(rows)
    assert got == want
    assert kind == "one" or len(got) > 100


def test_hard_negatives_of_few_rows(frame):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)], [(1, [1.0], 1), (2, [0.9], 2)], [(0, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]):
        df = frame(rows, "id long, e array<double>, label int")
        assert sorted(map(tuple, negatives.hard_negatives(df, "id", "e", "label", F.col("id") % 100 == 0).collect())) == plain_negatives(rows)


def test_zone_maps_leave_blocks_out():
    rng = np.random.default_rng(6)
    centres = np.array([[300, 0, 0], [0, 300, 0], [-300, 0, 0]])
    blocks = [c + rng.integers(-9, 9, (20, 3)) for c in centres]
    lo, hi = np.stack([b.min(0) for b in blocks]), np.stack([b.max(0) for b in blocks])
    a, labels = np.array([[300, 0, 0]]), [np.array([1, 2])] * 3
    window = np.array([[80 * 90000 // 100]]), np.array([[90000 + 9000]])
    assert negatives._wanted(a, np.array([1]), *window, lo, hi, labels, False).tolist() == [[True, False, False]]
    assert negatives._wanted(a, np.array([1]), *window, lo, hi, [np.array([1])] * 3, False).sum() == 0
    assert negatives._wanted(a, np.array([3]), *window, lo, hi, labels, True).sum() == 0


def symmetric():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 7, 24, 64):
        m = rng.standard_normal((n, n))
        yield m + m.T
        yield m @ m.T
        q = np.linalg.qr(m)[0]
        yield q @ np.diag(np.repeat([5.0, 2.0, 2.0, 1.0], 16)[:n]) @ q.T  # repeated eigenvalues
        yield (m[:, : n // 3] @ m[:, : n // 3].T) * 1e-6
        yield np.diag(np.arange(n) // 2 * 1.0)
        yield np.zeros((n, n))
        yield np.eye(n) + 1e-9 * (m + m.T)


def test_leading_eigenvectors_against_the_library():
    for a in symmetric():
        a = (a + a.T) / 2
        values, vectors = whiten.leading_eigen(a, 16)
        want, scale = np.linalg.eigvalsh(a)[::-1][:16], max(np.abs(a).sum(1).max(), 1e-290)
        assert np.abs(values - want).max() <= 1e-13 * scale
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-11


def plain_whitening(rows, k=16):
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = max((len(v) for _, v in good), default=0)
    xs = [[math.floor(64 * x) + 1000000 for x in v + [0.0] * (d - len(v))] for _, v in good]
    fit = sorted(set(map(tuple, xs)))
    n = len(fit)
    if n < 2:
        return n, [], []
    s = [sum(c) for c in zip(*fit)]
    y = np.array([[n * a - b for a, b in zip(x, s)] for x in fit], np.float64) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    v, e = v[:, e > 1e-9 * e[0]], e[e > 1e-9 * e[0]]
    out = [(i, sum((n * a - b) ** 2 for a, b in zip(x, s)), (np.array([n * a - b for a, b in zip(x, s)], np.float64) / n) @ v / np.sqrt(e)) for (i, _), x in zip(good, xs)]
    return n, out, e / np.trace(y.T @ y / n)


@pytest.mark.parametrize("d,extra", [(6, True), (24, False)])
def test_whitening_against_the_library(frame, d, extra):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(d)]) for i in range(150)] + [(i, [0.5] * d) for i in range(200, 290)]
    if extra:
        rows += [(300, None), (301, [NAN] * d), (302, [1.0, None]), (303, [1.0, 2.0]), (304, []), (None, [1.0] * d), (0, [2.0] * d), (0, [2.0] * d), (305, [INF] * d)]
    df = frame([(*r, "a") for r in rows], "vec_id long, e array<double>, Component string").repartition(6)
    got = whiten.whiten(df, "vec_id", "e").collect()
    n, want, share = plain_whitening(rows)
    assert len(got) == len(want) * len(share) and {r["n"] for r in got} == {n}
    assert got[0]["identity_error"] <= 1e-9 and len({r["identity_error"] for r in got}) == 1
    assert all(abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9 for r in got)
    key = lambda i, dev: (i is None, i or 0, dev)
    for c in range(1, len(share) + 1):
        a = sorted((key(r["vec_id"], r["deviation"]), r["whitened"]) for r in got if r["component"] == c)
        b = sorted((key(i, dev), w[c - 1]) for i, dev, w in want)
        assert [x[0] for x in a] == [x[0] for x in b]
        x, y = np.array([v[1] for v in a]), np.array([v[1] for v in b])
        assert min(np.abs(x - y).max(), np.abs(x + y).max()) < 1e-8


def test_whitening_without_variance(frame):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3, [(1, [])]):
        assert whiten.whiten(frame(rows, "vec_id long, e array<float>"), "vec_id", "e").collect() == []
    two = whiten.whiten(frame([(1, [0.0, 1.0]), (2, [0.0, 3.0])], "vec_id string, e array<float>"), "vec_id", "e").collect()
    assert sorted((r["vec_id"], r["component"], r["deviation"], abs(round(r["whitened"], 12))) for r in two) == [("1", 1, 128**2, 1.0), ("2", 1, 128**2, 1.0)]


def test_deviation_beyond_64_bits_is_null(frame):
    got = whiten.whiten(frame([(1, [1e16]), (2, [-1e16])], "vec_id long, e array<double>"), "vec_id", "e").collect()
    assert [r["deviation"] for r in got] == [None, None] and all(abs(abs(r["whitened"]) - 1) < 1e-9 for r in got)
