"""Best fit against a plain search, conflicts, and each stage of the pipeline against a plain version."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from factorloom.llm import packing, quality
from tests.llm.test_neardup import plain as plain_components

ITEMS = "k long, n long, s string, c string, bin int"


def plain_fit(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= n and (s < 0 or s not in b[1]) and (c < 0 or c not in b[2])]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set()])
        out.append((i, capacity - bins[i][0]))
        bins[i][0] -= n
        bins[i][1].add(s)
        bins[i][2].add(c)
    return out


def test_best_fit_matches_a_plain_search():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(0, 120)
        lengths = sorted((rng.randint(0, 30) for _ in range(n)), reverse=True)
        args = (lengths, [rng.randint(-1, 5) for _ in range(n)], [rng.randint(-1, 40) for _ in range(n)], 30)
        assert list(zip(*packing.best_fit(*args))) == plain_fit(*args)


def test_pieces_and_conflicts(frame, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 50)
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 3, 17, 40, 99, 100, 101, 250]), rng.choice(["a", "a", "b", "c", None]), rng.choice(["x", None, str(i)]), 1) for i in range(200)]
    rows += [(None, None, None, None, None), (507, 250, "a", "x", 1), (507, 250, "a", "x", 1), (508, 12, "b", "x", 1), (508, 12, "b", "x", 1)]
    out = packing.pack(frame(rows, ITEMS), "k", "n", "s", "c", 100).collect()
    lengths = Counter()
    for k, n, *_ in rows:
        lengths[k] += n or 0
    got, used, spans = Counter(), defaultdict(int), defaultdict(list)
    for r in out:
        got[r["k"]] += r["length"]
        used[r["shard"], r["bin"]] += r["length"]
        spans[r["shard"], r["bin"]].append((r["start"], r["start"] + r["length"]))
    assert got == lengths and max(used.values()) <= 100
    for s in spans.values():
        s = sorted(x for x in s if x[0] < x[1])
        assert all(a[1] <= b[0] for a, b in zip(s, s[1:]))
    about = {r[0]: r[2:4] for r in rows}
    inside = defaultdict(list)
    for r in out:
        inside[r["shard"], r["bin"]].append(r)
    for rs in inside.values():
        if not (len(rs) == 1 and rs[0]["length"] == 100):
            for i in (0, 1):
                seen = [about[r["k"]][i] for r in rs if about[r["k"]][i] is not None]
                assert len(seen) == len(set(seen))
    assert len(inside) > 4 and packing.pack(frame([], ITEMS), "k", "n", "s", "c", 100).collect() == []


def test_stages_in_order(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "language id":
            left = set(rows)
        elif name == "quality rules":
            stats = {k: dict(zip(quality.STAT_NAMES, quality.text_stats(t))) for k, t in rows.items()}
            left = {k for k, s in stats.items() if s["n_words"] >= 10 and 100 * s["n_repeat_words"] <= 20 * s["n_words"]}
        elif name == "exact dedup":
            best = {}
            for k, t in rows.items():
                key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
                best[key] = max(k, best.get(key, k))
            left = set(best.values())
        else:
            left = {k for k, _, c in plain_components(list(rows.items()), 5) if k == c}
        assert now == left, name
        rows = {k: rows[k] for k in now}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    packed = Counter()
    for r in out.collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == Counter({k: len((t or "").encode().split()) for k, t in rows.items()})


def test_stages_take_odd_tables(spark, frame):
    folder = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, _Stats string"
    odd = [(None, None, None, None, None, "x"), (1, "", "en", None, 0, None), (1, "", "en", None, 0, None), (2, "a b c d e f g h i j k", None, "s", 1, None)]
    for rows in ([], odd):
        docs = frame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            out.collect()
            docs = docs if name == "packing" else out
