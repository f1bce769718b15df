"""Near-duplicates against all pairs, components against a plain version, edge cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import graph, neardup
from factorloom.llm.common import QUERIES


def sets(rows, width):
    out = []
    for k, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def plain(rows, width):
    """(key, size, component) by all pairs that share a shingle."""
    s, parent, index = sets(rows, width), list(range(len(rows))), defaultdict(list)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(s):
        for j, both in Counter(j for g in a for j in index[g]).items():
            if 100 * both >= 80 * (len(a) + len(s[j]) - both):
                parent[find(i)] = find(j)
        for g in a:
            index[g].append(i)
    name = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        name[r] = k if name.get(r) is None else (name[r] if k is None else min(k, name[r]))
    return Counter((k, len(s[i]), name[find(i)]) for i, (k, _) in enumerate(rows))


def answer(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component"]) for r in df.collect())


def corpus(seed):
    """Base texts with chains of small edits, a passage that many share, copies, and pairs around the threshold."""
    rng, rows = random.Random(seed), []
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 300))
    passage = [word() for _ in range(60)]
    for _ in range(25):
        text = [word() for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 8)):
            rows.append(" ".join(text))
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = word()
    for _ in range(90):
        rows.append(" ".join(passage + [word() for _ in range(rng.randint(1, 60))]))
    rows += ["One two", "one TWO", "one", "", None, None, "x " * 30_000, "x " * 30_001]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,width,small,chunk", [(1, 4, 64, 2048), (2, 5, 4, 9)])
def test_components_match_all_pairs(frame, monkeypatch, seed, width, small, chunk):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "MEDIUM", 2 * small)
    monkeypatch.setattr(neardup, "SHINGLES", 3000)
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "ROUNDS", 3)
    rows = corpus(seed)
    out = neardup.near_duplicates(frame(rows, "doc_id long, text string"), "doc_id", "text", width=width)
    assert answer(out) == plain(rows, width)


def test_what_never_shrinks_is_compared_in_pieces(frame, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "MEDIUM", 1)
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    monkeypatch.setattr(neardup, "CHUNK", 7)
    monkeypatch.setattr(neardup, "BUCKET", 100)
    rows = corpus(3)
    out = neardup.near_duplicates(frame(rows, "doc_id long, text string"), "doc_id", "text", width=4)
    assert answer(out) == plain(rows, 4)


def walk(pairs, levels, similarity, seed):
    """Share of pairs of signatures, agreeing in each place with the given chance, that still share a node so many levels below some first branch."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**32, (pairs, neardup.SIGNATURE), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < similarity, a, rng.integers(0, 2**32, a.shape, dtype=np.uint32))
    alive = np.zeros(pairs, bool)
    for tree, i in neardup.root_coordinates():
        rows = np.flatnonzero(a[:, i] == b[:, i])
        node = neardup._child(neardup._mix(np.full(pairs, tree + 1, np.uint64)), np.full(pairs, i), a[:, i])[rows]
        for _ in range(levels):
            (na, ra), (nb, rb) = neardup._branch(node, rows, a), neardup._branch(node, rows, b)
            both = set(zip(na.tolist(), ra.tolist())) & set(zip(nb.tolist(), rb.tolist()))
            node, rows = np.array([x for x, _ in both], np.uint64), np.array([x for _, x in both], np.int64)
        alive[rows] = True
    return alive.mean()


def test_branching_alone_reaches_the_recall(frame):
    """Without any small node or piece on the way: pairs of similarity 0.8 still meet many levels down."""
    assert walk(4000, 6, 0.8, 1) >= 0.999 and walk(1500, 12, 0.8, 2) >= 0.998 and walk(1500, 12, 0.9, 3) == 1


def test_recursion_finds_the_pairs(frame, monkeypatch):
    """Many texts around one passage: nodes of several components branch down to small ones, and nothing else decides."""
    turns = []
    descend = neardup._Join.open_nodes
    monkeypatch.setattr(neardup, "SMALL", 8)
    monkeypatch.setattr(neardup, "MEDIUM", 8)
    monkeypatch.setattr(neardup._Join, "open_nodes", lambda self, rows: turns.append(1) or descend(self, rows))
    monkeypatch.setattr(neardup._Join, "nearest", lambda self, meetings: meetings.where("false").select(F.col("v").alias("a"), "b"))
    rng = random.Random(6)
    passage, rows = [f"p{i}" for i in range(60)], []
    for i in range(150):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(55)]
        rows.append(" ".join(passage + own))
        own[rng.randrange(30, 50)] = "other"
        own[-1] = "last"
        rows.append(" ".join(passage + own))
    rows = list(enumerate(rows))
    out = neardup.near_duplicates(frame(rows, "doc_id long, text string"), "doc_id", "text", width=4)
    assert answer(out) == plain(rows, 4) and len(turns) > 2


def test_sketches_dismiss_no_link():
    rng = np.random.default_rng(4)
    for n in (3, 20, 300, 5000, 40000):
        for _ in range(30):
            total = rng.integers(0, 2**63, n, dtype=np.uint64)
            both = int(np.ceil(0.8 * n))
            cut = both + int(rng.integers(0, n - both + 1))
            a, b = np.unique(total[:cut]), np.unique(np.concatenate((total[:both], total[cut:])))
            sketches = [neardup.signature(x) + neardup.odd_bits(x) for x in (a, b)]
            values, odd = neardup._sketches(sketches)
            apart = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
            assert apart <= neardup.odd_limits(np.array([len(a) + len(b)]), 80)[0]
    far = [neardup.odd_bits(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(2)]
    assert int(np.bitwise_count(np.frombuffer(far[0], np.uint64) ^ np.frombuffer(far[1], np.uint64)).sum()) > 3 * neardup.odd_limits(np.array([600]), 80)[0]


def test_links_within_a_group_join_components():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: 300 - k], rng.integers(0, 2**63, k, dtype=np.uint64)))) for k in rng.integers(0, 120, 300)]
    n, c = np.array(list(map(len, sets))), np.arange(300) // 2
    for role in (np.zeros(300, np.int64), rng.integers(1, 3, 300)):
        got = neardup.joining_links(role, c, n, [s.tobytes() for s in sets], 80)
        parent = list(range(150))

        def find(x):
            return x if parent[x] == x else find(parent[x])

        for i in range(300):
            for j in range(i):
                if (role[i] == 0 or role[i] != role[j]) and neardup.linked(sets[i].tobytes(), sets[j].tobytes(), 80):
                    parent[find(c[i])] = find(c[j])
        mine = list(range(150))

        def seek(x):
            return x if mine[x] == x else seek(mine[x])

        for i, j in got:
            assert neardup.linked(sets[i].tobytes(), sets[j].tobytes(), 80) and seek(c[i]) != seek(c[j])
            mine[seek(c[i])] = seek(c[j])
        assert len({find(x) for x in range(150)}) == len({seek(x) for x in range(150)}) < 150 and len(got) < 300


def test_pairs_of_groups_and_roles():
    rng = np.random.default_rng(5)
    g, role, c = np.sort(rng.integers(0, 30, 200)), np.zeros(200, np.int64), rng.integers(0, 9, 200)
    role[g % 2 == 1] = rng.integers(1, 3, (g % 2 == 1).sum())
    got = sorted((int(a), int(b)) for i, j in neardup.pairs_within(g, role, c) for a, b in zip(i, j))
    meet = {(0, 0), (1, 2), (2, 1)}
    assert got == [(i, j) for i in range(200) for j in range(i + 1, 200) if g[i] == g[j] and c[i] != c[j] and (role[i], role[j]) in meet]


def test_edges(frame):
    schema = "doc_id long, text string, _k string, _t string, text_hash string"
    rows = [(None, "a b c d e f", "p", None, None), (7, "a b c d e f", None, "q", None), (7, "other words are here now ok", None, None, "r"), (7, "other words are here now ok", None, None, "r"), (None, None, None, None, None), (3, "", None, None, None), (3, " \n", None, None, None)]
    docs = frame(rows, schema)
    got = answer(neardup.near_duplicates(docs, "doc_id", "text"))
    assert got == Counter([(None, 2, 7), (7, 2, 7), (7, 2, 7), (7, 2, 7), (None, 0, None), (3, 0, 3), (3, 0, 3)])
    left = neardup.drop_near_copies(docs, "doc_id", "text")
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(7, rows[1][1]), (7, rows[2][1]), (None, None), (3, ""), (3, " \n")])
    assert neardup.drop_near_copies(docs.where("false"), "doc_id", "text").collect() == []


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op5_minhash_neardup"](spark, folder).withColumnRenamed("component_id", "component")
    assert answer(out) == plain(rows, 4)


def test_components(frame):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(6, 40)] + [(3, 3), (None, 4), (1, 2), (2, 1), (1, 2)]
    got = {r["v"]: r["c"] for r in graph.components(frame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 40)}, 1: 1, 2: 1}
    assert graph.components(frame([], "a long, b long")).collect() == []
