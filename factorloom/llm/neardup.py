"""MinHash near-duplicates by a chosen-path set similarity join.

Every text becomes its set of word shingles; equal sets are one vertex. Each of TREES trees branches the vertices recursively: a node chooses one
or two of SIGNATURE minwise tokens, by its own hash, and a vertex goes to the child named by its value there. Nodes of at most MEDIUM
vertices are compared exhaustively, larger ones branch on, LEVELS levels a round: up to there a comparison of two sketches is so
much cheaper than another row of the recursion that branching a node of alike texts would cost more than it saves.

Recall: half of the nodes choose two tokens, so a pair of similarity 0.8 shares 1.2 children on average, and its common nodes die out with a chance of 0.375
below any node. The trees start with 20 first branches between them, each shared with a chance of 0.8, so a pair whose common nodes all stay large is
missed with a chance of (1 - 0.8 * 0.625)^20, 1e-6; pairs of higher similarity less. Of first nodes above SMALL that need no branching, those of EXACT
branches are compared, which a pair misses with a chance of 0.2^EXACT, 2.6e-6; where a pair's nodes are of both kinds the chance stays
below 1e-5. All trees draw their tokens from one signature; the chances take its places as independent.

Only components are wanted, so no node emits all its pairs:
1. In every first node each vertex meets the smallest vertex there; the one it meets most often is its pair. Groups of copies, however large,
   mostly fall into one component through one pair per vertex.
2. Nodes whose vertices are all in one component are done. The rest recurse. Where one component holds half of a large node or more, as with a group
   of copies that no token can part, its vertices are compared with the others of the node in pieces of CHUNK by CHUNK and then leave it; the others branch on.
   What is still large after ROUNDS rounds is compared in such pieces too, so the result does not hang on a node's shrinking.
3. Of the pairs that small nodes and pieces allow, each vertex first gives its likeliest; links found join components. Vertices that may then still be linked
   to another component meet again in their nodes, with their full sets, and a node answers with the links that join components, at most one fewer
   than its vertices. A node's sets are split to pieces of at most about SHINGLES.
A pair is looked at in full only if its signatures agree in AGREE places, which a pair of similarity 0.8 misses with a chance below 2e-6, if the sizes allow
the similarity, and if its odd sketches allow it: ODD bits that say of each shingle hash whether it came an odd number of times, so that two sketches differ in about as many
bits as the sets in shingles; DEVIATIONS standard deviations of room are left. Links are confirmed on the full shingle sets.

Text is read where sets are made: once for signatures, and again only for vertices of candidate pairs. What is written is narrow.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import fresh, query, sized, table
from .graph import components

TREES, SIGNATURE, SMALL, MEDIUM, EXACT, LEVELS, ROUNDS, CHUNK, BUCKET, SHINGLES, BLOCK = 16, 64, 64, 2048, 8, 2, 12, 2048, 4096, 1 << 20, 128
AGREE = 35  # of SIGNATURE places
ODD, DEVIATIONS = 1024, 6
WIDE = 4 * SIGNATURE + ODD // 8  # bytes of a sketch: minwise values, then the odd bits
_RNG = np.random.default_rng(20240501)
_MASKS, _ODD = _RNG.integers(0, 2**63, SIGNATURE, dtype=np.uint64), _RNG.integers(0, 2**63, SIGNATURE, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text.

    Words are runs of anything but the six ASCII blanks, with A-Z lower-cased (bytes split and lower do just that). Fewer words than
    `width` are one shingle; no words give the empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    out = h[:n]
    for k in range(1, width):
        out = _mix(out) + h[k : k + n]
    return np.unique(_mix(out))


def signature(shingles: np.ndarray) -> bytes:
    """SIGNATURE minwise values of 32 bits."""
    return np.fromiter((((shingles ^ m) * a).min() >> np.uint64(32) for m, a in zip(_MASKS, _ODD)), np.uint32, SIGNATURE).tobytes()


def odd_bits(shingles: np.ndarray) -> bytes:
    """Per place, whether an odd number of shingles fall there."""
    return np.packbits((np.bincount((shingles & np.uint64(ODD - 1)).astype(np.int64), minlength=ODD) & 1).astype(np.uint8)).tobytes()


def odd_limits(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Most bits in which the odd sketches of two linked sets with so many shingles in all can differ.

    The sets differ in (100 - percent) / (100 + percent) of their shingles at most; mean and variance are those of throwing as many balls.
    """
    most = np.floor(sizes * ((100 - percent) / (100 + percent)) + 1e-9)
    one, two = np.power(1 - 2 / ODD, most), np.power(1 - 4 / ODD, most)
    variance = np.maximum(ODD + ODD * (ODD - 1) * two - (ODD * one) ** 2, 0) / 4
    return ODD / 2 * (1 - one) + DEVIATIONS * np.sqrt(variance) + 1


def root_coordinates(trees: int = TREES) -> list[tuple[int, int]]:
    """(tree, coordinate) of the first branches; the trees' first coordinates differ."""
    step = SIGNATURE // trees
    return [(r, r * step) for r in range(trees)] + [(r, r * step + step // 2) for r in range(0, trees, 4)]


def _child(node: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _mix(_mix(node + np.uint64(0x9E3779B97F4A7C15)) ^ (coordinate.astype(np.uint64) << np.uint64(32)) ^ value.astype(np.uint64))


def _sketches(column) -> tuple[np.ndarray, np.ndarray]:
    """Minwise values and odd bits (as 64-bit words) of sketches, a row each."""
    m = np.frombuffer(b"".join(column), np.uint8).reshape(-1, WIDE)
    return np.ascontiguousarray(m[:, : 4 * SIGNATURE]).view(np.uint32), np.ascontiguousarray(m[:, 4 * SIGNATURE :]).view(np.uint64)


def _matrix(sigs) -> np.ndarray:
    return _sketches(sigs)[0]


def likely(n: np.ndarray, values: np.ndarray, odd: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (i, j) may be linked, as places in i, and in how many bits their odd sketches differ."""
    fits = np.flatnonzero(100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    kept, bits = [], []
    for s in range(0, len(fits), step):
        at = fits[s : s + step]
        apart = np.bitwise_count(odd[i[at]] ^ odd[j[at]]).sum(1, dtype=np.int64)
        ok = apart <= odd_limits(n[i[at]] + n[j[at]], percent)
        at, apart = at[ok], apart[ok]
        ok = (values[i[at]] == values[j[at]]).sum(1) >= AGREE
        kept.append(at[ok]), bits.append(apart[ok])
    return (np.concatenate(kept), np.concatenate(bits)) if kept else (fits, fits)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _roots(sigs: pd.Series) -> pd.Series:
    m, out = _matrix(sigs), []
    for tree, i in root_coordinates():
        node = np.full(len(m), tree + 1, np.uint64)
        out.append(_child(_mix(node), np.full(len(m), i), m[:, i]))
    return pd.Series(list(np.stack(out, 1).view(np.int64)))


def _branch(node: np.ndarray, rows: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children and the rows of m they belong to."""
    pick = _mix(node ^ np.uint64(0xD1B54A32D192ED03))
    first = (pick % np.uint64(SIGNATURE)).astype(np.int64)
    second = ((first + 1 + ((pick >> np.uint64(16)) % np.uint64(SIGNATURE - 1)).astype(np.int64)) % SIGNATURE)
    two = (pick >> np.uint64(40)) % np.uint64(2) == 0
    one = _child(node, first, m[rows, first])
    more = _child(node[two], second[two], m[rows[two], second[two]])
    return np.concatenate((one, more)), np.concatenate((rows, rows[two]))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _descend(nodes: pd.Series, sigs: pd.Series) -> pd.Series:
    """Nodes LEVELS levels below, per row."""
    m = _matrix(sigs)
    node, rows = nodes.to_numpy().view(np.uint64), np.arange(len(m))
    for _ in range(LEVELS):
        node, rows = _branch(node, rows, m)
    order = np.argsort(rows, kind="stable")
    cuts = np.searchsorted(rows[order], np.arange(1, len(m)))
    return pd.Series(np.split(node[order].view(np.int64), cuts))


def _likely_of(percent: int):
    @F.pandas_udf(T.BooleanType())
    def ok(na: pd.Series, a: pd.Series, nb: pd.Series, b: pd.Series) -> pd.Series:
        (va, oa), (vb, ob), k = _sketches(a), _sketches(b), len(a)
        at, _ = likely(np.concatenate((na, nb)), np.vstack((va, vb)), np.vstack((oa, ob)), np.arange(k), np.arange(k, 2 * k), percent)
        return pd.Series(np.isin(np.arange(k), at))

    return ok


def _sets_of(width: int):
    @F.pandas_udf(T.BinaryType())
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(x, width).tobytes() for x in texts])

    return sets


SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType())])


def _sketch_of(width: int):
    @F.pandas_udf(SKETCH)
    def sketch(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            s = shingle_set(x, width)
            out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, signature(s) + odd_bits(s) if len(s) else None))
        return pd.DataFrame(out, columns=["n", "digest", "sig"])

    return sketch


def _links_of(percent: int):
    @F.pandas_udf(T.BooleanType())
    def links(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([linked(x, y, percent) for x, y in zip(a, b)])

    return links


def pairs_within(groups: np.ndarray, roles: np.ndarray, components: np.ndarray):
    """Pairs (i, j) of places of one group and two components whose roles meet: 0 with 0, 1 with 2. Groups stand together; some pairs at a time."""
    ends = np.searchsorted(groups, groups, "right")
    furthest = int((ends - np.arange(len(groups))).max(initial=0))
    some, held = [], 0
    for k in range(1, furthest):
        i = np.flatnonzero(np.arange(len(groups)) + k < ends)
        j = i + k
        ok = (components[i] != components[j]) & np.where(roles[i] == 0, roles[j] == 0, roles[i] + roles[j] == 3)
        some.append((i[ok], j[ok]))
        held += ok.sum()
        if held > 1 << 20:
            yield tuple(map(np.concatenate, zip(*some)))
            some, held = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*some)))


PAIR, MEETING = "a long, b long, apart double", "g long, v long, role int"


def _compare(percent: int, likeliest: bool):
    """Of a bucket of nodes and pieces: the likeliest pair (a, b) of each vertex, or else the vertices (g, v, role) that have any likely pair.

    apart: differing bits of the odd sketches in relation to their limit.
    """

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("g")
        v, g, role, c, n = (t.column(x).to_numpy() for x in ("v", "g", "role", "c", "n"))
        values, odd = _sketches(t.column("sig").to_pylist())
        best, partner = np.full(len(v), np.inf), np.zeros(len(v), np.int64)
        for i, j in pairs_within(g, role, c):
            at, bits = likely(n, values, odd, i, j, percent)
            i, j = i[at], j[at]
            apart = bits / odd_limits(n[i] + n[j], percent)
            for x, y in ((i, j), (j, i)):
                # the nearest partner of each place, the smallest vertex among equals
                order = np.lexsort((v[y], apart, x))
                x, y, d = x[order], y[order], apart[order]
                first = np.flatnonzero(np.diff(x, prepend=-1))
                x, y, d = x[first], v[y[first]], d[first]
                nearer = (d < best[x]) | ((d == best[x]) & (y < partner[x]))
                best[x[nearer]], partner[x[nearer]] = d[nearer], y[nearer]
        some = np.isfinite(best)
        if not likeliest:
            return pa.table({"g": g[some], "v": v[some], "role": role[some]})
        own = pd.DataFrame({"a": v[some], "b": partner[some], "apart": best[some]}).sort_values(["apart", "b"], kind="stable").drop_duplicates("a")
        return pa.Table.from_pandas(own, preserve_index=False)

    return compare


def _links_within(percent: int):
    """Of groups of vertices with their sets: links that join components, at most one fewer than a group's vertices."""

    def links_within(t: pa.Table) -> pa.Table:
        t = t.sort_by([("g", "ascending"), ("v", "ascending")])
        v, g, role, c, n = (t.column(x).to_numpy() for x in ("v", "g", "role", "c", "n"))
        sets, ends, out = t.column("s"), [0, *np.flatnonzero(np.diff(g)) + 1, len(g)], []
        for a, b in zip(ends, ends[1:]):
            own = [sets[k].as_py() for k in range(a, b)]
            out += [(int(v[a + i]), int(v[a + j])) for i, j in joining_links(role[a:b], c[a:b], n[a:b], own, percent)]
        return pa.table({x: pa.array([p[k] for p in out], pa.int64()) for k, x in enumerate("ab")})

    return links_within


def joining_links(role: np.ndarray, c: np.ndarray, n: np.ndarray, sets: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Linked pairs of places whose roles meet, each joining two components that no link before it has joined; BLOCK by BLOCK places at a time."""
    names, comp = np.unique(c, return_inverse=True)
    comp, out = comp.copy(), []
    for a in range(0, len(c), BLOCK):
        for b in range(a, len(c), BLOCK):
            i, j = np.arange(a, min(a + BLOCK, len(c))), np.arange(b, min(b + BLOCK, len(c)))
            meet = np.where(role[i][:, None] == 0, role[j][None] == 0, role[i][:, None] + role[j][None] == 3)
            may = meet & (comp[i][:, None] != comp[j][None]) & (100 * np.minimum(n[i][:, None], n[j][None]) >= percent * np.maximum(n[i][:, None], n[j][None]))
            some, others = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
            if not some.size:
                continue
            both = np.zeros(may.shape, np.int64)
            both[np.ix_(some, others)] = intersections([sets[x] for x in i[some]], [sets[x] for x in j[others]])
            may &= 100 * both >= percent * (n[i][:, None] + n[j][None] - both)
            for x, y in zip(*np.nonzero(may)):
                p, q = comp[i[x]], comp[j[y]]
                if p != q:
                    comp[comp == p] = q
                    out.append((i[x], j[y]))
    return out


def intersections(a: list[bytes], b: list[bytes], columns: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b.

    The shingles that both sides have become columns of two 0/1 matrices, some columns at a time; their product counts exactly.
    """
    total = np.zeros((len(a), len(b)), np.int64)
    if not a or not b:
        return total
    x, y = (np.concatenate([np.frombuffer(s, np.uint64) for s in side]) for side in (a, b))
    shared = np.intersect1d(x, y)
    rows, cols = (np.repeat(np.arange(len(side)), [len(s) // 8 for s in side]) for side in (a, b))
    px, py = np.searchsorted(shared, x), np.searchsorted(shared, y)
    ix, iy = px < len(shared), py < len(shared)
    ix[ix], iy[iy] = shared[px[ix]] == x[ix], shared[py[iy]] == y[iy]
    for start in range(0, len(shared), columns):
        ends = min(columns, len(shared) - start)
        left, right = np.zeros((len(a), ends), np.float32), np.zeros((len(b), ends), np.float32)
        kx, ky = ix & (px >= start) & (px < start + ends), iy & (py >= start) & (py < start + ends)
        left[rows[kx], px[kx] - start] = 1
        right[cols[ky], py[ky] - start] = 1
        total += (left @ right.T).astype(np.int64)
    return total


def linked(x: bytes, y: bytes, percent: int) -> bool:
    """Do two sets, as sorted 64-bit integers, reach the similarity?"""
    both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
    return 100 * both >= percent * (len(x) // 8 + len(y) // 8 - both)


class _Join:
    """One run over a table: vertices, their labels so far, and the ways to pairs and links."""

    def __init__(self, docs: DataFrame, key: str, text: str, width: int, percent: int):
        self.docs, self.key, self.text, self.width, self.percent = docs, key, text, width, percent
        # the text's own hash tells rows apart that share a key
        rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), _sketch_of(width)(F.col(text)).alias("s"))
        self.rows = materialize(rows.select("k", "t", "s.*"), "sketches")
        one = self.rows.where("n > 0").groupBy("digest").agg(F.min(F.struct("k", "t")).alias("w"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        self.vertices = materialize(one.select(F.monotonically_increasing_id().alias("v"), "digest", "w.k", "w.t", "n", "sig"), "vertices")
        self.sigs = self.vertices.select("v", "n", "sig")
        self.labels: DataFrame | None = None

    def fits(self, a: str, b: str):
        """Sizes that allow the similarity."""
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def label(self, rows: DataFrame) -> DataFrame:
        """Add the component so far as c."""
        if self.labels is None:
            return rows.withColumn("c", F.col("v"))
        return rows.join(sized(self.labels, 40), "v", "left").withColumn("c", F.coalesce("c", "v"))

    def allowed(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that sizes and sketches allow."""
        x, y = (self.sigs.select(F.col("v").alias(v), F.col("n").alias(f"n{v}"), F.col("sig").alias(f"s{v}")) for v in "ab")
        return pairs.join(x, "a").join(y, "b").where(_likely_of(self.percent)("na", "sa", "nb", "sb")).select("a", "b")

    def sets(self, used: DataFrame) -> DataFrame:
        """(v, s): the full sets of the vertices `used` (v, any number of times), from one more look at the texts."""
        used = materialize(self.vertices.join(used.distinct(), "v", "left_semi").select("v", "k", "t"), "compared")
        wanted = sized(used.select("v", F.col("k").alias("_k"), F.col("t").alias("_t")), 40)
        texts = self.docs.select(F.col(self.key).alias("k"), F.col(self.text).alias("x")).withColumn("t", F.xxhash64("x"))
        found = texts.join(wanted, F.col("t").eqNullSafe(F.col("_t")) & F.col("k").eqNullSafe(F.col("_k")))
        return materialize(found.select("v", _sets_of(self.width)("x").alias("s")).dropDuplicates(["v"]), "sets")

    def confirm(self, pairs: DataFrame) -> None:
        """Compare pairs (a, b) on full sets and merge the labels of linked ones."""
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            return
        sets = self.sets(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).select(F.col("a").alias("v")))
        j = pairs.join(sets.select(F.col("v").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("v").alias("b"), F.col("s").alias("sb")), "b")
        self.join(j.where(_links_of(self.percent)("sa", "sb")).select("a", "b"))

    def join(self, links: DataFrame) -> None:
        """Merge the labels of linked vertices (a, b)."""
        links = materialize(links, "links")
        if links.isEmpty():
            return
        ends = self.label(links.select("b", F.col("a").alias("v"))).select("b", F.col("c").alias("a"))
        ends = self.label(ends.select("a", F.col("b").alias("v"))).select("a", F.col("c").alias("b"))
        merged = components(ends).select(F.col("v").alias("c"), F.col("c").alias("to"))
        if self.labels is None:
            self.labels = materialize(merged.select(F.col("c").alias("v"), F.col("to").alias("c")), "labels")
        else:
            old = self.labels.join(merged, "c", "left").select("v", F.coalesce("to", "c").alias("c"))
            new = merged.select(F.col("c").alias("v"), F.col("to").alias("c")).join(self.labels, "v", "left_anti")
            self.labels = materialize(old.unionByName(new), "labels")

    def run(self) -> None:
        nodes = materialize(self.vertices.select("v", "n", F.posexplode(_roots("sig")).alias("i", "node")), "nodes")
        # 1: every vertex with the smallest of its node
        heads = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("v", "n")).alias("p")).where("size > 1")
        met = materialize(nodes.join(heads, "node").select("node", "i", "v", "n", F.col("p.v").alias("b"), F.col("p.n").alias("bn")), "met")
        self.confirm(self.allowed(self.nearest(met.where((F.col("v") != F.col("b")) & self.fits("n", "bn")).select("v", "b"))))
        # 2: down the trees, as long as large nodes hold several components
        rows, leaves = met.select("node", "i", "v"), []
        for turn in range(ROUNDS + 1):
            here = self.open_nodes(rows)
            leaves.append(materialize(self.leaves(here, turn == ROUNDS), "leaves"))
            on = here.where((F.col("size") > MEDIUM) & ~F.col("leaves"))
            if turn == ROUNDS or on.isEmpty():
                break
            # below the first nodes every node counts
            rows = materialize(on.select("node", "v").join(self.sigs, "v").select("v", F.lit(0).alias("i"), F.explode(_descend("node", "sig")).alias("node")), "nodes")
        # 3: the likeliest pair of every vertex, then whatever is still between two components
        left = functools.reduce(DataFrame.unionByName, leaves)
        ends = self.compared(left, True)
        best = ends.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
        self.confirm(best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        self.join(self.rest(self.compared(left, False)))

    def open_nodes(self, rows: DataFrame) -> DataFrame:
        """The rows (node, i, v) of nodes of several components: component c, the node's largest component main with m vertices, and size.

        half: main has half of a large node or more. leaves: the vertex does not branch on, as it is of main, or one of few others.
        """
        here = self.label(rows).select("node", "i", "v", "c")
        count = here.groupBy("node", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("node").agg(F.sum("m").alias("size"), F.max(F.struct("m", "c")).alias("x"), F.count(F.lit(1)).alias("k"))
        state = count.where("k > 1").select("node", "size", F.col("x.m").alias("m"), F.col("x.c").alias("main"))
        half = (F.col("size") > MEDIUM) & (2 * F.col("m") >= F.col("size"))
        open_ = here.join(state, "node").withColumn("half", half).withColumn("leaves", F.col("half") & ((F.col("c") == F.col("main")) | (F.col("size") - F.col("m") <= MEDIUM)))
        return materialize(open_.where((F.col("size") <= SMALL) | (F.col("size") > MEDIUM) | (F.col("i") < EXACT)), "open-nodes")

    def leaves(self, here: DataFrame, last: bool) -> DataFrame:
        """What is compared: (g, v, role), g a small node or a piece of a large one. Roles: 0 meets 0, 1 meets 2."""
        g, v = F.col("node").alias("g"), F.col("v")
        small = here.where(F.col("size") <= MEDIUM).select(g, v, F.lit(0).alias("role"))
        # the few others of a node that one component rules are a small node of their own
        few = here.where(F.col("half") & (F.col("c") != F.col("main")) & F.col("leaves")).select(F.xxhash64("node", F.lit("few")).alias("g"), v, F.lit(0).alias("role"))
        # the others against the main component, or in the last round against all
        large = here.where(F.col("size") > MEDIUM if last else F.col("half"))
        against = F.lit(True) if last else F.col("c") == F.col("main")
        pieces = lambda n: F.greatest(F.ceil(n / CHUNK).cast("long"), F.lit(1).cast("long"))
        rest, them = pieces(F.col("size") - F.col("m")), pieces(F.col("size") if last else F.col("m"))
        part = lambda n: F.pmod(F.xxhash64("v", F.lit(5)), n)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        ones = large.where("c <> main").select("node", v, F.lit(1).alias("role"), part(rest).alias("i"), every(them).alias("j"))
        twos = large.where(against).select("node", v, F.lit(2).alias("role"), every(rest).alias("i"), part(them).alias("j"))
        tiles = ones.unionByName(twos).select(F.xxhash64("node", "i", "j").alias("g"), "v", "role")
        return small.unionByName(few).unionByName(tiles)

    def open_leaves(self, leaves: DataFrame) -> DataFrame:
        """The rows (g, v, role) of nodes and pieces that still hold several components, with component c."""
        here = self.label(leaves).select("g", "v", "role", "c")
        state = here.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g")
        return materialize(here.join(state, "g", "left_semi"), "open-leaves")

    def compared(self, leaves: DataFrame, likeliest: bool) -> DataFrame:
        """Likely pairs of two components: the likeliest (a, b, apart) of each vertex a and bucket, or the vertices (g, v, role) that have any."""
        open_ = self.open_leaves(leaves)
        buckets = max(1, -(-open_.count() // BUCKET))
        rows = open_.join(self.sigs, "v").withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))
        return materialize(rows.groupBy("bucket").applyInArrow(_compare(self.percent, likeliest), PAIR if likeliest else MEETING), "compared")

    def rest(self, meetings: DataFrame) -> DataFrame:
        """The links (a, b) that join components among vertices (g, v, role), found with their full sets."""
        open_ = self.open_leaves(meetings)
        sets = self.sets(open_.select("v"))
        rows = open_.join(self.vertices.select("v", "n"), "v")
        total = materialize(rows.groupBy("g").agg(F.ceil(F.sum("n") / SHINGLES).cast("long").alias("k"), F.sum("n").alias("n")), "group-sizes")
        # a group of k pieces goes out k times
        buckets = max(1, -(-(total.agg(F.coalesce(F.sum(F.col("n") * F.col("k")), F.lit(0))).first()[0]) // SHINGLES))
        # pieces of a group meet each other and themselves
        dealt = rows.join(total.select("g", "k"), "g").withColumn("p", F.pmod(F.xxhash64("v", F.lit(9)), F.col("k")))
        every = dealt.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        alone, other = F.col("p") == F.col("q"), F.when(F.col("p") < F.col("q"), 1).otherwise(2)
        both = every.select(
            F.xxhash64("g", F.least("p", "q"), F.greatest("p", "q")).alias("g"), "v", "n", "c",
            # what met as 0 with 0 meets as 1 with 2 between pieces; 1 and 2 stay
            F.when(alone | (F.col("role") > 0), F.col("role")).otherwise(other).alias("role"))
        found = both.join(sets, "v").withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))
        return found.groupBy("bucket").applyInArrow(_links_within(self.percent), "a long, b long").distinct()

    def nearest(self, meetings: DataFrame) -> DataFrame:
        """Of the meetings (v, b), one pair (a, b) per v: with the b it meets most often."""
        often = meetings.groupBy("v", "b").count().groupBy("v").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
        return often.select(F.col("v").alias("a"), "b")


def near_duplicates(docs: DataFrame, key: str, text: str, width: int = 5, percent: int = 80) -> DataFrame:
    """(key, text_hash, n_shingles, component, kept) for every row of docs.

    component: the smallest key that can be reached over links of at least `percent` % set similarity, its own included. kept: the
    key is the component. Rows without words are linked with nothing. A null key is larger than any other, and is its component's
    name only where there is no other. Rows may share a key: each is judged by its own text; text_hash tells them apart. Repeated rows share their answer.
    """
    run = _Join(docs, key, text, width, percent)
    run.run()
    named = run.label(run.vertices.select("v", "digest"))
    rows = run.rows.join(named.select("digest", "c"), "digest", "left")
    # a component's rows are summed map-side; the names come back to rows by a join that AQE splits
    names = materialize(rows.where("c IS NOT NULL").groupBy("c").agg(F.min("k").alias("name")), "components")
    out = rows.join(names, "c", "left").withColumn("name", F.when(F.col("c").isNull(), F.col("k")).otherwise(F.col("name")))
    return out.select(F.col("k").alias(key), F.col("t").alias("text_hash"), F.col("n").alias("n_shingles"), F.col("name").alias("component"), F.col("k").eqNullSafe(F.col("name")).alias("kept"))


def drop_near_copies(docs: DataFrame, key: str, text: str, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with the columns of docs: the smallest key; of several rows with that key and text, one."""
    k, t = fresh(docs, "_k", "_t")
    kept = near_duplicates(docs, key, text, width, percent).where("kept").select(F.col(key).alias(k), F.col("text_hash").alias(t + "h")).distinct()
    marked = docs.withColumn(t, F.xxhash64(F.col(text)))
    j = marked.join(kept, F.col(t).eqNullSafe(F.col(t + "h")) & F.col(key).eqNullSafe(F.col(k)), "left_semi")
    return j.dropDuplicates([key, t]).select(*docs.columns)


@query("op5_minhash_neardup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    out = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", width=4)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")
