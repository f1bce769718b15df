"""Hard negatives from Hilbert-ordered Parquet blocks with zone maps.

Candidates are written in the order of a Hilbert curve through their vectors, 2^BLOCK rows a block and STRIPE rows a partition. A zone map
has the least and largest value of each dimension in a block, and the block's labels. For an anchor a, interval arithmetic bounds its
inner product with every row of a block: sum of max(a*lo, a*hi) above and of min(a*lo, a*hi) below. An anchor asks for a block only if
its windows can have a score between these bounds, and only blocks that some anchor of a group asks for are joined with that group.

1. Positives: an anchor's own stripe gives a first guess of its k-th best positive; blocks of its label whose upper bound reaches it are read.
2. Negatives: each positive's score p opens a window [share * p, p]. The own stripe fills it first; if it finds k rows, the lower end rises to the
   k-th score. Blocks that can reach into a window are read.
The guesses only ever leave out what cannot be returned, so the result is exact. On vectors without any structure the bounds are wide and nearly all blocks are read.

Anchors and candidates are whole-number vectors and scores exact integers: products go through floating-point matrices only while all sums stay below
2^53, and through whole numbers of any length else. A task holds one stripe's asked-for blocks and one group of anchors. Equal vectors, also a
third of all rows, are neighbours on the curve in any number of blocks and partitions, as their key breaks ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, table
from .vectors import entries, matrix, usable, width

BITS, STRIPE, CELLS = 4, 16384, 1 << 22
#: Powers of two: rows of a block, stripes whose anchors form a group, stripes whose zone maps are planned together.
BLOCK, GROUP, SHEET = 10, 5, 9
LONG_MAX = 2**63 - 1


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of each row of cells (values of `bits` bits) on the Hilbert curve through all dimensions, as bytes that sort like the place.

    After J. Skilling, "Programming the Hilbert curve" (2004): inverse undo of the excess work, then a Gray code.
    """
    x, d = cells.astype(np.uint32).T.copy(), cells.shape[1]
    if not d:
        return [b""] * len(cells)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t, q = np.zeros(x.shape[1], np.uint32), np.uint32(1 << (bits - 1))
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= t
    planes = [((x >> np.uint32(b)) & np.uint32(1)).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    return [r.tobytes() for r in np.packbits(np.concatenate(planes).T, axis=1)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; results outside 64 bits become the nearest end."""
    most = (float(np.abs(a.astype(np.float64)).max(initial=0)) + 1) * (float(np.abs(b.astype(np.float64)).max(initial=0)) + 1) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -LONG_MAX - 1, LONG_MAX).astype(np.int64)


def reach(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product of each anchor with anything between lo and hi, a row per anchor; widened by what rounding may take."""
    a, lo, hi = (x.astype(np.float64) for x in (a, lo, hi))
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    room = 1e-9 * (np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)).T) + 1e-3
    return up @ lo.T + down @ hi.T - room, up @ hi.T + down @ lo.T + room


FOUND = "anchor long, slot int, score long, id long"


def _zones(columns: int):
    def zones(batches):
        for b in batches:
            blocks, label, x = b.column("block").to_numpy(), b.column("label").to_numpy(), matrix(b.column("x"), columns, np.int64)
            for k in np.unique(blocks):
                own = blocks == k
                yield pa.RecordBatch.from_pydict({"block": [k], "lo": [x[own].min(0)], "hi": [x[own].max(0)], "labels": [np.unique(label[own])]}, ZONE)

    return zones


ZONE = pa.schema([("block", pa.int64()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64()))])
ZONE_DDL = "block long, lo array<long>, hi array<long>, labels array<long>"


def _merged(columns: int):
    def merged(key: tuple, g: pa.Table) -> pa.Table:
        lo, hi = matrix(g.column("lo"), columns, np.int64).min(0), matrix(g.column("hi"), columns, np.int64).max(0)
        labels = np.unique(g.column("labels").combine_chunks().flatten().to_numpy())
        return pa.table({"block": [key[0].as_py()], "lo": [lo], "hi": [hi], "labels": [labels]}, ZONE)

    return merged


def _wanted(a: np.ndarray, label: np.ndarray, lo: np.ndarray, hi: np.ndarray, zlo: np.ndarray, zhi: np.ndarray, zlabels: list[np.ndarray], same: bool) -> np.ndarray:
    """Which blocks each anchor must read: its windows (lo, hi; a column each) meet the block's bounds, and the labels allow it."""
    least, most = reach(a, zlo, zhi)
    out = np.zeros(least.shape, bool)
    for w in range(lo.shape[1]):
        out |= (most >= lo[:, w, None]) & (least <= hi[:, w, None]) & (lo[:, w] <= hi[:, w])[:, None]
    for j, own in enumerate(zlabels):
        # negatives need another label than the anchor's
        out[:, j] &= np.isin(label, own) if same else (len(own) > 1) | (label != own[0])
    return out


def _asked(t: pa.Table, columns: int) -> tuple:
    windows = t.column("lo").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0)
    # absent windows are empty: their lower end is above their upper end
    lo, hi = (np.where(np.arange(windows) < t.column("lo").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)[:, None], matrix(t.column(x), windows, np.int64), fill) for x, fill in (("lo", 1), ("hi", 0)))
    return t.column("id").to_numpy(), t.column("label").to_numpy(), matrix(t.column("x"), columns, np.int64), lo, hi, t.column("home").to_numpy()


def _plan(columns: int, same: bool):
    def plan(key: tuple, zones: pa.Table, anchors: pa.Table) -> pa.Table:
        if not zones.num_rows or not anchors.num_rows:
            return pa.table({"part": pa.array([], pa.int64()), "block": pa.array([], pa.int64())})
        _, label, x, lo, hi, _ = _asked(anchors, columns)
        block, labels = zones.column("block").to_numpy(), [np.asarray(v) for v in zones.column("labels").to_pylist()]
        zlo, zhi, some = matrix(zones.column("lo"), columns), matrix(zones.column("hi"), columns), np.zeros(len(block), bool)
        step = max(1, CELLS // len(block))
        for s in range(0, len(x), step):
            some |= _wanted(x[s : s + step], label[s : s + step], lo[s : s + step], hi[s : s + step], zlo, zhi, labels, same).any(0)
        return pa.table({"part": np.full(some.sum(), key[0].as_py()), "block": block[some]})

    return plan


def _read(columns: int, same: bool, k: int, at_home: bool):
    """Best k rows of a stripe per anchor and window; at_home: anchors of this stripe only, or all but those."""

    def read(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            ids, label, x, lo, hi, home = _asked(anchors, columns)
            take = (home == key[1].as_py()) == at_home
            ids, label, x, lo, hi = (v[take] for v in (ids, label, x, lo, hi))
            rid, rlabel, rx, rblock = rows.column("id").to_numpy(), rows.column("label").to_numpy(), matrix(rows.column("x"), columns, np.int64), rows.column("block").to_numpy()
            step = max(1, CELLS // len(rid))
            for s in range(0, len(ids), step):
                out += _best(ids[s : s + step], label[s : s + step], x[s : s + step], lo[s : s + step], hi[s : s + step], rid, rlabel, rx, rblock, same, k)
        cols = list(zip(*out)) or [[]] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("anchor", "slot", "score", "id"), cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))})

    return read


def _best(ids, label, x, lo, hi, rid, rlabel, rx, rblock, same: bool, k: int) -> list[tuple]:
    blocks = np.unique(rblock)
    inside = [np.flatnonzero(rblock == b) for b in blocks]
    if not blocks.size or not ids.size:
        return []
    zlo, zhi = np.stack([rx[i].min(0) for i in inside]), np.stack([rx[i].max(0) for i in inside])
    wanted = _wanted(x, label, lo, hi, zlo, zhi, [np.unique(rlabel[i]) for i in inside], same)
    floor = np.where(lo <= hi, lo, LONG_MAX).min(1)
    ceiling = np.where(lo <= hi, hi, -LONG_MAX - 1).max(1)
    who, which, score = [], [], []
    for j, own in enumerate(inside):
        mine = np.flatnonzero(wanted[:, j])
        if not mine.size:
            continue
        s = products(x[mine], rx[own])
        ok = (s >= floor[mine, None]) & (s <= ceiling[mine, None]) & ((label[mine, None] == rlabel[own]) == same) & (ids[mine, None] != rid[own])
        i, r = np.nonzero(ok)
        who.append(mine[i]), which.append(own[r]), score.append(s[i, r])
    if not who:
        return []
    who, which, score = map(np.concatenate, (who, which, score))
    order = np.lexsort((rid[which], -score, who))
    who, which, score = who[order], which[order], score[order]
    ends, out = np.searchsorted(who, np.arange(len(ids) + 1)), []
    for a in range(len(ids)):
        s = score[ends[a] : ends[a + 1]]
        for w in range(lo.shape[1]):
            first = np.searchsorted(-s, -hi[a, w])
            for p in range(first, min(first + k, len(s))):
                if s[p] < lo[a, w]:
                    break
                out.append((int(ids[a]), w, int(s[p]), int(rid[which[ends[a] + p]])))
    return out


def _extremes(columns: int):
    def extremes(batches):
        for b in batches:
            x = matrix(b.column("x"), columns, np.int64)
            if len(x):
                yield pa.RecordBatch.from_pydict({"pos": np.arange(columns), "lo": x.min(0), "hi": x.max(0)})

    return extremes


def _along(columns: int, least: np.ndarray, most: np.ndarray):
    def along(batches):
        for b in batches:
            cells = (matrix(b.column("x"), columns) - least) * (((1 << BITS) - 1e-6) / np.maximum(most - least, 1))
            keys = hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], [*b.schema.names, "curve"])

    return along


class _Blocks:
    """Candidates (id, label, x, anchor) in written blocks with zone maps, and the way to ask them."""

    def __init__(self, rows: DataFrame):
        self.columns = columns = width(rows, "x")
        ends = rows.select("x").mapInArrow(_extremes(columns), "pos long, lo long, hi long").groupBy("pos").agg(F.min("lo"), F.max("hi")).orderBy("pos").collect()
        least, most = (np.array([r[j] for r in ends], np.float64) for j in (1, 2))
        curve = rows.mapInArrow(_along(columns, least, most), "id long, label long, x array<long>, anchor boolean, curve binary")
        parts = max(1, -(-rows.count() // STRIPE))
        placed = curve.repartitionByRange(parts, "curve", "id").sortWithinPartitions("curve", "id").withColumn("place", F.monotonically_increasing_id())
        # a partition's number stands from bit 33 on, a row's place in it below
        stripe = F.shiftright("place", 33)
        self.rows = materialize(placed.select("id", "label", "x", "anchor", F.shiftright("place", BLOCK).alias("block"), stripe.alias("stripe"), F.shiftright(stripe, GROUP).alias("part")), "hilbert-blocks")
        partial = self.rows.select("block", "label", "x").mapInArrow(_zones(columns), ZONE_DDL)
        zones = partial.groupBy("block").applyInArrow(_merged(columns), ZONE_DDL)
        self.zones = materialize(zones.withColumn("sheet", F.shiftright("block", 33 - BLOCK + SHEET)), "zone-maps")
        last = self.rows.agg(F.coalesce(F.max("stripe"), F.lit(0))).first()[0]
        self.parts, self.sheets = (last >> GROUP) + 1, (last >> SHEET) + 1
        self.anchors = materialize(self.rows.where("anchor").select("part", F.col("stripe").alias("home"), "id", "label", "x"), "anchors")

    def ask(self, windows: DataFrame, same: bool, k: int, at_home: bool) -> DataFrame:
        """Best k rows (anchor, slot, score, id) of each stripe for the windows (id, lo, hi; arrays) of anchors: their own stripe, or all others."""
        anchors, on = self.anchors.join(windows, "id"), ["part", "stripe"]
        if at_home:
            rows, asked = self.rows, anchors.withColumn("stripe", F.col("home"))
        else:
            anchors = materialize(anchors, "anchors")
            each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
            zones, spread = self.zones.withColumn("part", each(self.parts)), anchors.withColumn("sheet", each(self.sheets))
            plan = zones.groupBy("part", "sheet").cogroup(spread.groupBy("part", "sheet")).applyInArrow(_plan(self.columns, same), "part long, block long")
            plan = materialize(plan.withColumn("stripe", F.shiftright("block", 33 - BLOCK)), "asked-blocks")
            rows = self.rows.drop("part", "stripe").join(plan, "block")
            asked = anchors.join(materialize(plan.select(*on).distinct(), "asked-stripes"), "part")
        found = rows.select(*on, "block", "id", "label", "x").groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(_read(self.columns, same, k, at_home), FOUND)
        return materialize(found, "found")


def _first(found: DataFrame, k: int, *group: str) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def _raised(found: DataFrame, k: int) -> DataFrame:
    """(anchor, slot, floor): the k-th score found, where there are k."""
    return found.groupBy("anchor", "slot").agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("floor")).where(F.col("m") >= k).drop("m")


def _arrays(windows: DataFrame) -> DataFrame:
    """Windows (anchor, slot, lo, hi) as one row (id, lo, hi) per anchor."""
    w = windows.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "lo", "hi"))).alias("w"))
    return w.select(F.col("anchor").alias("id"), F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))


def hard_negatives(df: DataFrame, key: str, vec: str, label: str | Column, asked: Column, positives: int = 5, negatives: int = 5, share: int = 80, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, the rows that `asked` names.

    A component x counts as floor(scale * x). Higher scores come first, ties go to the smaller key. Positives are an anchor's first rows of its label,
    negatives of a positive the first rows of other labels with share % of its score or more, and not above it; a negative positive score has none.

    Keys and labels are whole numbers. Rows with a null key, label or vector, or a null or non-finite component, take no part. Of rows that share a key, the one with
    the smallest label, then vector, counts. Shorter vectors count as ending in zeros; empty ones score 0. Components beyond
    2^63 and scores beyond 64 bits become the nearest end. Without rows or anchors there are no pairs. Other columns are not looked at.
    """
    name = F.col(label) if isinstance(label, str) else label
    taken = df.where(F.col(key).isNotNull() & name.isNotNull() & usable(vec))
    whole = F.transform(entries(vec), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    one = taken.select(F.col(key).cast("long").alias("id"), F.struct(name.cast("long").alias("label"), whole.alias("x")).alias("r"), F.coalesce(asked, F.lit(False)).alias("anchor"))
    rows = materialize(one.groupBy("id").agg(F.min("r").alias("r"), F.max("anchor").alias("anchor")).select("id", "r.label", "r.x", "anchor"), "whole-vectors")
    blocks = _Blocks(rows)
    everything = blocks.anchors.select(F.col("id").alias("anchor"), F.lit(0).alias("slot"), F.lit(-LONG_MAX).alias("lo"), F.lit(LONG_MAX).alias("hi"))

    def both(windows: DataFrame, same: bool, k: int) -> DataFrame:
        home = blocks.ask(_arrays(windows), same, k, True)
        raised = windows.join(_raised(home, k), ["anchor", "slot"], "left").select("anchor", "slot", F.greatest("lo", "floor").alias("lo"), "hi")
        return home.unionByName(blocks.ask(_arrays(raised), same, k, False))

    pos = _first(both(everything, True, positives), positives, "anchor")
    pos = materialize(pos.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    lowest = F.ceil(F.col("positive_score").cast("decimal(20,0)") * share / 100).cast("long")
    # slots of arrays count from 0
    windows = pos.where("positive_score >= 0").select("anchor", (F.col("slot") - 1).alias("slot"), lowest.alias("lo"), F.col("positive_score").alias("hi"))
    windows = windows.withColumn("slot", (F.row_number().over(Window.partitionBy("anchor").orderBy("slot")) - 1))
    neg = _first(both(windows, False, negatives), negatives, "anchor", "slot").withColumn("slot", F.col("slot") + 1)
    out = neg.join(pos, ["anchor", "slot"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


OP11_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
  FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"), "vec_id", "embedding", changed, F.col("vec_id") % 100 == 0)
