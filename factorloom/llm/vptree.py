"""Nearest neighbours by cosine, from a vantage-point tree per shard.

Vectors scaled to length one lie on a sphere, where the straight-line distance falls as the cosine rises. Each node of a tree picks a vantage point
far from its first point, halves its points by their distance to it, and keeps the least and largest distance of either half. A query at
distance d from the vantage point can have no neighbour in a half nearer than max(least - d, d - largest, 0), by the triangle
inequality. A half is skipped if `factor` times that bound is beyond the query's k-th best so far. Factor one restores exact search; with a
larger one, whatever is missed is at least 1/factor times as far away as the k-th neighbour returned.

Equal vectors are one point, which keeps the k + 1 smallest keys: with ties going to the smaller key no other row of that vector
can be an answer. So a vector that a third of all rows share is reduced before the shuffle, and every point left is indexed.

Points are dealt by hash over shards of SHARD_BYTES; a shard's tree is one row of a written index. Queries go to every shard in groups of
QUERY_BYTES; each (shard, group) is a task's work and answers with at most k rows per query, and the best k of those are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, table
from .vectors import entries, matrix, usable, width

SHARD_BYTES, QUERY_BYTES, LEAF, FACTOR, SPARE = 4 << 20, 8 << 20, 64, 2.0, 8
#: Distances are sums of rounded terms; a bound counts only beyond this.
SLACK = 1e-7


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a power of two comes out first, so that squares neither overflow nor vanish."""
    m = halved(m)
    return m / np.sqrt((m * m).sum(1))[:, None]


def halved(m: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest entry, which is exact."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(1, initial=0))[1][:, None])


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first entry to the last, so that equal vectors get equal results wherever they stand."""
    return np.cumsum(a * b, axis=-1)[..., -1]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.broadcast_arrays(a, b)
    return dots(a, b) / (np.sqrt(dots(a, a)) * np.sqrt(dots(b, b)))


def grow(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, nodes (start, end, vantage point, near child, far child) and the halves' distances (4 per node).

    Children are -1 in a leaf; vantage points count in the new order.
    """
    order, nodes, halves, todo = np.arange(len(points)), [[0, len(points), -1, -1, -1]], [[0.0] * 4], [0]
    vantages = {}
    while todo:
        at = todo.pop()
        a, b = nodes[at][:2]
        if b - a <= leaf:
            continue
        here = points[order[a:b]]
        far = int(np.argmax(((here - here[0]) ** 2).sum(1)))
        vantages[at] = order[a + far]
        d, mid = np.sqrt(((here - here[far]) ** 2).sum(1)), (b - a) // 2
        parted = np.argpartition(d, mid)
        order[a:b], d = order[a:b][parted], d[parted]
        halves[at] = [d[:mid].min(), d[:mid].max(), d[mid:].min(), d[mid:].max()]
        for slot, (x, y) in ((3, (a, a + mid)), (4, (a + mid, b))):
            nodes[at][slot] = len(nodes)
            todo.append(len(nodes))
            nodes.append([x, y, -1, -1, -1])
            halves.append([0.0] * 4)
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    for at, v in vantages.items():
        nodes[at][2] = place[v]
    return order, np.array(nodes, np.int64), np.array(halves)


def _bounds(d: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """Least possible distances of the near and the far half."""
    lo, hi = halves[..., 0::2], halves[..., 1::2]
    return np.maximum(np.maximum(lo - d[:, None], d[:, None] - hi), 0)


def search(points: np.ndarray, nodes: np.ndarray, halves: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k nearest points of each query and their squared distances; missing ones are -1 and infinite. And how many leaves were read."""
    n = len(queries)
    best, found, read = np.full((n, k), np.inf), np.full((n, k), -1, np.int64), np.zeros(n, np.int64)

    def meet(who: np.ndarray, at: int) -> None:
        a, b = nodes[at, :2]
        d2 = np.maximum(2 - 2 * (queries[who] @ points[a:b].T), 0)
        d2, idx = np.hstack((best[who], d2)), np.hstack((found[who], np.broadcast_to(np.arange(a, b), d2.shape)))
        keep = np.argpartition(d2, k - 1, axis=1)[:, :k] if d2.shape[1] > k else np.broadcast_to(np.arange(k), (len(who), k))
        best[who], found[who] = np.take_along_axis(d2, keep, 1), np.take_along_axis(idx, keep, 1)
        read[who] += 1

    # down to the leaf each query belongs to, for a first bound
    at = np.zeros(n, np.int64)
    while (inner := np.flatnonzero(nodes[at, 3] >= 0)).size:
        here = nodes[at[inner]]
        d = np.sqrt(((queries[inner] - points[here[:, 2]]) ** 2).sum(1))
        near = d * 2 < halves[at[inner], 1] + halves[at[inner], 2]
        at[inner] = np.where(near, here[:, 3], here[:, 4])
    home = at.copy()
    for leaf in np.unique(home):
        meet(np.flatnonzero(home == leaf), leaf)
    todo = [(0, np.arange(n), np.zeros(n))]
    while todo:
        at, who, bound = todo.pop()
        stay = factor * bound <= np.sqrt(best[who].max(1)) + SLACK
        who = who[stay]
        if not who.size:
            continue
        start, end, vantage, near, far = nodes[at]
        if near < 0:
            who = who[home[who] != at]
            if who.size:
                meet(who, at)
            continue
        d = np.sqrt(((queries[who] - points[vantage]) ** 2).sum(1))
        lower = np.maximum(_bounds(d, halves[at]), bound[stay][:, None])
        # the nearer half of most queries is taken first
        sides = [(int(near), who, lower[:, 0]), (int(far), who, lower[:, 1])]
        todo += sides if lower[:, 0].sum() > lower[:, 1].sum() else sides[::-1]
    return found, best, read


INDEX = "shard long, nodes binary, halves binary, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score double"


def _build(columns: int, k: int):
    def build(key: tuple, g: pa.Table) -> pa.Table:
        m = matrix(g.column("v"), columns)
        order, nodes, halves = grow(unit(m))
        own = g.column("ids").combine_chunks()
        ids = np.full((len(m), k + 1), -1, np.int64)
        sizes = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ids[np.repeat(np.arange(len(m)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = own.flatten().to_numpy()
        # absent keys are told from negative ones by the sizes
        ids = np.hstack((sizes[:, None], ids))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "nodes": [nodes.tobytes()], "halves": [halves.tobytes()], "ids": [ids[order].tobytes()], "vectors": [m[order].tobytes()]})

    return build


def nearest(vectors: np.ndarray, ids: np.ndarray, nodes: np.ndarray, halves: np.ndarray, asked: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, key, score) of the k nearest rows of each query that are not its own."""
    # one point more, as one of them may be the query's own, and some to spare for rounding
    found, _, _ = search(unit(vectors), nodes, halves, unit(asked), k + 1 + SPARE, factor)
    scores, at = np.empty(found.shape), np.maximum(found, 0)
    a, b = halved(asked), halved(vectors)
    for j in range(found.shape[1]):
        scores[:, j] = cosines(a, b[at[:, j]])
    each = ids[at]
    keys, there = each[:, :, 1:], (np.arange(ids.shape[1] - 1) < each[:, :, :1]) & (found >= 0)[:, :, None] & (each[:, :, 1:] != own[:, None, None])
    scores, keys, there = (np.broadcast_to(x, keys.shape).reshape(len(asked), -1) for x in (scores[:, :, None], keys, there))
    ranked = np.lexsort((keys, -scores, ~there), axis=-1)[:, :k]
    keep = np.take_along_axis(there, ranked, 1)
    who = np.broadcast_to(np.arange(len(asked))[:, None], keep.shape)
    return who[keep], np.take_along_axis(keys, ranked, 1)[keep], np.take_along_axis(scores, ranked, 1)[keep]


def _ask(columns: int, k: int, factor: float):
    def ask(index: pa.Table, asked: pa.Table) -> pa.Table:
        own = asked.column("id").to_numpy()
        if not index.num_rows or not len(own):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        nodes, halves, ids, vectors = (index.column(x)[0].as_py() for x in ("nodes", "halves", "ids", "vectors"))
        who, keys, scores = nearest(
            np.frombuffer(vectors).reshape(-1, columns), np.frombuffer(ids, np.int64).reshape(-1, k + 2), np.frombuffer(nodes, np.int64).reshape(-1, 5),
            np.frombuffer(halves).reshape(-1, 4), matrix(asked.column("v"), columns), own, k, factor)
        return pa.table({"query_id": own[who], "vec_id": keys, "score": scores})

    return ask


def neighbours(df: DataFrame, key: str, vec: str, asked, k: int = 5, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows by cosine of every row that `asked`, a condition on the table, names; never its own key.

    Keys are whole numbers. Rows whose key is null, or whose vector is null, zero, empty or holds a null or non-finite component take no part. Of rows that
    share a key the one with the smallest vector counts. Shorter vectors count as ending in zeros. With fewer than k other
    rows all are returned; without rows, none. Ties go to the smaller key. Other columns are not looked at.
    """
    taken = df.where(F.col(key).isNotNull() & usable(vec)).where(F.exists(F.col(vec), lambda x: x.cast("double") != 0))
    marked = taken.select(F.col(key).cast("long").alias("id"), entries(vec).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = materialize(marked.groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked")), "vectors")
    columns = width(rows, "v")
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    points = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    wide = 8 * max(columns, 1)
    shards = max(1, -(-points.count() * wide // SHARD_BYTES))
    groups = max(1, -(-rows.where("asked").count() * wide // QUERY_BYTES))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)))
    index = materialize(dealt.groupBy("shard").applyInArrow(_build(columns, k), INDEX), "vantage-trees")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    questions = rows.where("asked").select("id", "v", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("part"), everywhere)
    trees = index.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"))
    found = trees.groupBy("shard", "part").cogroup(questions.groupBy("shard", "part")).applyInArrow(_ask(columns, k, factor), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP12_SQL = """
WITH t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM t WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) / (q.norm * c.norm) AS score FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op12_vantage_point_ann", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(table(spark, folder, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)
