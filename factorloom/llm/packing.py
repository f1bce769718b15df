"""Best-fit packing of documents into bins of a fixed length, with conflicts.

Items are taken from long to short. The bins of a shard are kept in order of what is left in them, and each carries a bitmap of its sources and one of
its duplicate clusters. An item looks up the first bin with room enough and goes on to the successors until one has neither its source nor
its cluster; that is the tightest compatible bin. If there is none it opens a bin.

Shards: items are dealt by hash of their key, cluster and length into as many shards as rows and lengths ask for (SHARD_ROWS, SHARD_BINS), so a
shard stays small, and a source or cluster with a third of all rows is spread over all of them. Bins belong to one
shard, so conflicts need no look beyond it. Only narrow rows are grouped; texts stay where they are.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import ascii_lower, query, table

CAPACITY, SHARD_ROWS, SHARD_BINS = 2048, 4096, 2048


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and start of each item, items in the order given; -1 is no source or no cluster, others count from 0."""
    order: list[tuple[int, int]] = []  # (room left, bin)
    seen: list[list[int]] = []  # bitmaps of a bin
    bins, starts = [], []
    for length, source, cluster in zip(lengths, sources, clusters):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(order, (length, -1))
        while at < len(order) and (seen[order[at][1]][0] & s or seen[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(seen)
            seen.append([0, 0])
        seen[b][0] |= s
        seen[b][1] |= c
        insort(order, (room - length, b))
        bins.append(b)
        starts.append(capacity - room)
    return bins, starts


def _places(values: pd.Series, shared_only: bool) -> list[int]:
    """Bit number per value, -1 for null (and, if shared_only, for values that occur once)."""
    if shared_only:
        values = values.where(values.duplicated(keep=False))
    return pd.factorize(values)[0].tolist()


def pack(items: DataFrame, key: str, length: str, source: str, cluster: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, length, shard, bin, start): a row per piece of every row of items.

    An item longer than the capacity is cut into full pieces, which fill a bin each, and a rest. A bin holds no two items of one source
    and no two of one cluster; null is neither. Null lengths count as 0, and items of length 0 take the tightest compatible bin as well.
    Of equal lengths the smaller key comes first, null before all; repeated rows are items of their own. Other columns are not looked at.
    """
    rows = items.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long").alias("len"), F.col(source).cast("string").alias("s"), F.col(cluster).cast("string").alias("c"))
    rows = materialize(rows, "items")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("t")).first()
    shards = max(1, -(-total["n"] // SHARD_ROWS), -(-total["t"] // (SHARD_BINS * capacity)))
    last = F.greatest(F.ceil(F.col("len") / capacity).cast("long") - 1, F.lit(0))
    cut = rows.withColumns({"shard": F.pmod(F.xxhash64("k", "c", "len"), F.lit(shards)), "full": last, "rest": F.col("len") - last * capacity})
    # keys are ranked by Spark in their own order, and pass through pandas as text
    cut = cut.withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy("k", "len", "s", "c")))
    kind = dict(rows.dtypes)["k"]

    def fill(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["rest", "rank"], ascending=[False, True], kind="stable")
        bins, starts = best_fit(g["rest"].tolist(), _places(g["s"], False), _places(g["c"], True), capacity)
        some = pd.DataFrame({"k": g["k"], "piece": g["full"], "length": g["rest"], "shard": g["shard"], "bin": bins, "start": starts})
        # full pieces come first and have bins of their own
        whole = g.loc[g.index.repeat(g["full"]), ["k", "shard"]]
        whole = whole.assign(piece=whole.groupby(level=0).cumcount(), length=capacity, bin=range(max(bins) + 1, max(bins) + 1 + len(whole)), start=0)
        return pd.concat([some, whole[list(some.columns)]])

    out = cut.withColumn("k", F.col("k").cast("string")).groupBy("shard").applyInPandas(fill, "k string, piece long, length long, shard long, bin long, start long")
    return out.select(F.col("k").cast(kind).alias(key), "piece", "length", "shard", "bin", "start")


def words(text: str):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def pack_documents(docs: DataFrame, key: str, text: str, source: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack by words of whole texts; equal texts (A-Z lower-cased) are one duplicate cluster, texts without a word are in none."""
    items = docs.select(F.col(key), F.col(source), words(text).alias("_words"), F.xxhash64(ascii_lower(text)).alias("_cluster"))
    items = items.withColumn("_cluster", F.when(F.col("_words") > 0, F.col("_cluster")))
    return pack(items, key, "_words", source, "_cluster", capacity)


@query("op7_best_fit_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source")
