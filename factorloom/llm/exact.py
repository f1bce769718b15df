"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash.

Each step only looks at rows whose group still has two members. All grouping sums map-side, so a
text that a third of all rows share is one row per task; the answer comes back to the rows
through joins on tables with one row per group, which AQE splits or which are broadcast when their
measured size allows it. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import ascii_lower, fresh, query, sized, table

PREFIX_CHARS = 128


def normal(text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def refine(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Add keep_id, group_size, kept and full_hash to every row of docs; rows and columns stay as they are.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest key of a group stays
    (`keep_id`); a null key loses to any other, and a group with null keys only has a null keep_id and keeps them.
    Repeated rows (same key and text) share one verdict. full_hash is null where the first two steps already showed
    that the text is unique. Clashing names get a trailing underscore.
    """
    length = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    # whole code points, so that a prefix of the normalised text is the normalised prefix
    prefix = F.xxhash64(ascii_lower(F.substring(F.coalesce(F.col(text), F.lit("")), 1, PREFIX_CHARS)))
    first = materialize(docs.select(length.alias("n"), prefix.alias("p")).groupBy("n", "p").count(), "length-prefix")
    shared = first.groupBy("n").agg(F.sum("count").alias("c")).where("c > 1").select("n")
    second = materialize(first.join(shared, "n", "left_semi").where("count > 1").select("n", "p"), "survivors")
    n, p, flag, keep, size, kept, full = fresh(docs, "_n", "_p", "_alive", "keep_id", "group_size", "kept", "full_hash")
    alive = sized(second.select(F.col("n").alias(n), F.col("p").alias(p), F.lit(True).alias(flag)), 48)
    rows = docs.withColumns({n: length, p: prefix}).join(alive, [n, p], "left")
    rows = rows.withColumn(full, F.when(F.col(flag), F.sha2(normal(text), 256))).drop(n, p, flag)
    groups = materialize(
        rows.where(F.col(full).isNotNull()).groupBy(full).agg(F.max(key).alias(keep), F.count(F.lit(1)).alias(size)).where(F.col(size) > 1), "copies")
    out = rows.join(sized(groups, 160), full, "left")
    alone = F.col(size).isNull()
    return out.select(
        *docs.columns, F.when(alone, F.col(key)).otherwise(F.col(keep)).alias(keep), F.coalesce(size, F.lit(1)).cast("long").alias(size),
        (alone | F.col(key).eqNullSafe(F.col(keep))).alias(kept), F.col(full),
    )


def drop_copies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per text: the kept rows of `refine`, and of rows repeated with the same key just one."""
    kept, size, full = fresh(docs, "kept", "group_size", "full_hash")
    stay = refine(docs, key, text).where(kept)
    # every copy of a text has its full hash; rows without one are alone and stay apart by their key and text
    single = stay.where(F.col(size) == 1)
    many = stay.where(F.col(size) > 1).dropDuplicates([full])
    return single.unionByName(many).select(*docs.columns)


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


@query("op6_exact_dedup", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = refine(docs, "doc_id", "text")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.coalesce("full_hash", F.sha2(normal("text"), 256)).alias("text_sha256"))
