"""Line de-duplication: lines that many documents share are dropped from all of them.

Method: explode the normalised lines, hash them, count documents per hash, drop the lines of hashes
over the threshold, reassemble the rest by position.

Skew: a document counts a line once, so its distinct hashes are exploded and summed map-side; a line
that every document has is one row per task. The rows of a hot line meet the list of common lines in
a join that AQE splits (or in a broadcast of that list, if it is measured to be small).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import ascii_lower, fresh, query, sized, table

#: The characters stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def key_hash(key: Column) -> Column:
    """128 bits as two longs; the seeds differ through a leading constant."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(text: Column) -> Column:
    """Hash per line in order; null for lines whose key is empty."""
    keys = F.transform(_lines(ascii_lower(text)), line_key)
    return F.transform(keys, lambda k: F.when(k != "", key_hash(k)))


def common_lines(docs: DataFrame, text: str, min_docs: int) -> DataFrame:
    """(h): hashes of line keys found in at least `min_docs` rows."""
    own = F.array_distinct(F.array_compact(_hashes(F.col(text))))
    return docs.select(F.explode(own).alias("h")).groupBy("h").count().where(F.col("count") >= min_docs).select("h")


def dedup_lines(docs: DataFrame, key: str, text: str, min_docs: int = 10) -> DataFrame:
    """Add n_lines, n_dropped and kept_text to every row.

    Each row is a document: repeated rows count as often as they occur and each comes back. A null text
    is one empty line. Empty keys are never dropped. Rows that share a `key`, null included, are
    still judged line by line, as a hash is common or not whatever row it stands in.
    """
    n_lines, n_dropped, kept = fresh(docs, "n_lines", "n_dropped", "kept_text")
    bad, ref = fresh(docs, "_bad", "_ref")
    hashes = materialize(docs.select(F.col(key).alias("k"), F.array_distinct(F.array_compact(_hashes(F.col(text)))).alias("hs")).where(F.size("hs") > 0), "line-hashes")
    exploded = hashes.select("k", F.explode("hs").alias("h"))
    common = materialize(exploded.groupBy("h").count().where(F.col("count") >= min_docs).select("h"), "common-lines")
    hits = exploded.join(sized(common, 64), "h", "left_semi")
    marks = materialize(hits.groupBy(F.col("k").alias(ref)).agg(F.collect_set("h").alias(bad)), "line-marks")
    # the marks grow with the documents, so they are never broadcast
    j = docs.hint("merge").join(marks.hint("merge"), docs[key].eqNullSafe(marks[ref]), "left").drop(ref)
    lines = F.arrays_zip(_lines(F.col(text)).alias("l"), _hashes(F.col(text)).alias("h"))
    stay = F.filter(lines, lambda x: x["h"].isNull() | ~F.array_contains(F.col(bad), x["h"]))
    texts = F.when(F.col(bad).isNull(), _lines(F.col(text))).otherwise(F.transform(stay, lambda x: x["l"]))
    j = j.withColumn(kept, texts).withColumn(n_lines, F.size(_lines(F.col(text))).cast("long"))
    return j.withColumn(n_dropped, F.col(n_lines) - F.size(kept)).withColumn(kept, F.concat_ws("\n", kept)).drop(bad)


OP8_SQL = r"""
WITH l AS (
  SELECT d.rn, d.doc_id, u.pos, u.line, translate(trim(u.line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_number() OVER () AS rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d,
       LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS pos) u
), c AS (SELECT k FROM (SELECT DISTINCT rn, k FROM l WHERE k <> '') GROUP BY k HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN c USING (k) GROUP BY rn, doc_id
"""


@query("op8_line_dedup", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = dedup_lines(docs, "doc_id", "text", 10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
