"""Quality rules whose cutoffs carry a guarantee: labelled holdouts, exact binomial bounds, correction for many tests.

For each rule and stratum a fixed grid of cutoffs is tried on the labelled rows. A cutoff may be used only if the exact
(Clopper-Pearson) upper bound of its false rejection rate, at level delta / (strata x rules), is at most alpha / rules. Within
a grid the cutoffs are tested in fixed sequence from lax to strict; a stricter one rejects no fewer rows, so the
sequence stops by itself and needs no further correction. So with probability 1 - delta, in every stratum at once, all rules together reject at most alpha of the good rows.
Among the cutoffs that may be used, the one with the most bad rows rejected, less `COST` per good row rejected, is taken;
if none may, the rule rejects nothing in that stratum.

Counting words is Python over Arrow batches, one text at a time. All sums are grouped aggregates of a few integers
per row; the table of cutoffs has strata x rules rows and is counted before it is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import fresh, query, sized, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
STAT_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
STATS = T.StructType([T.StructField(x, T.LongType()) for x in STAT_NAMES])
#: Rule: (numerator, denominator, grid); a row is rejected if 100 * numerator > cutoff * denominator.
RULES = {
    "symbols": ("n_symbols", "n_words", (5, 10, 20, 30, 40, 50, 60, 80)),
    "upper": ("n_upper", "word_chars", (20, 30, 40, 50, 60, 80)),
    "dup_lines": ("n_dup_lines", "n_lines", (10, 20, 30, 40, 50, 70)),
    "repeats": ("n_repeat_words", "n_words", (3, 5, 8, 12, 15)),
}
ALPHA, DELTA, COST = 0.02, 0.05, 20


def repeated_words(words: list, width: int = 5) -> int:
    """Words that stand in a window of `width` words which occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, width):
        size = len(seen)
        if int(key.max()) >= (2**62) // size:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * size + ids[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_stats(text: str | None) -> tuple:
    """The numbers of STATS for one text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six blanks above
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), len(raw) - len(raw.translate(None, UPPER)),
    )


@F.pandas_udf(STATS)
def _stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([text_stats(x) for x in batch], columns=list(STAT_NAMES), dtype="int64")


def with_stats(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Add the struct `name` of STATS."""
    return docs.withColumn(name, _stats(F.col(text)))


def base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < 10) | (100 * F.col(f"{s}.n_repeat_words") > 20 * F.col(f"{s}.n_words"))


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p): summed downwards from k until terms vanish; 1 where k is above the mean."""
    if n == 0 or k >= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, j = term, k
    while j > 0 and term > total * 1e-17:
        term *= j / (n - j + 1) * (1 - p) / p
        total, j = total + term, j - 1
    return min(1.0, total)


@F.pandas_udf(T.DoubleType())
def _tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([tail(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)])


def cutoffs(labelled: DataFrame, s: str, stratum: str, good: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, <rule>...): the cutoff of each rule per stratum, null where none may be used.

    labelled has the struct `s` of STATS, the stratum (null is a stratum of its own) and the boolean `good`; rows
    without a label are left out. Rows that the base rule rejects are left out, as no cutoff decides over them.
    """
    rows = labelled.where(F.col(good).isNotNull() & ~base_failed(s)).select(F.col(stratum).alias("stratum"), F.col(good).alias("good"), f"{s}.*")
    sums = [F.sum(F.col("good").cast("long")).alias("n")]
    for rule, (num, den, grid) in RULES.items():
        for c in grid:
            hit = 100 * F.col(num) > c * F.col(den)
            sums += [F.sum((hit & F.col("good")).cast("long")).alias(f"{rule}_{c}_g"), F.sum((hit & ~F.col("good")).cast("long")).alias(f"{rule}_{c}_b")]
    counts = materialize(rows.groupBy("stratum").agg(*sums), "holdout-counts")
    tests = max(1, counts.count()) * len(RULES)
    tried = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{c}_g").alias("k"), F.col(f"{r}_{c}_b").alias("bad")) for r, (_, _, g) in RULES.items() for c in g]))
    flat = counts.select("stratum", "n", tried.alias("t")).select("stratum", "n", "t.*")
    ok = flat.where(_tail("k", "n", F.lit(alpha / len(RULES))) <= delta / tests)
    return ok.groupBy("stratum").agg(*[best_of(rule) for rule in RULES])


def best_of(rule: str) -> Column:
    gain = F.col("bad") - COST * F.col("k")
    mine = (F.col("rule") == rule) & (gain > 0)
    return F.max_by(F.when(mine, F.col("cutoff")), F.when(mine, F.struct(gain, "cutoff"))).alias(rule)


def judge(docs: DataFrame, s: str, stratum: str, limits: DataFrame, kept: str, reason: str) -> DataFrame:
    """Add `kept` and `reason` (the first rule that rejects, `base` before all others, else null). Further columns may have any name but these two."""
    of, limit = fresh(docs, "_limit_of", "_limit")
    limits = limits.select(F.struct("stratum").alias(of), F.struct(*RULES).alias(limit))
    j = docs.join(sized(limits, 200), F.struct(F.col(stratum).alias("stratum")) == F.col(of), "left")
    why = F.when(base_failed(s), F.lit("base"))
    for rule, (num, den, _) in RULES.items():
        why = why.when(100 * F.col(f"{s}.{num}") > F.col(f"{limit}.{rule}") * F.col(f"{s}.{den}"), F.lit(rule))
    return j.withColumn(reason, why).withColumn(kept, F.col(reason).isNull()).drop(of, limit)


def one_label(labels: DataFrame, key: str, value: str) -> DataFrame:
    """(key, good): one row per key; rows without key or label are left out, and a key with both labels counts as good."""
    return labels.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("_label_key")).agg((F.max(value) > 0).alias("_good"))


def filter_quality(docs: DataFrame, key: str, text: str, stratum: str, labels: DataFrame, value: str = "quality") -> DataFrame:
    """The rows of docs that the base rule and the guaranteed rules keep, with their own columns.

    Null and empty texts have no words and go; very long ones are read whole. Columns of docs may have any names. Repeated rows share their verdict. An empty docs or labels table is fine: without labels
    no cutoff may be used and only the base rule rejects.
    """
    s, kept, reason = fresh(docs, "_stats", "_kept", "_reason")
    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(stratum).alias("_stratum"))
    marked = plain.join(one_label(labels, key, value), F.col("_key") == F.col("_label_key"))
    held = materialize(with_stats(marked, "_text", "_s").select("_stratum", "_good", "_s"), "holdout")
    limits = materialize(cutoffs(held, "_s", "_stratum", "_good"), "cutoffs")
    return judge(with_stats(docs, text, s), s, stratum, limits, kept, reason).where(kept).select(*docs.columns)


@query("op2_quality_rules")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    rows = materialize(with_stats(docs, "text", "s").select("doc_id", "lang", "s"), "text-stats")
    held = rows.join(one_label(table(spark, folder, "labels"), "doc_id", "quality"), F.col("doc_id") == F.col("_label_key"))
    limits = materialize(cutoffs(held, "s", "lang", "_good"), "cutoffs")
    out = judge(rows, "s", "lang", limits, "kept", "reason")
    return out.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", base_failed("s").alias("base_failed"), "kept", "reason")
