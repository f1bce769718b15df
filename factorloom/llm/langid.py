"""Language identification by nearest centroid, with rejection by distance.

A text becomes a vector of hashed letter n-grams (one to three letters, words padded by a blank), weighted
(1 + log count) x inverse document frequency and scaled to length 1. Each language has several centroids, found by
clustering; a text gets the language of the centroid with the largest cosine. It is rejected if it has no
letter, or if it has at least 2^(FIRST_BUCKET - 1) letters and lies farther from its centroid than TAIL of the learned texts of its
language and about its length do, plus MARGIN; shorter texts are too noisy to be rejected for their distance.

Document frequencies and distance limits come from every learned row: each task adds up one array of DIMS counts, and then one of
distances per language and length. Only centroids are clustered on a bounded sample: about SAMPLE rows per language, drawn by hash of the key, so
the driver holds at most SAMPLE x languages vectors. The model is DIMS x (CLUSTERS x languages + 1) floats, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import fresh, query, sized, table

DIMS, SAMPLE, CLUSTERS, MARGIN, NONE, MOST_LABELS = 8192, 400, 3, 0.15, "und", 1000
#: Texts whose number of letters has as many bits share a distance limit per language; a limit of its own needs so many learned texts.
BUCKETS, FIRST_BUCKET, LEAST = 24, 7, 100
#: The share of learned texts below the limit without the margin; distances are counted in so many steps from 0 to 1.
TAIL, STEPS = 0.99, 1000
ONE = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


@cache
def _letters() -> np.ndarray:
    """Per code point: is it a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None, dims: int = DIMS) -> tuple[np.ndarray, int]:
    """Counts of hashed n-grams over the whole text, and its number of letters."""
    a = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[a]
    n = int(letter.sum())
    if not n:
        return np.zeros(dims, np.int64), 0
    a = np.where(letter, a, 32).astype(np.uint32)
    a = np.concatenate(([32], a, [32])).astype(np.uint32)
    a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))]
    two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + a[2:] * np.uint32(0x27D4EB2F)
    grams = np.concatenate((a[a != 32] * np.uint32(0x165667B1), two ^ np.uint32(0x5BD1E995), three))
    return np.bincount((grams ^ (grams >> np.uint32(15))) % np.uint32(dims), minlength=dims), n


def _weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the vector of length 1."""
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    return at, v / max(np.sqrt((v * v).sum()), 1e-12)


def document_frequencies(docs: DataFrame, text: str, dims: int = DIMS) -> np.ndarray:
    """Rows that hold each n-gram, over all rows; the last place counts the rows."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(dims + 1, np.int64)
        for batch in batches:
            for x in batch[text]:
                counts, n = ngram_counts(x, dims)
                if n:
                    total[:-1] += counts > 0
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    out = np.zeros(dims + 1, np.int64)
    for r in docs.select(text).mapInPandas(add, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def sample_rows(docs: DataFrame, key: str, text: str, label: str, size: int = SAMPLE) -> DataFrame:
    """About `size` rows of each label, by hash of key and text: the same rows whatever the partitions. Rows that repeat both count once.

    So a key or a text that very many rows share takes one place, and as there may be MOST_LABELS labels at most (more raise an error), the sample is bounded.
    """
    one = docs.select(F.col(key).alias("k"), F.col(text).alias("x"), F.col(label).alias("l"), F.xxhash64(F.lit(3), F.col(key), F.col(text)).alias("h"))
    counts = materialize(one.groupBy("l").agg(F.approx_count_distinct("h", 0.01).alias("n")), "label-counts")
    labels = counts.count()
    if labels > MOST_LABELS:
        raise ValueError(f"{labels} labels; a model of languages takes {MOST_LABELS}")
    drawn = one.join(sized(counts.withColumnRenamed("l", "_l"), 100), F.col("l") == F.col("_l")).where(F.pmod("h", F.lit(1 << 40)) < F.lit(float(1 << 40)) * size / F.col("n"))
    return drawn.dropDuplicates(["l", "h"]).select(F.col("x").alias(text), F.col("l").alias(label))


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with farthest-first seeds; rows of x have length 1."""
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    c = x[seeds]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        c = np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _bucket(n: int) -> int:
    return min(BUCKETS - 1, int(n).bit_length())


def fit(docs: DataFrame, key: str, text: str, label: str, dims: int = DIMS, sample: int = SAMPLE, clusters: int = CLUSTERS) -> dict:
    """The model: idf, centroids, their languages, and the distance limits per language and length bucket.

    Learns from rows with a label, a key and a letter in the text; without any, the model knows no language.
    """
    rows = docs.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(text).isNotNull()).select(key, text, label)
    found = document_frequencies(rows, text, dims)
    idf = (np.log((1 + found[-1]) / (1 + found[:-1])) + 1).astype(np.float32)
    vector = T.StructType([T.StructField("at", T.BinaryType()), T.StructField("v", T.BinaryType()), T.StructField("n", T.LongType())])

    @F.pandas_udf(vector)
    def vectors(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            counts, n = ngram_counts(x, dims)
            at, v = _weigh(counts, idf)
            out.append((at.astype(np.int32).tobytes(), v.astype(np.float32).tobytes(), n))
        return pd.DataFrame(out, columns=["at", "v", "n"])

    by: dict[str, list] = {}
    for r in sample_rows(rows, key, text, label, sample).select(label, vectors(text).alias("x")).orderBy(label, "x.n", "x.v").collect():
        if r["x"]["n"]:
            by.setdefault(r[label], []).append(r["x"])
    parts, langs = [], []
    for lang in sorted(by):
        x = np.zeros((len(by[lang]), dims), np.float32)
        for i, r in enumerate(by[lang]):
            x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["v"], np.float32)
        c = _cluster(x, clusters)
        parts.append(c)
        langs += [lang] * len(c)
    model = {"idf": idf, "centroids": np.concatenate(parts) if parts else np.zeros((0, dims), np.float32), "langs": langs, "dims": dims}
    return model | {"limits": distance_limits(distances(rows, text, model)) if langs else {}}


def distances(docs: DataFrame, text: str, model: dict) -> dict[str, np.ndarray]:
    """Per language of the nearest centroid, the rows at each length bucket and distance (in STEPS, rounded up), over all rows."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), sorted(set(model["langs"]))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), BUCKETS, STEPS + 1), np.int64)
        for batch in batches:
            for x in batch[text]:
                lang, score, n = nearest(shared.value, x)
                if n:
                    total[names.index(lang), _bucket(n), int(np.ceil((1 - score) * STEPS))] += 1
        lang, bucket, step = np.nonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": bucket, "step": step, "n": total[lang, bucket, step]})

    out = {x: np.zeros((BUCKETS, STEPS + 1), np.int64) for x in names}
    found = docs.select(text).mapInPandas(add, "lang int, bucket int, step int, n long").groupBy("lang", "bucket", "step").agg(F.sum("n").alias("n"))
    for r in found.collect():
        out[names[r["lang"]]][r["bucket"], r["step"]] = r["n"]
    return out


def _limit(counts: np.ndarray) -> float:
    """The distance below which TAIL of the counted texts lie, between neighbours in proportion, plus MARGIN."""
    ends, place = np.cumsum(counts), (counts.sum() - 1) * TAIL
    low, high = (int(np.searchsorted(ends, rank, "right")) for rank in (np.floor(place), np.ceil(place)))
    return min(1.0, (low + (high - low) * (place - np.floor(place))) / STEPS + MARGIN)


def distance_limits(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Limit per language and length bucket; 1, which rejects nothing, only below FIRST_BUCKET and where no learned text is as long as that.

    A bucket with fewer than LEAST learned texts takes the limit of the nearest bucket of its language that has as many, of two the shorter
    one; a language without any goes by the texts of all languages, and where those are too few as well, by all lengths together.
    """

    def filled(counts: np.ndarray) -> dict[int, float]:
        return {b: _limit(counts[b]) for b in range(FIRST_BUCKET, BUCKETS) if counts[b].sum() >= LEAST}

    every, out = sum(found.values()), {}
    long = every[FIRST_BUCKET:].sum(0)
    for lang, counts in found.items():
        limits = filled(counts) or filled(every) or {FIRST_BUCKET: _limit(long) if long.any() else 1.0}
        out[lang] = np.ones(BUCKETS)
        for b in range(FIRST_BUCKET, BUCKETS):
            out[lang][b] = limits[min(limits, key=lambda x: (abs(x - b), x))]
    return out


def nearest(model: dict, text: str | None) -> tuple[str, float, int]:
    """Language and cosine of the nearest centroid, and the letters of one text; without a letter or any centroid, NONE and 0."""
    counts, n = ngram_counts(text, model["dims"])
    if not n or not model["langs"]:
        return NONE, 0.0, 0
    at, v = _weigh(counts, model["idf"])
    cos = model["centroids"][:, at] @ v
    best = int(np.argmax(cos))
    return model["langs"][best], float(min(1.0, max(0.0, cos[best]))), n


def decide(model: dict, text: str | None) -> tuple[str, float, bool]:
    """Language, cosine and rejection of one text."""
    lang, score, n = nearest(model, text)
    return lang, score, not n or bool(1 - score > model["limits"][lang][_bucket(n)])


def predict(docs: DataFrame, text: str, model: dict, name: str) -> DataFrame:
    """Add the struct `name` (lang_pred, score, rejected) to every row.

    Null texts and texts without a letter get `und`, score 0 and are rejected. Only the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(ONE)
    def one(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decide(shared.value, x) for x in texts], columns=["lang_pred", "score", "rejected"])

    return docs.withColumn(name, one(F.col(text)))


def fold(key) -> Column:
    """crc32 of the key as text, modulo 5; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def keep_known(docs: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """The rows whose text is not rejected, with their own columns; learned from the rows whose fold is not 0.

    Repeated rows share their fate. Where no row has a label nothing can be learned and all rows stay.
    """
    model = fit(docs.where(fold(key) != 0), key, text, label)
    if not model["langs"]:
        return docs
    (name,) = fresh(docs, "_language")
    return predict(docs, text, model, name).where(~F.col(f"{name}.rejected")).select(*docs.columns)


@query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold("doc_id") != 0), "doc_id", "text", "lang")
    out = predict(docs, "text", model, "p")
    return out.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "p.lang_pred", "p.score", "p.rejected")
