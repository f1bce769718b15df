"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is split by the tokenizer's pattern; each match is encoded by itself. Every byte position of a match that starts a live piece
holds the rank of that piece joined with the next one. A segment tree keeps the smallest (rank, position), so its root is the
leftmost pair of least rank; a merge updates the leaves of the merged piece, of the vanished one and of the left neighbour,
each along one path to the root. A match of n bytes takes O(n log n), also where it is a single run of millions of letters.

Short matches that were not seen before are merged many at a time: the same trees as rows of one table, one merge of every row per step.

Ranks are read on the driver and broadcast: a vocabulary file of fixed size. Texts stream through Arrow batches, about CHUNK characters at a time;
a worker remembers the ids of short matches it has seen, in a dictionary that starts anew once it has REMEMBER of them.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import query, table

#: Characters encoded together; matches remembered, and the longest that is.
CHUNK, REMEMBER, SHORT = 1 << 20, 250_000, 48
NO_PAIR = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match; its bytes must all be tokens."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    shift, tree = size.bit_length(), [NO_PAIR] * (2 * size)
    mask = (1 << shift) - 1
    # a live piece starts at i and ends before after[i]; before[i] is the start of the piece left of it
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = (rank << shift) | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    get = ranks.get
    while (top := tree[1]) != NO_PAIR:
        i = top & mask
        j, p = after[i], before[i]
        k = after[i] = after[j]
        # three leaves change: the merged piece, the vanished one, and the left neighbour
        tree[size + j] = tree[size + i] = NO_PAIR
        if k < n:
            before[k] = i
            rank = get(piece[i : after[k]])
            if rank is not None:
                tree[size + i] = (rank << shift) | i
        if p >= 0:
            rank = get(piece[p:k])
            tree[size + p] = NO_PAIR if rank is None else (rank << shift) | p
        else:
            p = i
        # their paths to the root, level by level; where paths meet they go on as one
        x, y, z = (size + p) >> 1, (size + i) >> 1, (size + j) >> 1
        while z:
            a, b = tree[2 * z], tree[2 * z + 1]
            tree[z] = a if a < b else b
            if y != z:
                a, b = tree[2 * y], tree[2 * y + 1]
                tree[y] = a if a < b else b
            if x != y:
                a, b = tree[2 * x], tree[2 * x + 1]
                tree[x] = a if a < b else b
            x, y, z = x >> 1, y >> 1, z >> 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Merger:
    """The same merges for many matches at once: one row of a tree table per match, one merge of every row per step."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        joined = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs = np.array(sorted(joined), np.int64).reshape(-1, 2)
        self.pair, self.rank = np.append(pairs[:, 0], NO_PAIR), np.append(pairs[:, 1], 0)

    def leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, real: np.ndarray) -> np.ndarray:
        """(rank, position) of the joined tokens, NO_PAIR where they do not join or are not real."""
        key = left << 32 | right
        place = np.searchsorted(self.pair, key)
        return np.where(real & (self.pair[place] == key), self.rank[place] << 6 | at, NO_PAIR)

    def rows(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """Ids of matches of at most `size` bytes, a power of two up to 64."""
        w, step = len(pieces), np.arange(size)
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(w, size)
        n = np.fromiter(map(len, pieces), np.int64, w)
        ids, live = self.single[raw], step < n[:, None]
        after, before = np.tile(step + 1, (w, 1)), np.tile(step - 1, (w, 1))
        tree = np.full((w, 2 * size), NO_PAIR, np.int64)
        tree[:, size:-1] = self.leaf(ids[:, :-1], ids[:, 1:], step[:-1], step[1:] < n[:, None])
        k = size
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        flat, rows = tree.reshape(-1), np.arange(w)
        while True:
            top = tree[rows, 1]
            rows, top = rows[top != NO_PAIR], top[top != NO_PAIR]
            if not len(rows):
                break
            i, token = top & 63, top >> 6
            j, p = after[rows, i], before[rows, i]
            k = after[rows, j]
            ids[rows, i], after[rows, i], live[rows, j] = token, k, False
            more, less = k < n[rows], p >= 0
            before[rows[more], k[more]] = i[more]
            base = rows * (2 * size)
            flat[base + size + j] = NO_PAIR
            flat[base + size + i] = self.leaf(token, ids[rows, np.minimum(k, size - 1)], i, more)
            q = np.where(less, p, i)
            value = self.leaf(ids[rows, q], token, q, less)
            flat[(base + size + q)[less]] = value[less]
            for node in ((size + j) >> 1, (size + i) >> 1, (size + q) >> 1):
                while node[0]:
                    at = base + node
                    flat[at] = np.minimum(flat[at + node], flat[at + node + 1])
                    node = node >> 1
        tokens, ends = ids[live].tolist(), np.cumsum(live.sum(1)).tolist()
        return [tokens[a:b] for a, b in zip([0, *ends], ends)]

    def many(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for at, x in enumerate(pieces):
            whole = self.ranks.get(x)
            if whole is not None:
                out[at] = [whole]
            elif len(x) > 64:
                out[at] = merge(x, self.ranks)
            else:
                classes.setdefault(max(4, 1 << (len(x) - 1).bit_length()), []).append(at)
        for size, places in classes.items():
            for start in range(0, len(places), 1 << 14):
                some = places[start : start + (1 << 14)]
                for at, ids in zip(some, self.rows([pieces[at] for at in some], size)):
                    out[at] = ids
        return out


class Encoder:
    """Ids of texts; the ids of matches are remembered from batch to batch."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split, self.merger, self.seen = regex.compile(pattern).findall, Merger(ranks), {}

    def encode_all(self, texts: list) -> list[np.ndarray]:
        out, start = [], 0
        while start < len(texts):
            parts, chars = [], 0
            while start < len(texts) and (not parts or chars < CHUNK):
                parts.append(self.split(texts[start] or ""))
                chars += len(texts[start] or "")
                start += 1
            if len(self.seen) > REMEMBER:
                self.seen.clear()
            new = list(set(chain.from_iterable(parts)).difference(self.seen))
            fresh = dict(zip(new, self.merger.many([x.encode("utf-8", "surrogatepass") for x in new])))
            self.seen.update((k, v) for k, v in fresh.items() if len(k) <= SHORT)
            long = {k: v for k, v in fresh.items() if len(k) > SHORT}
            find = self.seen.__getitem__ if not long else (lambda k: long[k] if k in long else self.seen[k])
            out += [np.fromiter(chain.from_iterable(map(find, x)), np.int32) for x in parts]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]


_encoders: dict = {}


def _encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """The worker's encoder for these ranks, kept from task to task."""
    key = (id(ranks), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def encode(docs: DataFrame, text: str, ranks: dict[bytes, int], pattern: str, name: str) -> DataFrame:
    """Add the array `name` of token ids to every row; null and empty texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        encoder = _encoder(shared.value, pattern)
        return pd.Series(encoder.encode_all(list(texts)))

    # said to be non-deterministic, or Spark would evaluate it anew inside every function of its result
    return docs.withColumn(name, ids.asNondeterministic()(F.col(text)))


def decode(docs: DataFrame, ids: str, ranks: dict[bytes, int], name: str) -> DataFrame:
    """Add the bytes `name` that the ids stand for; a null array gives null, an unknown id stops the run."""
    shared = docs.sparkSession.sparkContext.broadcast({v: k for k, v in ranks.items()})

    @F.pandas_udf(T.BinaryType())
    def raw(arrays: pd.Series) -> pd.Series:
        find = shared.value.__getitem__
        return pd.Series([None if a is None else b"".join(map(find, a.tolist())) for a in arrays])

    return docs.withColumn(name, raw(F.col(ids)))


@F.pandas_udf(T.StringType())
def ids_digest(arrays: pd.Series) -> pd.Series:
    """SHA-256 of the ids as little-endian unsigned 32-bit integers."""
    return pd.Series([hashlib.sha256(a.astype("<u4").tobytes()).hexdigest() for a in arrays])


@query("op9_byte_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = encode(table(spark, folder, "documents").select("doc_id", "text"), "text", ranks, public_tokenizers.PATTERN, "ids")
    out = decode(docs.drop("text"), "ids", ranks, "raw")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest("ids").alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
