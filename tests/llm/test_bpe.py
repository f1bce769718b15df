"""Byte-level BPE against the tiktoken library and exact round trips."""

import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.llm import bpe
from factorloom.llm.common import QUERIES

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    ids = bpe.Encoder(RANKS, public_tokenizers.PATTERN).encode(text).tolist()
    assert ids == OTHER.encode_ordinary(text)
    assert OTHER.decode_bytes(ids) == text.encode()


def test_every_code_point(encoder):
    for start in range(0, 0x110000, 64):
        text = "".join(f"a{chr(i)} {chr(i)}" for i in range(start, start + 64) if not 0xD800 <= i < 0xE000)
        assert encoder.encode(text).tolist() == OTHER.encode_ordinary(text)


def test_long_runs(encoder):
    rng = random.Random(3)
    for text in ("a" * 50_000, "".join(rng.choice("abcé") for _ in range(50_000)), " " * 5000 + "x", "<|endoftext|>"):
        assert encoder.encode(text).tolist() == OTHER.encode_ordinary(text)


def test_the_dictionary_of_matches_stays_small(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    own = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for text in ("qwzx wxyq zzqx qqqx xxqz wwwq", "a", "qqqq wwww"):
        assert own.encode(text).tolist() == OTHER.encode_ordinary(text) and len(own.seen) <= 6


def test_single_and_joint_merges_agree():
    rng = random.Random(4)
    pieces = ["".join(rng.choice("aebzqé 中\n1") for _ in range(rng.randint(1, 40))).encode() for _ in range(3000)]
    joint = bpe.Merger(RANKS).many(pieces)
    assert joint == [bpe.merge(x, RANKS) for x in pieces]
    assert [b"".join(OTHER.decode_single_token_bytes(i) for i in ids) for ids in joint] == pieces


def test_query_and_edges(spark, frame):
    rows = [(1, None, "x"), (2, "", None), (None, "Hello  world", None), (None, "Hello  world", None)]
    docs = bpe.encode(frame(rows, "doc_id long, text string, raw string"), "text", RANKS, public_tokenizers.PATTERN, "ids")
    back = {(r["doc_id"], bytes(r["bytes"])) for r in bpe.decode(docs, "ids", RANKS, "bytes").collect()}
    assert back == {(1, b""), (2, b""), (None, b"Hello  world")}
    assert bpe.encode(frame([], "doc_id long, text string"), "text", RANKS, public_tokenizers.PATTERN, "ids").collect() == []
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    import hashlib

    import numpy as np

    for r in QUERIES["op9_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = OTHER.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
