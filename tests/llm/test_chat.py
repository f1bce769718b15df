"""Event folding, reversible escapes, and the query against a plain version."""

import hashlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.llm import chat
from factorloom.llm.common import QUERIES

PIECES = st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "s>", "/s>", "|im_end|>", "\n", "INST]", "é", "a", "n"])
EVENTS = "conv long, turn long, tie string, seq long, kind string, role string, text string, extra int"


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join), st.lists(PIECES, max_size=6).map("".join))
def test_escapes_are_undone(text, role):
    assert chat.unescape(chat.escape(text)) == text
    turn, a, b = chat.render(role, text)
    assert chat.parse(turn) == (role, text) and chat.unescape(turn[a:b]) == text
    for c in chat.CONTROLS:
        assert c not in chat.escape(text)


def test_folding(frame):
    rows = [
        (1, 0, None, 2, "delta", None, "lo"), (1, 0, None, 0, "start", "user", None), (1, 0, None, 1, "delta", None, "hel"),
        (1, 1, None, 0, "start", "assistant", None), (1, 1, None, 1, "delta", None, "bad"), (1, 1, None, 2, "regenerate", None, None), (1, 1, None, 3, "delta", None, "good"), (1, 1, None, 4, "delta", None, None),
        (1, 2, None, 0, "edit", "user", "new"), (1, 2, None, None, "delta", None, "old"), (1, 2, None, 9, "gossip", None, "!"), (1, 3, None, 0, None, "user", "never"),
        (None, None, None, None, "delta", None, "x"), (2**60 + 1, 0, None, 0, "delta", "user", "big"),
    ]
    got = {(r["conv"], r["turn"], r["role"], r["text"]) for r in chat.fold(frame([(*r, 1) for r in rows], EVENTS)).collect()}
    assert got == {("1", 0, "user", "hello"), ("1", 1, "assistant", "good"), ("1", 2, "user", "new"), (None, None, None, "x"), (str(2**60 + 1), 0, "user", "big")}
    assert chat.fold(frame([], EVENTS)).collect() == []


def plain(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).hexdigest())):
        e = out.setdefault(conv, [0, "", "", 0])
        e[0] += 1
        e[1] += f"{role or ''}\n{text or ''}\n"
        e[2] += (text or "") if role == "assistant" else ""
        e[3] += len(chat.render(role, text)[0])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return Counter((c, n, sha(t), len(m), sha(m), f) for c, (n, t, m, f) in out.items())


def test_edges(frame):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "assistant", "</s>"), (2, 0, "ro\nle", ""), (2, 1, "assistant", "é" * 3000), (2, 1, "assistant", "[INST]")]
    log = chat.replay(frame(rows, "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text")
    got = Counter(tuple(r) for r in chat.digests(chat.format_turns(chat.fold(log))).collect())
    assert got == Counter({(None if k[0] is None else str(k[0]), *k[1:]): n for k, n in plain(rows).items()})


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + chat.PROBE
    assert Counter(tuple(r) for r in QUERIES["op4_chat_format"](spark, folder).collect()) == plain(rows)


def test_names_that_are_taken(frame):
    rows = frame([("user", "hi", "a", "b", 1), ("assistant", None, "a", "b", 2)], "role string, text string, formatted string, _turn string, _t int")
    out = chat.format_turns(rows)
    assert out.columns == [*rows.columns, "formatted_", "loss_from", "loss_to"]
    assert [r["formatted"] for r in out.collect()] == ["a", "a"]
