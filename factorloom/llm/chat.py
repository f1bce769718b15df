"""Chat formatting from an event log: fold streamed deltas, edits and regenerations into messages, then render.

A log is partitioned by conversation and message, sorted by sequence and folded as a stream: a task holds one message at
a time. Messages of one conversation may be folded by many tasks, so a conversation with a third of all rows is no hot spot.
Rendering works on single messages; a conversation's text is the rendered messages in order.

Events (column `kind`): `start` opens a message and gives its role, `delta` appends text, `edit` replaces the text so far,
`regenerate` throws it away for the deltas to come. Other kinds and null are ignored. A null text is empty. The role is the last one given.
A message without any of these four kinds does not exist.

Template: <|im_start|>ROLE, newline, TEXT, <|im_end|>, newline. A control string inside a role or text gets a backslash after its first
character, or one more where it already has some; backslash and newline in a role are written \\\\ and \\n. Both are undone by `parse`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, query, table

# Control strings of public chat templates.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE, CHUNK = "assistant", 256
_AHEAD = "(?=" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")"
_BARE, _ESCAPED = re.compile(r"([<\[])(\\*)" + _AHEAD), re.compile(r"([<\[])\\(\\*)" + _AHEAD)


def escape(text: str) -> str:
    return _BARE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """One formatted turn and the code points of its text in it; null counts as empty."""
    head = OPEN + escape((role or "").replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text or "")
    return head + body + CLOSE + "\n", len(head), len(head) + len(body)


def parse(turn: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    role, newline, rest = turn.removeprefix(OPEN).partition("\n")
    if not (turn.startswith(OPEN) and newline and rest.endswith(CLOSE + "\n")):
        raise ValueError(f"not a formatted turn: {turn[:60]!r}")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
    return role, unescape(rest[: -len(CLOSE) - 1])


FOLDED = "conv string, turn long, tie string, role string, text string"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in FOLDED.split(", ")]
    here, role, parts = None, None, None

    def done():
        return (*here[:1], int(here[1]) if here[1] is not None else None, here[2], role, "".join(parts))

    for batch in batches:
        out = []
        for conv, turn, tie, kind, r, text in zip(batch["conv"], batch["turn"], batch["tie"], batch["kind"], batch["role"], batch["text"]):
            if (conv, turn, tie) != here:
                if parts is not None:
                    out.append(done())
                here, role, parts = (conv, turn, tie), None, None
            if kind not in ("start", "delta", "edit", "regenerate"):
                continue
            role = r if r is not None else role
            parts = [] if parts is None or kind in ("edit", "regenerate") else parts
            if kind in ("delta", "edit"):
                parts.append(text or "")
        if out:
            yield pd.DataFrame(out, columns=names).astype({"turn": "Int64"})
    if parts is not None:
        yield pd.DataFrame([done()], columns=names).astype({"turn": "Int64"})


def fold(events: DataFrame) -> DataFrame:
    """(conv, turn, tie, role, text): final messages of a log (conv, turn, tie, seq, kind, role, text).

    A message is told by conv, turn and tie, null being a value like any other; its events are taken by seq (null
    first), events of one seq by kind and text. conv comes back as text. A conversation's messages come out together and in order.
    """
    e = events.select(F.col("conv").cast("string").alias("conv"), F.col("turn").cast("long").cast("string").alias("turn"), F.col("tie").cast("string").alias("tie"), "seq", "kind", "role", "text")
    spread = e.repartition("conv").sortWithinPartitions("conv", "turn", "tie", "seq", "kind", "text")
    return spread.drop("seq").mapInPandas(_fold, FOLDED)


TURN = T.StructType([T.StructField("formatted", T.StringType()), T.StructField("loss_from", T.LongType()), T.StructField("loss_to", T.LongType())])


@F.pandas_udf(TURN)
def _render(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
    rows = [(f, a, b if r == TRAINED_ROLE else a) for r, (f, a, b) in ((r, render(r, t)) for r, t in zip(roles, texts))]
    return pd.DataFrame(rows, columns=["formatted", "loss_from", "loss_to"])


def format_turns(messages: DataFrame) -> DataFrame:
    """Add formatted, loss_from and loss_to to messages (…, role, text): the loss mask is [loss_from, loss_to) in code points of the turn.

    Other columns stay as they are; a name that is taken gets a trailing underscore.
    """
    turn, *names = fresh(messages, "_turn", "formatted", "loss_from", "loss_to")
    made = messages.withColumn(turn, _render("role", "text"))
    return made.select(*messages.columns, *[F.col(f"{turn}.{f.name}").alias(n) for f, n in zip(TURN.fields, names)])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    here, n, turns, loss, loss_chars, chars = None, 0, None, None, 0, 0

    def row():
        return (here[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        out = []
        for conv, formatted, a, b in zip(batch["conv"], batch["formatted"], batch["loss_from"], batch["loss_to"]):
            if here != (conv,):
                if here is not None:
                    out.append(row())
                here, n, turns, loss, loss_chars, chars = (conv,), 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            role, text = parse(formatted)
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            trained = unescape(formatted[a:b])
            loss.update(trained.encode("utf-8", "surrogatepass"))
            n, loss_chars, chars = n + 1, loss_chars + len(trained), chars + len(formatted)
        if out:
            yield pd.DataFrame(out, columns=names)
    if here is not None:
        yield pd.DataFrame([row()], columns=names)


def digests(turns: DataFrame, placed: bool = False) -> DataFrame:
    """Per conversation: what its formatted turns say when read back, as digests.

    A digest of a conversation goes through its turns in order, so one task streams them; it holds one batch and a hash state. placed: turns are
    where `fold` left them, conversation by conversation and in order, and need not move again.
    """
    order = turns if placed else turns.repartition("conv").sortWithinPartitions("conv", "turn", "tie")
    return order.select("conv", "formatted", "loss_from", "loss_to").mapInPandas(_digests, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def replay(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """An event log that leads to the given rows.

    Trained turns were streamed in chunks after a regenerated draft, others were edited once. Rows of one turn follow each other by role and
    text digest; repeated rows are turns of their own.
    """
    r = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    # the number tells repeated rows apart; they are alike, so it does not matter which has which
    r = r.withColumn("copy", F.monotonically_increasing_id().cast("string"))
    r = r.withColumn("tie", F.concat_ws(" ", F.coalesce("role", F.lit("")), F.sha2("text", 256), F.lpad("copy", 20, "0")))
    draft = F.substring("text", 1, 40)
    event = lambda seq, kind, text: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    head = [event(0, "start", F.lit(None).cast("string")), event(1, "delta", draft)]
    count = F.ceil(F.length("text") / CHUNK).cast("int")
    deltas = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.struct((i + 3).cast("long").alias("seq"), F.lit("delta").alias("kind"), F.substring(F.col("text"), i * CHUNK + 1, F.lit(CHUNK)).alias("text")))
    streamed = F.concat(F.array(*head, event(2, "regenerate", F.lit(None).cast("string"))), deltas)
    log = F.when(F.col("role") == TRAINED_ROLE, streamed).otherwise(F.array(*head, event(2, "edit", F.col("text"))))
    return r.select("conv", "turn", "tie", "role", F.explode(log).alias("e")).select("conv", "turn", "tie", "e.seq", "e.kind", F.when(F.col("e.kind") == "start", F.col("role")).alias("role"), "e.text")


PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op4_chat_format")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    out = digests(format_turns(fold(replay(rows, "conv_id", "turn", "role", "text"))), placed=True)
    return out.select(F.col("conv").cast("long").alias("conv_id"), *out.columns[1:])
