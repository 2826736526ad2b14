"""Chat formatting in budgeted, turn-aligned windows.

Prefix sums of turn tokens choose the windows: each takes as many whole turns as fit
beside the retained system turn and the history, then as much of the history as is
left room for.  What is repeated is not under the loss mask, so each assistant text is a
target once.

Turns are numbered in their conversation from a written range partitioning, and packed in segments of so many, so that a
long conversation, or all rows of a null one, is no single task; a segment begins a new window, and is handed the last turns and
the last system turn before it.

A formatted turn is ``<turn role>text</turn>`` and a newline.  Backslash, ``<``, ``>`` in
roles and texts are written as backslash and b, l, g, so that no text can
hold a mark, and every text can be read back.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealscope.llm.merkle import numbered
from dealscope.llm.shared import given_id, held_id, words, written

OPEN, BODY, CLOSE = "<turn ", ">", "</turn>\n"
#: Tokens that a turn costs besides its text.
MARKS = 4


class Turn(NamedTuple):
    pos: int
    role: str
    text: str
    tokens: int


def escaped(text: str) -> str:
    return text.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g")


def unescaped(text: str) -> str:
    return text.replace("\\g", ">").replace("\\l", "<").replace("\\b", "\\")


def packed(turns: list[Turn], tail: list[Turn], system: Turn | None, budget: int, history: int) -> Iterator[list[tuple[Turn, bool]]]:
    """Windows of a segment: its turns in order, each with whether it is repeated.

    ``tail`` are the turns right before the segment, ``system`` is the last system turn before it.
    A window has its system turn, turns right before its own of ``history`` tokens at most,
    and turns of its own; all together keep to ``budget``, unless the system turn and a single
    turn of its own exceed it, and then it has no history.
    """
    ends = list(accumulate(t.tokens for t in turns))
    before = tail + turns
    a = 0
    while a < len(turns):
        held = system.tokens if system else 0
        start = ends[a - 1] if a else 0
        b = max(a + 1, bisect_right(ends, start + budget - history - held))
        left = min(history, budget - held - (ends[b - 1] - start))
        h = a + len(tail)
        while h > 0 and before[h - 1].tokens <= left:
            h -= 1
            left -= before[h].tokens
        repeated = before[h : a + len(tail)]
        if system and all(t.pos != system.pos for t in repeated):
            repeated = [system, *repeated]
        yield [*((t, True) for t in repeated), *((t, False) for t in turns[a:b])]
        system = next((t for t in reversed(turns[a:b]) if t.role == "system"), system)
        a = b


def formatted(window: list[tuple[Turn, bool]]) -> tuple[str, list[dict]]:
    """The text of a window, and the spans of its targets: assistant texts that are not repeated."""
    parts, at, spans = [], 0, []
    for t, repeated in window:
        head, body = f"{OPEN}{escaped(t.role)}{BODY}", escaped(t.text)
        if t.role == "assistant" and not repeated:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def windows(conversations: DataFrame, id_col: str = "conv_id", *, budget: int = 2048, history: int = 256, segment: int = 64, tokens_col: str | None = None) -> DataFrame:
    """One row a window: id, window_no, tokens, text, turns, loss_spans.

    ``turns`` lists (pos, repeated) of the turns in the window in order, ``loss_spans``
    the (start, end) characters of the window's text that are targets: the texts of
    assistant turns that are not repeated.  window_no is the position of the first turn that
    is not.  A turn has the tokens of ``tokens_col``, or else as many as words, and MARKS more.
    Windows keep to ``budget`` as :func:`packed` says; the system turn counts.  Turns are in order
    of turn, then role, then text, and are never cut; every ``segment`` turns of a conversation in that order, whatever their
    numbers, are a segment, which has as many turns as any history can at least.  Null texts and roles are empty; null turns come
    first; rows of a null conversation are one conversation; repeated rows are turns of their
    own.  Other columns are ignored.  An empty table gives no windows.
    """
    tokens = F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)) if tokens_col else words(F.col("text"))
    t = conversations.select(F.col(id_col).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), (tokens + MARKS).alias("tokens"))
    segment = max(segment, history // MARKS + 1)
    # a first letter keeps null apart; the number tells equal rows apart
    t = t.withColumns({"group": F.when(F.col("conv").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv").cast("string"))), "__row": F.monotonically_increasing_id()})
    t = numbered(t, ["turn", "role", "text", "__row"]).withColumn("seg", F.expr(f"pos div {segment}"))
    held = written(t.groupBy("group", "seg").agg(F.first("conv").alias("conv"), F.array_sort(F.collect_list(F.struct("pos", "role", "text", "tokens"))).alias("turns")), "turns")

    # what a segment hands on: at most `history` tokens of turns, and one system turn
    none = F.filter("turns", lambda x: F.lit(False))
    nearest = F.aggregate(
        F.reverse(F.slice("turns", -F.least(F.size("turns"), F.lit(history // MARKS + 1)), F.lit(history // MARKS + 1))),
        F.struct(F.lit(0).cast("long").alias("sum"), none.alias("turns")),
        lambda acc, x: F.struct((acc["sum"] + x["tokens"]).alias("sum"), F.when(acc["sum"] + x["tokens"] <= history, F.concat(F.array(x), acc["turns"])).otherwise(acc["turns"]).alias("turns")),
        lambda acc: acc["turns"],
    )
    systems = F.filter("turns", lambda x: x["role"] == "system")
    handed = held.select("group", "seg", nearest.alias("tail"), F.try_element_at(systems, F.lit(-1)).alias("system"))
    # which segment before has the last system turn: a row of numbers a segment, also in a conversation of very many
    earlier = Window.partitionBy("group").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    placed = handed.select("group", "seg", F.last(F.when(F.col("system").isNotNull(), F.col("seg")), ignorenulls=True).over(earlier).alias("at"))
    tails = handed.select("group", (F.col("seg") + 1).alias("seg"), "tail")
    given = placed.join(tails, ["group", "seg"], "left").join(handed.select("group", F.col("seg").alias("at"), "system"), ["group", "at"], "left")
    joined = held.join(given.drop("at"), ["group", "seg"]).select("conv", "turns", "tail", "system")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field("conv"), *_WINDOW])
            for k in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(k, 256).to_pylist():
                    turns, near = ([Turn(**x) for x in row[c] or []] for c in ("turns", "tail"))
                    system = Turn(**row["system"]) if row["system"] else None
                    for window in packed(turns, near, system, budget, history):
                        text, spans = formatted(window)
                        out.append({"conv": row["conv"], "window_no": next(t.pos for t, repeated in window if not repeated), "tokens": sum(t.tokens for t, _ in window), "text": text, "turns": [{"pos": t.pos, "repeated": repeated} for t, repeated in window], "loss_spans": spans})
                yield pa.RecordBatch.from_pylist(out, schema)

    kind = held.schema["conv"].dataType.simpleString()
    out = joined.mapInArrow(run, f"conv {kind}, window_no long, tokens long, text string, turns array<struct<pos:bigint,repeated:boolean>>, loss_spans array<struct<start:bigint,end:bigint>>")
    return out.withColumnRenamed("conv", id_col)


_WINDOW = [
    pa.field("window_no", pa.int64()),
    pa.field("tokens", pa.int64()),
    pa.field("text", pa.string()),
    pa.field("turns", pa.list_(pa.struct([("pos", pa.int64()), ("repeated", pa.bool_())]))),
    pa.field("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
]


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    found = []
    for part in text.split(CLOSE)[:-1]:
        role, _, body = part.removeprefix(OPEN).partition(BODY)
        found.append((unescaped(role), unescaped(body)))
    return found


def read_digests(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row a conversation, read from its windows: turns, loss text and sizes.

    Windows are streamed in order, so no conversation is held as a whole.  Repeated
    turns are skipped; the text under the loss mask is cut out by the spans and unescaped.
    """
    kind = chats.schema[id_col].dataType.simpleString()
    source = chats.select(held_id(chats, id_col).alias("conv"), "window_no", "text", F.transform("turns", lambda x: x["repeated"]).alias("repeated"), F.transform("loss_spans", lambda x: F.array(x["start"], x["end"])).alias("spans"))
    source = source.repartition("conv").sortWithinPartitions("conv", "window_no")
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = object()
        conv, n, turns, loss, chars, size = none, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
        for pdf in batches:
            done = []
            for c, text, repeated, spans in zip(pdf["conv"], pdf["text"], pdf["repeated"], pdf["spans"], strict=True):
                c = None if pd.isna(c) else c
                if c != conv or conv is none:
                    if conv is not none:
                        done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    conv, n, turns, loss, chars, size = c, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                size += len(text)
                for (role, body), again in zip(read_back(text), repeated, strict=True):
                    if not again:
                        n += 1
                        turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for start, end in spans:
                    part = unescaped(text[start:end])
                    chars += len(part)
                    loss.update(part.encode("utf-8", "surrogatepass"))
            if done:
                yield pd.DataFrame(done, columns=names)
        if conv is not none:
            yield pd.DataFrame([(conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)], columns=names)

    out = source.mapInPandas(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv", given_id(out, "conv")).withColumnRenamed("conv", id_col)
