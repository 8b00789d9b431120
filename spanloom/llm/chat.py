"""Chat formatting from event logs.

Logs hold events of messages: ``start`` (sets the role and clears the text), ``delta``
(appends), ``edit`` (replaces the text so far) and ``regenerate`` (discards it).  Sorted
by message and sequence they fold into final messages, which are rendered by a template:

    [INST] user [/INST]    assistant </s>    <<SYS>> system <</SYS>>    <|role|> other <|end|>

Inside texts and roles a backslash follows each of ``\\ [ < |``.  So no control string can
stand in a text, the first closing mark is the turn's own, and dropping those backslashes
gives the text back.

Work is split by blocks of ``BLOCK`` turns, so a very long conversation is folded and
rendered by many tasks; its output is its blocks in order.  Tasks stream sorted events and
hold one block.

Defined results: null texts and roles are empty; a null turn comes first; of equal turns
the order is by role, then text; events of unknown kind are ignored; repeated events apply
again in their order; a conversation without events has no output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import partitions

BLOCK = 64
# The control strings of the template, opening and closing.
MARKS = {
    "user": ("[INST] ", " [/INST]"),
    "system": ("<<SYS>> ", " <</SYS>>"),
    "assistant": (" ", " </s>"),
}
_OTHER = ("<|", "|> ", " <|end|>")
_ESCAPE = re.compile(r"([\\\[<|])")
_UNESCAPE = re.compile(r"([\\\[<|])\\")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the code-point spans under the loss mask (assistant texts)."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        inner = escape(text)
        begin, end = MARKS.get(role) or (_OTHER[0] + escape(role) + _OTHER[1], _OTHER[2])
        if role == "assistant":
            spans.append((at + len(begin), at + len(begin) + len(inner)))
        parts += (begin, inner, end)
        at += len(begin) + len(inner) + len(end)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        for role, (begin, end) in MARKS.items():
            if formatted.startswith(begin, at):
                low = at + len(begin)
                break
        else:
            if not formatted.startswith(_OTHER[0], at):
                raise ValueError(f"no turn begins at {at}")
            cut = formatted.index(_OTHER[1], at + len(_OTHER[0]))
            role, low, end = unescape(formatted[at + len(_OTHER[0]) : cut]), cut + len(_OTHER[1]), _OTHER[2]
        high = formatted.index(end, low)
        out.append((role, unescape(formatted[low:high])))
        at = high + len(end)
    return out


def fold(role: str, text: list[str], kind: str, event_role: str | None, event_text: str | None) -> tuple[str, list[str]]:
    """One event of a message applied."""
    if kind == "start":
        return event_role or "", []
    if kind == "delta":
        text.append(event_text or "")
    elif kind == "edit":
        text = [event_text or ""]
    elif kind == "regenerate":
        text = []
    return role, text


EVENTS = ["conv_id", "turn", "nth", "seq", "kind", "role", "text"]


def format_logs(events: DataFrame) -> DataFrame:
    """conv_id, block, n_turns, formatted and loss_spans; ``events`` has the columns EVENTS.

    ``nth`` tells messages of equal turn apart; ``seq`` orders the events of a message.
    """
    rows = events.select(*EVENTS).withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / BLOCK))
    by = ["conv_id", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = message = None
        messages: list[tuple[str, str]] = []
        role, text = "", []
        done: list[tuple] = []

        def close_message() -> None:
            if message is not None:
                messages.append((role, "".join(text)))

        for batch in batches:
            for conv, turn, nth, _, kind, event_role, event_text, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (conv, block) or message != (turn, nth):
                    close_message()
                    message, role, text = (turn, nth), "", []
                if key != (conv, block):
                    if key is not None:
                        done.append((*key, len(messages), *render(messages)))
                    key, messages = (conv, block), []
                role, text = fold(role, text, kind, event_role, event_text)
            if done:
                yield table(done)
                done = []
        close_message()
        if key is not None:
            yield table([(*key, len(messages), *render(messages))])

    def table(done: list[tuple]) -> pa.RecordBatch:
        conv, block, n, formatted, spans = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(conv, pa.int64()), pa.array(block, pa.int64()), pa.array(n, pa.int64()), pa.array(formatted, pa.string()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["conv_id", "block", "n_turns", "formatted", "loss_spans"],
        )

    moved = rows.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by, F.asc_nulls_first("turn"), "nth", "seq")
    return moved.mapInArrow(run, "conv_id long, block long, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>")


def _event(seq: int, kind: str, text: Column | None = None) -> Column:
    return F.struct(
        F.lit(seq).alias("seq"), F.lit(kind).alias("kind"),
        (F.col("role") if kind == "start" else F.lit(None).cast("string")).alias("role"), (F.lit(None).cast("string") if text is None else text).alias("text"),
    )


def log_of(turns: DataFrame) -> DataFrame:
    """The log by which a chat server would have produced these turns (conv_id, turn, role, text).

    Texts stream in two deltas.  An assistant text follows an attempt that was
    regenerated; every third turn was first sent in another wording and then edited.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("nth", nth)
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    streamed = [_event(0, "start"), _event(3, "delta", head), _event(4, "delta", tail)]
    retried = [_event(0, "start"), _event(1, "delta", tail), _event(2, "regenerate"), *streamed[1:]]
    edited = [_event(0, "start"), _event(1, "delta", tail), _event(2, "edit", F.col("text"))]
    events = F.when(F.col("role") == "assistant", F.array(*retried)).when(F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3)) == 2, F.array(*edited)).otherwise(F.array(*streamed))
    return rows.select("conv_id", "turn", "nth", F.explode(events).alias("e")).select("conv_id", "turn", "nth", "e.*").select(*EVENTS)
