"""Traces put together across micro-batches.

Spans of a trace arrive in any order, over several batches, and may come again.  State is kept by trace: its spans
by id until the trace has been quiet for a while (event time), then all of them go out at once with what only the whole trace
tells, and a marker stays for a time so that repeats are not taken for a new trace.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HELD = ["span_id", "parent_span_id", "name", "start_ns", "end_ns"]
OUT = "trace_id string, span_id string, parent_span_id string, name string, start_ns long, end_ns long, parent_known boolean, depth int, n_spans int"

def depths(parents: dict[str, str | None]) -> dict[str, int]:
    """Steps to the uppermost known ancestor; a span on a cycle counts as far as the walk goes."""
    out: dict[str, int] = {}
    for span in parents:
        way, at = [], span
        while at is not None and at in parents and at not in out and at not in way:
            way.append(at)
            at = parents[at]
        base = out[at] + 1 if at in out else 0
        for i, node in enumerate(reversed(way)):
            out[node] = base + i
    return out


class TraceAssembler(StatefulProcessor):
    """Holds one trace's spans; times are event times in milliseconds.

    Every call to the state store is a round trip and every value is packed by itself, so a trace costs a few of them per
    batch, however many spans it brings: a batch's spans are one text in a list and are told apart when they go out,
    and a timer that later spans have outdated is set anew when it fires.
    """

    def __init__(self, quiet_ms: int, forget_ms: int):
        self.quiet_ms, self.forget_ms = quiet_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "batch string")
        self.stage = handle.getValueState("stage", "is_done boolean, until_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stage = self.stage.get()
        if stage is not None and stage[0]:
            for _ in rows:
                pass
            return iter(())
        fresh: dict[str, tuple] = {}
        latest = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            latest = max(latest, int(part["start_ns"].max()) // 1_000_000)
            for r in zip(*(part[c].tolist() for c in HELD)):
                fresh.setdefault(r[0], r)
        until = latest + self.quiet_ms
        if stage is None:
            self.handle.registerTimer(until)
        self.spans.appendValue((json.dumps(list(fresh.values())),))
        if stage is None or until > stage[1]:
            self.stage.update((False, until))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        is_done, until = self.stage.get()
        now = timerValues.getCurrentWatermarkInMs()
        if is_done:  # long enough ago: repeats no longer matter
            self.stage.clear()
            return
        if until > now:  # spans have come since
            self.handle.registerTimer(until)
            return
        held: dict[str, tuple] = {}
        for (batch,) in self.spans.get():
            for r in json.loads(batch):
                held.setdefault(r[0], r)
        deep = depths({k: r[1] for k, r in held.items()})
        self.spans.clear()
        until = now + self.forget_ms
        self.stage.update((True, until))
        self.handle.registerTimer(until)
        out = [(key[0], *r, r[1] in held, deep[k], len(held)) for k, r in held.items()]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def assemble_traces(spans: DataFrame, delay: str = "10 minutes", quiet_s: int = 60, forget_s: int = 3600) -> DataFrame:
    """Whole traces of a stream of spans (trace_id, span_id, parent_span_id, name, start_ns, end_ns, start_time).

    Spans older than the watermark, ``delay`` behind the newest, are late and left out by Spark.

    A trace goes out once, when no span of it has begun for ``quiet_s`` seconds of event time.  Spans of it that come within
    ``forget_s`` seconds after that are dropped as repeats; later ones begin a new trace.  A span that comes twice counts once.
    Spans without trace id, span id or start cannot be placed and are left out.  A trace is held by one task, as its
    spans are told apart there; state lives in the RocksDB store and its checkpoint, so a restart goes on where it was.
    """
    known = spans.where(F.col("trace_id").isNotNull() & F.col("span_id").isNotNull() & F.col("start_ns").isNotNull())
    rows = known.withWatermark("start_time", delay).select("trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns", "start_time")
    return rows.groupBy("trace_id").transformWithStateInPandas(
        TraceAssembler(quiet_s * 1000, forget_s * 1000), outputStructType=OUT, outputMode="append", timeMode="EventTime"
    )
