"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest hash among its inner
s-mers stands at its first or last place.  Whether a k-mer is one depends on the
k-mer alone, so equal passages give equal anchors wherever they stand.  A document
has anchors (hash, place) for positional matching and, as its fingerprint, the
``SKETCH`` smallest distinct anchor hashes; the likeness of two fingerprints
estimates the Jaccard similarity of the anchor sets and is exact for small sets.

Defined results: null counts as the empty text; the empty text has the empty
fingerprint; a text shorter than k (or without an anchor) has its own hash as sole
anchor; two empty fingerprints have likeness 1, one empty has 0.  Equal texts have
equal fingerprints, repeated rows repeat.  In :func:`with_next` equal ids are
ordered by text hash, null ids stand last, and a table of one row is its own next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import grams, mix, partitions, window_min

K = 16
S = 6
SKETCH = 64
_SLICE = 1 << 18  # code points handled at once, so that arrays stay in cache
_DIGITS = 8


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def syncmers(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of one run of code points."""
    inner = grams(mix(points.astype(np.uint64)), s)
    width = k - s + 1
    if len(inner) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = window_min(inner, width)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    # a k-mer's hash from the s-mers that tile it (the last one may overlap)
    value = np.zeros(len(at), np.uint64)
    for step in [*range(0, k - s, s), k - s]:
        value = mix(value * np.uint64(0x9FB21C651E98DF25) + inner[at + step])
    return at, value


def anchors(texts: list[str], k: int = K, s: int = S) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text number, places, hashes) of every whole text, many short texts to an array operation."""
    first = 0
    while first < len(texts):
        last, held = first, 0
        while last < len(texts) and (last == first or held + len(texts[last]) <= _SLICE):
            held += len(texts[last])
            last += 1
        part = texts[first:last]
        if len(part) == 1:
            pieces = []
            points = _points(part[0])
            for at in range(0, max(len(points), 1), _SLICE):  # pieces overlap by k - 1
                place, value = syncmers(points[at : at + _SLICE + k - 1], k, s)
                pieces.append((place + at, value))
            yield first, np.concatenate([p for p, _ in pieces]), np.concatenate([v for _, v in pieces])
        else:
            place, value = syncmers(_points("".join(part)), k, s)
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            ends = np.cumsum(lengths)
            owner = np.searchsorted(ends, place, side="right")
            whole = place + k <= ends[np.minimum(owner, len(part) - 1)]
            place, value, owner = place[whole], value[whole], owner[whole]
            cuts = np.searchsorted(owner, np.arange(len(part) + 1))
            for i in range(len(part)):
                a, b = cuts[i], cuts[i + 1]
                yield first + i, place[a:b] - (ends[i] - lengths[i]), value[a:b]
        first = last


def _sole(text: str) -> np.ndarray:
    h = mix(_points(text).astype(np.uint64) + np.arange(len(text), dtype=np.uint64) * np.uint64(0x10001))
    return mix(np.array([h.sum(dtype=np.uint64)]))


def sketches(texts: list[str], size: int = SKETCH) -> list[np.ndarray]:
    """The ``size`` smallest distinct 32-bit anchor hashes of each text, in order."""
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
    for i, _, value in anchors(texts):
        if not len(value) and texts[i]:
            value = _sole(texts[i])
        small = (value >> np.uint64(32)).astype(np.uint32)
        if len(small) > 8 * size:  # repeats are rare: a few times the size holds enough distinct ones
            part = np.unique(np.partition(small, 4 * size)[: 4 * size])
            if len(part) > size:
                out[i] = part[:size]
                continue
        out[i] = np.unique(small)[:size]
    return out


def spelled(sketch: np.ndarray) -> str:
    """Eight hex digits for each value."""
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Bottom-k estimate of the Jaccard similarity, from 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.unique(np.concatenate((a, b)))[:size]
    return float(np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].sum() / len(both))


def with_next(docs: DataFrame, handle: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Run ``handle`` on each row together with the next one by descending id (after the last: the first).

    Rows are cut into ranges of ids, many more than tasks; the first row of each range
    is also sent, as a guest, to the range before it.  So each task streams its rows in
    order and no window runs over the whole table.  ``handle`` gets batches of
    (ids, texts, next texts) and returns an Arrow batch.
    """
    spark = docs.sparkSession
    slots = 4 * partitions(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / slots for i in range(1, slots)], 0.25 / slots)), reverse=True)
    place = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(
        F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b > F.col("doc_id"))) if bounds else F.lit(0)
    ).cast("int")
    rows = rows.select("doc_id", "text", place.alias("slot"), F.xxhash64("text").alias("h"))
    # A row for each range: bounded by the number of ranges.
    heads = rows.groupBy("slot").agg(F.max(F.struct("doc_id", "h")).alias("top"))
    order = Window.orderBy("slot")
    last = F.max("slot").over(Window.partitionBy())
    heads = heads.select("slot", "top", F.coalesce(F.lag("slot").over(order), last).alias("before"))
    marked = rows.alias("r").join(
        F.broadcast(heads.alias("g")),
        (F.col("r.slot") == F.col("g.slot")) & F.col("r.doc_id").eqNullSafe(F.col("g.top.doc_id")) & (F.col("r.h") == F.col("g.top.h")),
        "left",
    ).select("r.*", "before")
    stays = F.struct(F.col("slot").alias("slot"), F.lit(False).alias("guest"))
    visits = F.struct(F.col("before").alias("slot"), F.lit(True).alias("guest"))
    sent = marked.select("doc_id", "text", "h", F.explode(F.when(F.col("before").isNull(), F.array(stays)).otherwise(F.array(stays, visits))).alias("at"))
    sent = sent.select("doc_id", "text", "h", "at.slot", "at.guest").repartition(partitions(spark), "slot")
    sent = sent.sortWithinPartitions("slot", "guest", F.desc_nulls_last("doc_id"), F.desc("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that still waits for its next one
        for batch in batches:
            ids, texts, slot, guest = (batch.column(c).to_pylist() for c in ("doc_id", "text", "slot", "guest"))
            todo: tuple[list, list, list] = ([], [], [])
            size = 0
            for i, text in enumerate(texts):
                if held is not None and held[2] == slot[i]:
                    for x, v in zip(todo, (held[0], held[1], text), strict=True):
                        x.append(v)
                    size += len(held[1])
                held = None if guest[i] else (ids[i], text, slot[i])
                if size > 1 << 22:  # long texts: fewer rows at once
                    yield handle(*todo)
                    todo, size = ([], [], []), 0
            if todo[0]:
                yield handle(*todo)

    return sent.select("doc_id", "text", "slot", "guest").mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]
