"""Whole texts packed into chunks, and exchanges between chunks and hash buckets.

Work that compares passages of all documents goes in rounds: chunks send what they have
to buckets by hash (each distinct value once, so a passage that a third of all documents
share is sent once by each chunk), buckets answer the chunks.  A chunk or bucket is a few
MB; tasks stream their rows in order and hold one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import partitions, pieces, written

CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20
PACK = "chunk long, bytes long, ids array<long>, lengths binary, pack binary"


def pack(docs: DataFrame) -> DataFrame:
    """Write doc_id and text as chunks of about CHUNK_BYTES, by id within a chunk; a longer text stands alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        chunk = (TaskContext.get().partitionId() << 33) - 1
        for batch in pieces(batches, 2048):
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
            first = 0
            while first < len(order):
                last, held = first, 0
                while last < len(order) and (last == first or held + len(texts[order[last]] or b"") <= CHUNK_BYTES):
                    held += len(texts[order[last]] or b"")
                    last += 1
                own = order[first:last]
                data = [texts[i] or b"" for i in own]
                chunk += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk], pa.int64()), pa.array([held], pa.int64()), pa.array([[ids[i] for i in own]], pa.list_(pa.int64())),
                        pa.array([np.array([len(t) for t in data], np.int64).tobytes()], pa.binary()), pa.array([squeeze.compress(b"".join(data))], pa.binary()),
                    ],
                    ["chunk", "bytes", "ids", "lengths", "pack"],
                )
                first = last

    return written(docs.select("doc_id", "text").mapInArrow(run, PACK), "chunks")


def texts(row: dict) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(row["pack"], max_output_size=max(1, row["bytes"]))
    ends = np.cumsum(np.frombuffer(row["lengths"], np.int64))
    return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def buckets(packed: DataFrame) -> int:
    """As many that one holds the anchors of about BUCKET_BYTES of text."""
    total = packed.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    return max(1, -(-total // BUCKET_BYTES))


def by_key(rows: DataFrame, key: str, order: list[str], handle: Callable[[list[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring rows of a key together and handle one key at a time; the rows of a key stand in ``order``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):  # rows are large: one at a time
                row = batch.slice(i, 1).to_pylist()[0]
                if held and held[0][key] != row[key]:
                    yield from handle(held)
                    held = []
                held.append(row)
        if held:
            yield from handle(held)

    moved = rows.repartition(partitions(rows.sparkSession), key).sortWithinPartitions(key, *order)
    return moved.mapInArrow(run, schema)


def each(packed: DataFrame, handle: Callable[[dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Handle each chunk where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from handle(batch.slice(i, 1).to_pylist()[0])

    return packed.mapInArrow(run, schema)


def shared(packed: DataFrame, anchors: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], n_buckets: int) -> DataFrame:
    """(chunk, shared): the anchors of a chunk that other chunks have too, or that are flagged.

    ``anchors`` gives the distinct 64-bit anchors of a chunk and flags.
    """

    def send(row: dict) -> Iterator[pa.RecordBatch]:
        own = texts(row)
        found, twice = anchors(own)
        if not len(found):
            return
        bucket = (found % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, twice, bucket = found[order], twice[order], bucket[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        parts = list(zip(cuts[:-1], cuts[1:], strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(bucket[a]) for a, _ in parts], pa.int64()), pa.array([row["chunk"]] * len(parts), pa.int64()),
                pa.array([found[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([twice[a:b].tobytes() for a, b in parts], pa.binary()),
            ],
            ["bucket", "chunk", "found", "twice"],
        )

    def answer(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        values = [np.frombuffer(r["found"], np.uint64) for r in rows]
        whole, place, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        often = count > 1
        often[place[np.frombuffer(b"".join(r["twice"] for r in rows), bool)]] = True
        at, ids, parts = 0, [], []
        for r, v in zip(rows, values, strict=True):
            own = v[often[place[at : at + len(v)]]]
            at += len(v)
            if len(own):
                ids.append(r["chunk"])
                parts.append(own.tobytes())
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary())], ["chunk", "shared"])

    sent = each(packed, send, "bucket long, chunk long, found binary, twice binary")
    return by_key(sent, "bucket", ["chunk"], answer, "chunk long, shared binary")


def with_answers(packed: DataFrame, answers: DataFrame, column: str, handle: Callable[[dict, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Handle each chunk together with the answers to it."""
    left = packed.select("chunk", F.lit(0).alias("kind"), "bytes", "ids", "lengths", "pack", F.lit(None).cast("binary").alias("answer"))
    right = answers.select(
        "chunk", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("array<long>").alias("ids"),
        F.lit(None).cast("binary").alias("lengths"), F.lit(None).cast("binary").alias("pack"), F.col(column).alias("answer"),
    )

    def both(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        yield from handle(rows[0], [r["answer"] for r in rows[1:]])

    return by_key(left.unionByName(right), "chunk", ["kind"], both, schema)
