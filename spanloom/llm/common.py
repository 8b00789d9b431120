"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import ensure_checkpoint_dir

#: A word: a maximal run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts lineage, survives lost executors.

    The folder lies inside this application's own checkpoint folder, so it goes with it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h ^= h >> _SHIFT
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def grams(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` values, by doubling: log2(length) passes instead of ``length``."""
    size, out, have = len(h), None, 0
    power = h
    width = 1
    while True:
        if length & width:
            if out is None:
                out, have = power, width
            else:
                n = size - (have + width) + 1
                if n <= 0:
                    return np.empty(0, np.uint64)
                out = mix(out[:n] * np.uint64(0xD6E8FEB86659FD93) + power[have : have + n])
                have += width
        width *= 2
        if width > length:
            break
        n = size - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        half = width // 2
        power = mix(power[:n] * np.uint64(0xA0761D6478BD642F) + power[half : half + n] + np.uint64(width))
    return out if len(out) == size - length + 1 else np.empty(0, np.uint64)


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = h, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        step = width - have
        out = np.minimum(out[:-step], out[step:])
    return out


class Words:
    """The words of several texts laid end to end: hashes, byte places and the first word of each text."""

    __slots__ = ("hashes", "starts", "ends", "offsets", "data")

    def __init__(self, texts: list[bytes]):
        data = b" ".join(texts) + b" "
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
        self.starts = np.flatnonzero(edge == -1)
        self.ends = np.flatnonzero(edge == 1)
        self.ends = self.ends[: len(self.starts)]
        self.hashes = _spans(raw, self.starts, self.ends)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        self.offsets = np.searchsorted(self.starts, bounds)


_POWER = np.uint64(0x880355F21E6D1965)


def _spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: wrapping sum of scrambled (byte, place in span), then scrambled with its length."""
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(len(raw), dtype=np.int64)
    length = ends - starts
    owner = np.zeros(len(raw) + 1, np.int64)
    owner[starts] = 1
    owner = np.cumsum(owner[:-1]) - 1
    inside = np.maximum(place - starts[np.maximum(owner, 0)], 0)
    value = mix((inside.astype(np.uint64) << np.uint64(8)) + raw + np.uint64(1))
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    value[gap] = 0
    total = np.add.reduceat(value, starts)
    return mix(total * _POWER + length.astype(np.uint64))


def slices(texts: list[bytes], size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``size`` bytes; a longer text stands alone."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(text) + 1
    if first < len(texts):
        yield first, texts[first:]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller parts, so that a task holds the results of fewer texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
