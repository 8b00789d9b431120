"""Deduplication of repeated byte strings by merging sorted suffix runs.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else (same
document included) is removed, all copies alike; strings are judged on the input.

1. The anchor of a string is the smallest hash among its ``GRAM``-byte grams, so equal
   strings have their anchor at the same offset.  An anchor stands for the strings around
   it (85 on average); chunks and buckets find the anchors that occur more than once.
2. Each chunk cuts out the suffix from each such anchor, as far as its strings reach,
   with what stands to its left; equal ones are sent once.  Sorted suffixes go to the
   anchor's bucket as front-coded runs: length of the prefix shared with the one before,
   and the rest.
3. A bucket merges the runs of all chunks with a loser tree that knows common prefixes:
   of two candidates the one that shares more with the last winner is smaller, and only
   equal lengths are compared, from the end of the known prefix.  The merge leaves the
   common prefix of each suffix with the one before.
4. Strings at offset o before the anchor are equal if their suffixes share LENGTH - o
   bytes, which the prefix lengths tell, and the o bytes to the left are equal, for which
   64-bit hashes stand.  All of an anchor's strings contain it, so what is covered around
   an occurrence is one span; the chunks remove the spans.

Defined results: a null text counts as empty; texts shorter than LENGTH lose nothing;
repeated rows are copies of each other; null ids are allowed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from spanloom.llm import chunks
from spanloom.llm.common import grams, mix, window_min, written

LENGTH = 200
GRAM = 32
_GRAMS = LENGTH - GRAM + 1
_PLACE_BITS = np.uint64(24)
_PIECE = 1 << 22  # bytes looked at together; must be below 2**_PLACE_BITS


class _Anchors:
    """Anchors of a chunk: hash, place, and first and last start of the strings that have it there."""

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(texts)
        self.edges = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        parts = [self._piece(at) for at in range(0, max(1, len(self.data) - LENGTH + 1), _PIECE)]
        start, place, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        begins = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (np.diff(start) != 1))) if len(start) else np.empty(0, bool))
        last = np.concatenate((begins[1:], [len(start)])) - 1 if len(begins) else begins
        self.value, self.place, self.first, self.last = value[begins], place[begins], start[begins], start[last]

    def _piece(self, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(self.data, np.uint8)[low : low + _PIECE + LENGTH - 1]
        if len(raw) < LENGTH:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        g = grams(mix(raw.astype(np.uint64) + np.uint64(1)), GRAM)
        # the place in the low bits: of equal hashes the leftmost is the smallest
        key = (g >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(g), dtype=np.uint64)
        least = window_min(key, _GRAMS)
        inside = np.ones(len(least), bool)
        for edge in self.edges[(self.edges > low) & (self.edges < low + len(raw))] - low:
            inside[max(0, edge - LENGTH + 1) : edge] = False
        start = np.flatnonzero(inside)
        place = (least[start] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        return start + low, place + low, g[place]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a chunk; those at several places are flagged."""
    x = _Anchors(texts)
    # an anchor's strings are neighbours unless a piece ends between them
    new = np.concatenate(([True], x.place[1:] != x.place[:-1])) if len(x.place) else np.empty(0, bool)
    found, count = np.unique(x.value[new], return_counts=True)
    return found, count > 1


def front_code(run: list[bytes]) -> tuple[list[int], bytes]:
    """Lengths of the prefixes shared with the string before, and the rests."""
    shared, rest, before = [], [], b""
    for s in run:
        n = common(before, s, 0)
        shared.append(n)
        rest.append(s[n:])
        before = s
    return shared, b"".join(rest)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes are common for sure."""
    end = min(len(a), len(b))
    step = 16
    while known < end and a[known : known + step] == b[known : known + step]:
        known += step
    if known >= end:
        return end
    while known < end and a[known] == b[known]:
        known += 1
    return known


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs: (run, place in it, common prefix with the string before), in order.

    ``runs`` holds the strings and their common prefixes with the one before in the run.
    The tree keeps losers; each candidate knows its common prefix with the last winner it
    was compared to, so no known prefix is compared again.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    known = [0] * k
    text: list[bytes | None] = [runs[i][0][0] if i < len(runs) and runs[i][0] else None for i in range(k)]
    tree = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's common prefix is then with the winner."""
        sa, sb = text[a], text[b]
        if sa is None:
            return b, a
        if sb is None:
            return a, b
        ha, hb = known[a], known[b]
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        n = common(sa, sb, ha)
        if sa[n:] <= sb[n:]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while text[winner] is not None:
        yield winner, place[winner], known[winner]
        place[winner] += 1
        strings, shared = runs[winner]
        if place[winner] < len(strings):
            text[winner], known[winner] = strings[place[winner]], shared[place[winner]]
        else:
            text[winner] = None
        node = (winner + k) >> 1
        while node:
            winner, tree[node] = play(winner, tree[node])
            node >>= 1


_RUNS = "bucket long, chunk long, shared binary, right binary, left binary, copies binary, places binary, text binary"


def _send_runs(packed: DataFrame, shared: DataFrame, n_buckets: int) -> DataFrame:
    def send(row: dict, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not answers:
            return
        x = _Anchors(chunks.texts(row))
        known = np.sort(np.frombuffer(b"".join(answers), np.uint64))
        at = np.minimum(np.searchsorted(known, x.value), len(known) - 1)
        go = np.flatnonzero(known[at] == x.value)
        found: dict[tuple[int, bytes, bytes], list[int]] = {}
        bucket = (x.value[go] % np.uint64(n_buckets)).tolist()
        for b, p, a, z in zip(bucket, x.place[go].tolist(), x.first[go].tolist(), x.last[go].tolist(), strict=True):
            found.setdefault((b, x.data[p : z + LENGTH], x.data[a:p][::-1]), []).append(p)
        squeeze = zstandard.ZstdCompressor(level=1)
        out: dict[str, list] = {c.split()[0]: [] for c in _RUNS.split(", ")}
        run: list[tuple[int, bytes, bytes]] = []

        def close() -> None:
            prefix, rest = front_code([r[1] for r in run])
            left = b"".join(r[2] for r in run)
            for name, v in (
                ("bucket", run[0][0]), ("chunk", row["chunk"]), ("shared", np.array(prefix, np.uint8).tobytes()),
                ("right", np.array([len(r[1]) for r in run], np.uint8).tobytes()), ("left", np.array([len(r[2]) for r in run], np.uint8).tobytes()),
                ("copies", np.array([len(found[r]) for r in run], np.int32).tobytes()),
                ("places", np.array([p for r in run for p in found[r]], np.int64).tobytes()), ("text", squeeze.compress(rest + left)),
            ):
                out[name].append(v)

        for r in sorted(found):
            if run and run[0][0] != r[0]:
                close()
                run = []
            run.append(r)
        if run:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("bucket", "chunk") else pa.binary()) for k, v in out.items()], list(out))

    return chunks.with_answers(packed, shared, "shared", send, _RUNS)


def covered(prefix: np.ndarray, right: np.ndarray, lefts: list[bytes], several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest offset at which each suffix's string occurs elsewhere (largest -1: none).

    ``prefix``: common prefix with the suffix before; ``right``: length of the suffix;
    ``lefts``: what stands before it, backwards; ``several``: it stands for several places.
    """
    n = len(prefix)
    low, high = np.full(n, LENGTH), np.full(n, -1)
    left = np.array([len(s) for s in lefts])
    before = np.zeros((n, _GRAMS), np.uint8)
    for i, s in enumerate(lefts):
        before[i, : len(s)] = np.frombuffer(s, np.uint8)
    h = np.full(n, 7, np.uint64)
    for o in range(_GRAMS):
        if o:
            h = mix(h * np.uint64(0x100000001B3) + before[:, o - 1])
        fit = np.flatnonzero((left >= o) & (right >= LENGTH - o))
        if not len(fit):
            continue
        group = np.cumsum(prefix < LENGTH - o)
        key = mix(group[fit].astype(np.uint64)) + h[fit]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        hit = several[fit].copy()
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        who = fit[hit]
        low[who] = np.minimum(low[who], o)
        high[who] = o
    return low, high


def _merge(runs: DataFrame) -> DataFrame:
    """(chunk, spans): repeated byte spans of the chunk as (begin, end)."""

    def bucket(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        sorted_runs, lefts, places = [], [], []
        for r in rows:
            shared, right, left = (np.frombuffer(r[c], np.uint8).tolist() for c in ("shared", "right", "left"))
            text = open_.decompress(r["text"])
            at, before, strings = 0, b"", []
            for s, n in zip(shared, right, strict=True):
                before = before[:s] + text[at : at + n - s]
                at += n - s
                strings.append(before)
            own = []
            for n in left:
                own.append(text[at : at + n])
                at += n
            sorted_runs.append((strings, shared))
            lefts.append(own)
            ends = np.cumsum(np.frombuffer(r["copies"], np.int32))
            places.append(np.split(np.frombuffer(r["places"], np.int64), ends[:-1]))
        order = list(merge(sorted_runs))
        prefix = np.array([n for _, _, n in order])
        right = np.array([len(sorted_runs[i][0][j]) for i, j, _ in order])
        several = np.array([len(places[i][j]) > 1 for i, j, _ in order])
        low, high = covered(prefix, right, [lefts[i][j] for i, j, _ in order], several)
        spans: dict[int, list[np.ndarray]] = {}
        for at in np.flatnonzero(high >= 0).tolist():
            i, j, _ = order[at]
            p = places[i][j]
            spans.setdefault(rows[i]["chunk"], []).append(np.stack((p - high[at], p + LENGTH - low[at]), 1))
        if spans:
            yield pa.RecordBatch.from_arrays([pa.array(list(spans), pa.int64()), pa.array([np.concatenate(v).tobytes() for v in spans.values()], pa.binary())], ["chunk", "spans"])

    return chunks.by_key(runs, "bucket", ["chunk"], bucket, "chunk long, spans binary")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def deduplicate(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept: the bytes that stay (or their SHA-256 in hex)."""
    packed = chunks.pack(docs)
    n = chunks.buckets(packed)
    shared = chunks.shared(packed, anchors, n)
    spans = written(_merge(_send_runs(packed, shared, n)), "spans")

    def apply(row: dict, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        texts = chunks.texts(row)
        edges = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        change = np.zeros(int(edges[-1]) + 1, np.int64)
        for answer in answers:
            begin, end = np.frombuffer(answer, np.int64).reshape(-1, 2).T
            np.add.at(change, begin, 1)
            np.add.at(change, end, -1)
        mark = np.cumsum(change[:-1]) > 0
        kept, removed, runs = [], [], []
        for i, text in enumerate(texts):
            own = mark[edges[i] : edges[i + 1]]
            n = int(own.sum())
            rest = np.frombuffer(text, np.uint8)[~own].tobytes() if n else text
            kept.append(hashlib.sha256(rest).hexdigest().encode() if digest else rest)
            removed.append(n)
            runs.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(row["ids"], pa.int64()), pa.array(np.diff(edges)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    return chunks.with_answers(packed, spans, "spans", apply, RESULT)
