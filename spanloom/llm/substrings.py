"""Substring deduplication with suffix automata of reference passages.

A window of ``WINDOW`` words is removed if its word sequence also starts earlier (smaller
id, or earlier in the same document); windows are judged on the input.

Nothing bounds the passages that a corpus repeats, so automata of them are not broadcast
to every task; the passages of a reference shard and the passages to be matched against
it are brought together by a common anchor instead:

1. The anchor of a window is the smallest hash among its five-word runs, so equal windows
   have equal anchors.  Chunks and buckets find the anchors that several chunks have.
2. Each chunk finds its own repeats and sends the windows that come first in it, as runs
   of words with one such anchor, to the anchor's reference shard.
3. A shard takes the runs of an anchor by ascending place.  Each is streamed through the
   suffix automaton of the runs before it; where the matching statistic reaches WINDOW,
   the window starts earlier.  Then the run joins the automaton.  Equal runs are matched
   once.  An anchor with more than ``LARGE`` words of different runs is matched by window
   hashes in arrays, which need less memory.
4. The chunk removes its own repeats and those its shards report.

Words are compared by 32 bits of a 64-bit hash in the automata.

Defined results: a null text has no words; texts shorter than a window lose nothing;
repeated rows of an id stand in the order of their chunks and are repeats of each other;
a null id comes before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm import chunks
from spanloom.llm.common import Words, grams, window_min, written

WINDOW = 20
_RUN = 5
LARGE = 100_000


class SuffixAutomaton:
    """Suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word)

    def _extend(self, last: int, word: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        known = nexts[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, word, known)
        state = len(length)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and word not in nexts[at]:
            nexts[at][word] = state
            at = link[at]
        if at != -1:
            to = nexts[at][word]
            link[state] = to if length[to] == length[at] + 1 else self._clone(at, word, to)
        return state

    def _clone(self, at: int, word: int, to: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(length)
        nexts.append(dict(nexts[to]))
        length.append(length[at] + 1)
        link.append(link[to])
        link[to] = copy
        while at != -1 and nexts[at].get(word) == to:
            nexts[at][word] = copy
            at = link[at]
        return copy

    def matching(self, sequence: list[int]) -> list[int]:
        """For each word the length of the longest match that ends there."""
        state = size = 0
        out = []
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            to = self.next[state].get(word)
            if to is not None:
                state, size = to, size + 1
            out.append(size)
        return out


class _Windows:
    """The windows of a chunk: place of the first word, text number, anchor, and whether it comes first in the chunk."""

    def __init__(self, texts: list[bytes]):
        self.words = w = Words(texts)
        n = len(w.hashes)
        inside = np.ones(max(0, n - WINDOW + 1), bool)
        for edge in w.offsets[1:-1]:
            inside[max(0, edge - WINDOW + 1) : edge] = False
        self.at = np.flatnonzero(inside)
        self.slot = np.searchsorted(w.offsets, self.at, side="right") - 1
        self.anchor = window_min(grams(w.hashes, _RUN), WINDOW - _RUN + 1)[self.at] if len(self.at) else np.empty(0, np.uint64)

    def first(self) -> np.ndarray:
        out = np.zeros(len(self.at), bool)
        if len(self.at):
            out[np.unique(grams(self.words.hashes, WINDOW)[self.at], return_index=True)[1]] = True
        return out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a chunk; it deals with its own repeats itself, so none is flagged."""
    found = np.unique(_Windows(texts).anchor)
    return found, np.zeros(len(found), bool)


_RUNS = "bucket long, chunk long, anchor binary, doc binary, slot binary, start binary, windows binary, words binary"


def _send_runs(packed: DataFrame, shared: DataFrame, n_buckets: int) -> DataFrame:
    def send(row: dict, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not answers:
            return
        x = _Windows(chunks.texts(row))
        known = np.sort(np.frombuffer(b"".join(answers), np.uint64))
        place = np.minimum(np.searchsorted(known, x.anchor), len(known) - 1)
        go = np.flatnonzero((known[place] == x.anchor) & x.first())
        if not len(go):
            return
        at, anchor, slot = x.at[go], x.anchor[go], x.slot[go]
        begins = np.concatenate(([True], (np.diff(at) != 1) | (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])))
        start = np.flatnonzero(begins)
        windows = np.diff(np.concatenate((start, [len(at)])))
        at, anchor, slot = at[start], anchor[start], slot[start]
        bucket = (anchor % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at, anchor, slot, windows, bucket = at[order], anchor[order], slot[order], windows[order], bucket[order]
        size = windows + WINDOW - 1
        ends = np.cumsum(size)
        words = (x.words.hashes >> np.uint64(32)).astype(np.uint32)[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]
        ids = np.array([-(1 << 63) if i is None else i for i in row["ids"]], np.int64)[slot]
        start = (at - x.words.offsets[slot]).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        out: dict[str, list] = {c.split()[0]: [] for c in _RUNS.split(", ")}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            low, high = ends[a] - size[a], ends[b - 1]
            for name, v in (("bucket", int(bucket[a])), ("chunk", row["chunk"]), ("anchor", anchor[a:b].tobytes()), ("doc", ids[a:b].tobytes()), ("slot", slot[a:b].astype(np.int32).tobytes()), ("start", start[a:b].tobytes()), ("windows", windows[a:b].astype(np.int32).tobytes()), ("words", words[low:high].tobytes())):
                out[name].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("bucket", "chunk") else pa.binary()) for k, v in out.items()], list(out))

    return chunks.with_answers(packed, shared, "shared", send, _RUNS)


def earlier(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For runs by ascending place: which of their windows occur in an earlier run."""
    out, seen, fresh = [], set(), []
    for run in runs:
        key = run.tobytes()
        out.append(np.ones(len(run) - WINDOW + 1, bool) if key in seen else None)
        if key not in seen:
            seen.add(key)
            fresh.append(len(out) - 1)
    if len(fresh) == 1:
        out[fresh[0]] = np.zeros(len(runs[fresh[0]]) - WINDOW + 1, bool)
    elif sum(len(runs[i]) for i in fresh) > LARGE:
        hashes = [grams(runs[i].astype(np.uint64), WINDOW) for i in fresh]
        first = np.zeros(sum(map(len, hashes)), bool)
        first[np.unique(np.concatenate(hashes), return_index=True)[1]] = True
        for i, part in zip(fresh, np.split(~first, np.cumsum([len(h) for h in hashes])[:-1]), strict=True):
            out[i] = part
    else:
        automaton = SuffixAutomaton()
        for i in fresh:
            run = runs[i].tolist()
            hit = np.array(automaton.matching(run)[WINDOW - 1 :]) >= WINDOW
            out[i] = hit
            new = np.flatnonzero(~hit)
            if len(new):  # what is known need not join again
                automaton.add(run[new[0] : new[-1] + WINDOW])
    return out


def _match(runs: DataFrame) -> DataFrame:
    """(chunk, removed): windows that start earlier elsewhere, as (text number, first window, windows)."""

    def shard(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        column = {c: np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("anchor", np.uint64), ("doc", np.int64), ("slot", np.int32), ("start", np.int64), ("windows", np.int32), ("words", np.uint32))}
        counts = [len(r["anchor"]) // 8 for r in rows]
        chunk = np.repeat(np.array([r["chunk"] for r in rows]), counts)
        size = column["windows"].astype(np.int64) + WINDOW - 1
        low = np.cumsum(size) - size
        order = np.lexsort((column["start"], column["slot"], chunk, column["doc"], column["anchor"]))
        cuts = np.flatnonzero(np.diff(column["anchor"][order])) + 1
        found: dict[int, list[tuple[int, int, int]]] = {}
        for group in np.split(order, cuts):
            if len(group) == 1:
                continue
            marks = earlier([column["words"][low[i] : low[i] + size[i]] for i in group])
            for i, mark in zip(group, marks, strict=True):
                if mark.all():
                    spans = [(0, len(mark))]
                else:
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], mark, [False]))))
                    spans = [(a, b - a) for a, b in zip(edge[::2], edge[1::2], strict=True)]
                for a, n in spans:
                    found.setdefault(int(chunk[i]), []).append((int(column["slot"][i]), int(column["start"][i]) + int(a), int(n)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([np.array(v, np.int64).tobytes() for v in found.values()], pa.binary())], ["chunk", "removed"])

    return chunks.by_key(runs, "bucket", ["chunk"], shard, "chunk long, removed binary")


RESULT = "doc_id long, n_words long, n_removed long, kept string"


def deduplicate(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that stay, joined by one space (or their SHA-256)."""
    packed = chunks.pack(docs)
    n = chunks.buckets(packed)
    shared = chunks.shared(packed, anchors, n)
    runs = _send_runs(packed, shared, n)
    removed = written(_match(runs), "removed")

    def apply(row: dict, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        texts = chunks.texts(row)
        x = _Windows(texts)
        gone = x.at[~x.first()]
        change = np.zeros(len(x.words.hashes) + WINDOW + 1, np.int64)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + WINDOW, -1)
        if answers:
            slot, start, windows = np.frombuffer(b"".join(answers), np.int64).reshape(-1, 3).T
            begin = x.words.offsets[slot] + start
            np.add.at(change, begin, 1)
            np.add.at(change, begin + windows - 1 + WINDOW, -1)
        covered = np.cumsum(change) > 0
        kept, removed = [], []
        for i, text in enumerate(texts):
            a, b = x.words.offsets[i], x.words.offsets[i + 1]
            mark = covered[a:b]
            out = text.split()  # bytes.split() splits at exactly the six bytes that part words
            if mark.any():
                out = [w for w, c in zip(out, mark.tolist(), strict=True) if not c]
            whole = b" ".join(out)
            kept.append(hashlib.sha256(whole).hexdigest() if digest else whole.decode("utf-8", "replace"))
            removed.append(int(mark.sum()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(row["ids"], pa.int64()), pa.array(np.diff(x.words.offsets).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )

    return chunks.with_answers(packed, removed, "removed", apply, RESULT)
