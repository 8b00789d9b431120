"""Alignment of two tokenizers' tokens over the same texts, and counts of aligned id pairs.

The ends of the A tokens and of the B tokens of a chunk of texts are two sorted lists of byte
offsets.  Merging them gives everything: each distinct end closes one overlap of an A token
with a B token, an end in both lists closes a group.  The merge is divided along its path:
diagonals at equal distances cross the path at points a binary search finds, so the pieces
between them need equal work and none of another's results.  Pieces emit overlaps and common
ends; a common end that a cut has parted is seen by the later piece, and groups that reach
over cuts are stitched from the common ends of all pieces.

Texts are packed into chunks and tokenized once.  A chunk keeps its distinct id pairs with
counts and, for each document, which of them it has how often.  Counts over the corpus are a
grouped sum over the chunks' pairs; they come back to the chunks by a join.  No table of all
pairs is held anywhere.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import partitions, pieces, written

CHUNK_BYTES = 4 << 20
#: Texts given to a tokenizer at once, in bytes: its results are large.
TOKENIZE_BYTES = 256 << 10
#: Steps of the merge path in one piece.
PIECE = 1 << 16
SHIFT = 20  # ids are below 2**20
META = "▁"
RUN = 2_000
# Fixed value: the word pattern of byte-level vocabularies.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokens:
    """A vocabulary: how to encode texts, and the bytes of each id."""

    def __init__(self, encode, entries: list[bytes]):
        self.encode = encode
        self.sizes = np.fromiter(map(len, entries), np.int64, len(entries))
        self.entries = entries
        # an id's decimal digits before a comma, a bar (ends A's part of a group) and a semicolon (ends the group)
        self.spelled = np.array([f"{i}{end}" for end in ",|;" for i in range(len(entries))], object)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.entries[i] for i in ids])


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies: itself if printable Latin-1, else 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def byte_level(path: str) -> Tokens:
    """Tokenizer A: a byte-level BPE file. Special tokens' strings inside texts are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    alphabet = byte_alphabet()
    entries = [b""] * model.get_vocab_size()
    special = {i for i, t in model.get_added_tokens_decoder().items() if t.special}
    for token, i in model.get_vocab().items():
        entries[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    # the same vocabulary and merges in a quicker library: a merge's rank is its token's id
    ranks = {e: i for i, e in enumerate(entries) if i not in special}
    quick = tiktoken.Encoding(path, pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        spaced = [" " + t for t in texts]
        out = [quick.encode_ordinary(t) if steady(t) else None for t in spaced]
        slow = [i for i, ids in enumerate(out) if ids is None]
        if slow:
            for i, found in zip(slow, model.encode_batch_fast([spaced[i] for i in slow], add_special_tokens=False), strict=True):
                out[i] = found.ids
        return out

    return Tokens(encode, entries)


def steady(text: str) -> bool:
    """No run of ``RUN`` or more characters of one kind, space or not: the quick library's pattern search recurses along such a run."""
    words = text.split()
    return max(map(len, words), default=0) < RUN and len(text) - sum(map(len, words)) - len(words) < RUN


@functools.cache
def pieces_of(path: str) -> Tokens:
    """Tokenizer B: a sentence-piece file, which puts a space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        entries.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(META, " ").encode())
    return Tokens(lambda texts: model.encode(texts, num_threads=1), entries)


def crossing(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many elements of ``a`` are among the first ``diagonals`` of the merge of a and b; equal ones of ``a`` come first.

    A binary search on each diagonal, all of them side by side.
    """
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        m = middle[open_]
        before = np.zeros(len(low), bool)
        before[open_] = a[m] <= b[diagonals[open_] - m - 1]
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low


def piece(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps (index in a, index in b) and common ends (the same) that ends a[i0:i1] and b[j0:j1] close."""
    own_a, own_b = a[i[0] : i[1]], b[j[0] : j[1]]
    in_b = j[0] + np.searchsorted(own_b, own_a, "left")
    in_a = i[0] + np.searchsorted(own_a, own_b, "left")
    twice = np.zeros(len(own_b), bool)  # the A token with the same end closes the overlap
    inside = in_a < i[1]
    twice[inside] = a[in_a[inside]] == own_b[inside]
    if i[0] and len(own_b):  # that token may lie before the cut
        twice |= own_b == a[i[0] - 1]
    links_a = np.concatenate([np.arange(i[0], i[1]), in_a[~twice]])
    links_b = np.concatenate([in_b, np.arange(j[0], j[1])[~twice]])
    ends_b = np.flatnonzero(twice) + j[0]
    return links_a, links_b, np.searchsorted(a, b[ends_b], "left"), ends_b


def merge(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps and common ends of two sorted lists of token ends, piece by piece along the merge path."""
    steps = len(a) + len(b)
    diagonals = np.append(np.arange(0, steps, size), steps)
    i = crossing(a, b, diagonals)
    j = diagonals - i
    parts = [piece(a, b, (i[p], i[p + 1]), (j[p], j[p + 1])) for p in range(len(diagonals) - 1)]
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def encode(texts: list[str], first: Tokens, second: Tokens) -> list[tuple[list[int], list[int]]]:
    """A's and B's ids of each text; none where the text is empty or their bytes are not those of space and text."""
    out, at = [], 0
    while at < len(texts):
        till, held = at, 0
        while till < len(texts) and (till == at or held + len(texts[till]) <= TOKENIZE_BYTES):
            held += len(texts[till])
            till += 1
        part = texts[at:till]
        for text, a, b in zip(part, first.encode(part), second.encode(part), strict=True):
            whole = b" " + text.encode("utf-8", "surrogatepass")
            same = text and first.joined(a) == whole and second.joined(b) == whole
            out.append((a, b) if same else ([], []))
        at = till
    return out


def spell(first: Tokens, second: Tokens, a: np.ndarray, b: np.ndarray, close_a: np.ndarray, close_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3`` of one document; ``close_`` are the indexes of the last tokens of its groups."""
    if not len(a):
        return b""
    group_a = np.searchsorted(close_a, np.arange(len(a)))
    group_b = np.searchsorted(close_b, np.arange(len(b)))
    before_b = np.concatenate(([0], close_b + 1))
    out = np.empty(len(a) + len(b), object)
    kind_a = np.zeros(len(a), np.int64)
    kind_a[close_a] = 1
    kind_b = np.zeros(len(b), np.int64)
    kind_b[close_b] = 2
    out[np.arange(len(a)) + before_b[group_a]] = first.spelled[kind_a * len(first.entries) + a]
    out[np.arange(len(b)) + close_a[group_b] + 1] = second.spelled[kind_b * len(second.entries) + b]
    return "".join(out.tolist())[:-1].encode()


_CHUNK = "chunk long, pairs array<long>, counts array<int>, docs binary"


class Paths:
    def __init__(self, byte_level_file: str, pieces_file: str):
        self.first, self.second = byte_level_file, pieces_file

    def load(self) -> tuple[Tokens, Tokens]:
        return byte_level(self.first), pieces_of(self.second)


def align_chunk(ids: list, texts: list[str | None], first: Tokens, second: Tokens, groups: bool = False, size: int = PIECE) -> dict:
    """Everything of a chunk but the corpus counts."""
    texts = [t or "" for t in texts]
    distinct = list(dict.fromkeys(texts))  # copies are tokenized once
    encoded = dict(zip(distinct, encode(distinct, first, second), strict=True))
    place = {t: k for k, t in enumerate(distinct)}
    n_a = np.array([len(encoded[t][0]) for t in distinct], np.int64)
    n_b = np.array([len(encoded[t][1]) for t in distinct], np.int64)
    a = np.fromiter((i for t in distinct for i in encoded[t][0]), np.int64, n_a.sum())
    b = np.fromiter((i for t in distinct for i in encoded[t][1]), np.int64, n_b.sum())
    ends_a, ends_b = np.cumsum(first.sizes[a]), np.cumsum(second.sizes[b])
    links_a, links_b, close_a, close_b = merge(ends_a, ends_b, size)
    from_a, from_b = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
    cut = np.searchsorted(close_a, from_a)  # every text ends a group, so no group reaches over texts
    digests, spelled = [], []
    for k in range(len(distinct)):
        own = slice(cut[k], cut[k + 1])
        text = spell(first, second, a[from_a[k] : from_a[k + 1]], b[from_b[k] : from_b[k + 1]], close_a[own] - from_a[k], close_b[own] - from_b[k])
        digests.append(hashlib.sha256(text).hexdigest() if n_a[k] else "")
        spelled.append(text.decode() if groups else None)
    pair = (a[links_a] << SHIFT) | b[links_b]
    pairs, which = np.unique(pair, return_inverse=True)
    owner = np.searchsorted(from_a, links_a, "right") - 1
    n_links = np.bincount(owner, minlength=len(distinct))
    # each text's distinct pairs and how often it has them
    key, often = np.unique(owner * len(pairs) + which, return_counts=True) if len(pairs) else (np.empty(0, np.int64), np.empty(0, np.int64))
    text_of, pair_of = (key // len(pairs), key % len(pairs)) if len(pairs) else (key, key)
    copies = np.bincount([place[t] for t in texts], minlength=len(distinct))
    counts = np.bincount(pair_of, weights=often * copies[text_of], minlength=len(pairs)).astype(np.int64)
    return {
        "pairs": pairs, "counts": counts, "ids": ids, "text": np.array([place[t] for t in texts], np.int32), "n_a": n_a, "n_b": n_b, "n_groups": np.diff(cut),
        "n_links": n_links, "digests": digests, "groups": spelled, "from": np.searchsorted(text_of, np.arange(len(distinct) + 1)), "pair": pair_of.astype(np.int32), "often": often.astype(np.int32),
    }


_ARRAYS = {"text": np.int32, "n_a": np.int64, "n_b": np.int64, "n_groups": np.int64, "n_links": np.int64, "from": np.int64, "pair": np.int32, "often": np.int32}


def freeze(found: dict) -> bytes:
    """What a chunk keeps until its pairs' counts are known."""
    head = json.dumps({"ids": found["ids"], "digests": found["digests"], "groups": found["groups"], "sizes": {k: len(found[k]) for k in _ARRAYS}}).encode()
    body = b"".join(np.ascontiguousarray(found[k], t).tobytes() for k, t in _ARRAYS.items())
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(8, "little") + head + body)


def thaw(data: bytes) -> dict:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at = 8 + int.from_bytes(raw[:8], "little")
    out = json.loads(raw[8:at])
    for k, t in _ARRAYS.items():
        size = out["sizes"][k] * np.dtype(t).itemsize
        out[k] = np.frombuffer(raw[at : at + size], t)
        at += size
    return out


def chunks(docs: DataFrame, paths: Paths, groups: bool, chunk_bytes: int) -> DataFrame:
    """Documents packed into chunks, tokenized and aligned; written. A longer text stands alone."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        ids, texts, held = [], [], 0
        for batch in pieces(batches, 256):
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                size = len(text) if text else 0
                if ids and held + size > chunk_bytes:
                    yield ids, texts
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(text)
                held += size + 64
        if ids:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = paths.load()
        chunk = TaskContext.get().partitionId() << 33
        for ids, texts in pack(batches):
            found = align_chunk(ids, texts, first, second, groups)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([found["pairs"]], pa.list_(pa.int64())), pa.array([found["counts"]], pa.list_(pa.int64())), pa.array([freeze(found)], pa.binary())],
                ["chunk", "pairs", "counts", "docs"],
            )
            chunk += 1

    return written(docs.select("doc_id", "text").mapInArrow(run, "chunk long, pairs array<long>, counts array<long>, docs binary"), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold a pair, and whether no pair of the same B id has more; written."""
    opened = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    counted = opened.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    counted = written(counted, "pair-counts")
    b = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    most = counted.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counted.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def align(docs: DataFrame, byte_level_file: str, pieces_file: str, groups: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): sizes of its alignment and how its links count in the corpus.

    ``groups`` asks for the groups themselves as text (``a1,a2|b1;a3|b2,b3``); their SHA-256 is always given.  The files
    are those of the two tokenizers, at the same path on every node.

    Null and empty texts, and texts whose joined A or B bytes are not space and text (a U+2581 inside, say), have no
    tokens: zeros, and '' for the digest and the groups.  Texts of any length are tokenized and merged whole.  Repeated rows
    count each for themselves; ids may repeat or be null.  An empty table gives no rows.  Other columns, whatever their
    names, are left out.
    """
    aligned = chunks(docs, Paths(byte_level_file, pieces_file), groups, chunk_bytes)
    counts = pair_counts(aligned)
    asked = aligned.select("chunk", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair")
    answers = asked.groupBy("chunk").agg(F.collect_list(F.struct("at", "n", "best")).alias("known"))  # a chunk's own pairs
    answers = answers.select("chunk", F.col("known.at").alias("at"), F.col("known.n").alias("n"), F.col("known.best").alias("best"))

    def flat(column: pa.Array) -> np.ndarray:
        return column[0].values.to_numpy(zero_copy_only=False) if column[0].is_valid else np.empty(0, np.int64)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            found = thaw(batch.column("docs")[0].as_py())
            at = flat(batch.column("at"))
            n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            n[at], best[at] = flat(batch.column("n")), flat(batch.column("best"))
            sums = np.concatenate(([0], np.cumsum(found["often"] * n[found["pair"]])))[found["from"]]
            bests = np.concatenate(([0], np.cumsum(found["often"] * best[found["pair"]])))[found["from"]]
            text = found["text"]
            columns = [found["n_a"], found["n_b"], found["n_groups"], found["n_links"], np.diff(bests), np.diff(sums)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found["ids"], pa.int64()), *[pa.array(c[text].astype(np.int64)) for c in columns],
                    pa.array([found["digests"][t] for t in text.tolist()], pa.string()), pa.array([found["groups"][t] for t in text.tolist()], pa.string()),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"],
            )

    both = aligned.select("chunk", "docs").join(answers, "chunk", "left")
    out = both.repartition(partitions(docs.sparkSession), "chunk").mapInArrow(total, _OUT)
    return out if groups else out.drop("groups")
