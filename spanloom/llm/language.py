"""Language identification by prediction by partial matching (PPM).

Every language gets a tree of byte contexts of orders 0 to 3 with escape
probabilities (method C, no exclusions).  The trees are frozen after training, so
the code length of a byte depends on its context alone and is a table lookup:
all bytes of a task's texts are scored by array operations, for all languages at
once.

Training takes at most ``TRAIN_DOCS`` whole texts of each language and ends with the
one that passes ``TRAIN_DOCS * TRAIN_BYTES`` bytes: texts of at most ``TRAIN_BYTES`` by
hash of the id, longer ones only where these are too few.  That bounds the task that
fits the trees and the tables that are broadcast; more than ``MAX_LANGUAGES`` languages
are refused.  Scoring reads every byte of every text.

Defined results: a null text or a text without a letter is ``und`` with score 0;
with no training rows every text is ``und``; ties go to the language that is first
by code point; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import pieces, slices

TRAIN_DOCS = 300
TRAIN_BYTES = 16_384
MAX_LANGUAGES = 512
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = regex.compile(r"[A-Za-z]")
_SCALE = 256.0  # code lengths are kept in 1/256 bit
_SLICE = 1 << 19


class ContextTrees:
    """Frozen context trees of all languages as lookup tables.

    ``symbol`` maps bytes to symbols: 0 begins a text, 1 stands for bytes not seen in
    training.  ``context`` maps the last three symbols to the longest context kept
    (order 3 if any language saw it, else order 2); ``cost`` has a row for each
    (context, next symbol) with the code length in each language.
    """

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        own = {lang: [_bytes(t) for t in texts[lang]] for lang in self.languages}
        seen = np.unique(np.frombuffer(b"".join(b"".join(x) for x in own.values()), np.uint8))
        self.symbol = np.ones(256, np.uint8)
        self.symbol[seen] = np.arange(2, 2 + len(seen), dtype=np.uint8)
        self.size = s = 2 + len(seen)
        spelled = {lang: self._spell(own[lang]) for lang in self.languages}
        contexts = np.unique(np.concatenate([c for c, _ in spelled.values()] or [np.empty(0, np.int64)]))
        self.context = np.arange(s**3, dtype=np.int32) % (s * s)
        self.context[contexts] = s * s + np.arange(len(contexts), dtype=np.int32)
        self.cost = np.stack(
            [self._lengths(*spelled[lang], contexts) for lang in self.languages], axis=-1
        ).reshape(-1, len(self.languages)) if self.languages else np.zeros((0, 0), np.uint16)

    def _spell(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Order-3 context and symbol of every byte."""
        s, parts, nexts = self.size, [], []
        for text in texts:
            x = np.concatenate((np.zeros(3, np.int64), self.symbol[np.frombuffer(text, np.uint8)]))
            parts.append((x[:-3] * s + x[1:-2]) * s + x[2:-1])
            nexts.append(x[3:])
        return np.concatenate(parts), np.concatenate(nexts)

    def _lengths(self, before: np.ndarray, symbol: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Code lengths (contexts of order 2, then those of order 3) x symbols."""
        s = self.size
        p = np.full(s, 1.0 / s)
        for order in (0, 1, 2):
            n = np.bincount(before % s**order * s + symbol, minlength=s**order * s).reshape(-1, s)
            p = _escape(n, np.tile(p.reshape(-1, s), (n.shape[0] // p.reshape(-1, s).shape[0], 1)))
        rank = np.searchsorted(contexts, before)
        n = np.bincount(rank * s + symbol, minlength=len(contexts) * s).reshape(-1, s)
        p = np.concatenate((p, _escape(n, p[contexts % (s * s)])))
        return np.minimum(np.rint(-np.log2(p) * _SCALE), 65_535).astype(np.uint16)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits to code each whole text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        for first, part in slices(texts, _SLICE):
            if len(part) == 1:  # a long text goes in pieces that overlap by the context
                for at in range(0, len(part[0]), _SLICE):
                    out[first] += self._sum([part[0][max(0, at - 3) : at + _SLICE]], min(at, 3))[0]
            else:
                out[first : first + len(part)] = self._sum(part, 0)
        return out / _SCALE

    def _sum(self, texts: list[bytes], known: int) -> np.ndarray:
        s, gap = self.size, 3
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(n + gap)
        x = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        inside = np.ones(len(x), bool)
        for i in range(gap):
            inside[ends - n - 1 - i] = False
        x[inside] = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        if known:  # the first bytes are context only
            x, inside, ends = x[gap:], inside[gap:], ends - gap
            inside[:known] = False
        at = np.flatnonzero(inside)
        context = self.context[(x[at - 3] * s + x[at - 2]) * s + x[at - 1]].astype(np.int64)
        total = np.concatenate((np.zeros((1, len(self.languages)), np.int64), self.cost[context * s + x[at]].cumsum(0, dtype=np.int64)))
        coded = n.copy()
        coded[:1] -= known
        place = np.concatenate(([0], np.cumsum(coded)))
        return (total[place[1:]] - total[place[:-1]]).astype(float)


def _escape(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Method C: a context seen n times with d symbols escapes with probability d / (n + d)."""
    n, d = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    own = counts / np.maximum(n + d, 1)
    return np.where(counts > 0, own, np.where(n > 0, d / np.maximum(n + d, 1), 1.0) * lower)


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def train(docs: DataFrame, lang: str = "lang", usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", per_language: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> ContextTrees:
    """Fit the trees on at most ``per_language`` whole texts of each language, in a task; the driver gets the tables.

    Texts of up to ``max_bytes`` come first, by hash; a language that lacks them takes longer ones, the shortest first.
    Its texts end with the one that passes ``per_language * max_bytes`` bytes.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text_col).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    # Places are ranked without the texts; each task sends the window its first few of a language.
    size = F.octet_length(text_col)
    key = F.struct(F.when(size > max_bytes, size).otherwise(0).alias("long"), F.xxhash64(F.col(id_col).cast("string"), F.xxhash64(text_col)).alias("hash"))
    order = Window.partitionBy("lang").orderBy("key")
    ranked = rows.select(F.col(lang).alias("lang"), key.alias("key"), size.cast("long").alias("size")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = ranked.withColumn("before", before).where(F.col("before") < per_language * max_bytes).groupBy("lang").agg(F.max("key").alias("last"))
    languages = last.count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"{languages} languages: the trees of more than {MAX_LANGUAGES} are not meant to be held by every task")
    # MAX_LANGUAGES rows at most are broadcast
    picked = rows.select(F.col(lang).alias("lang"), F.col(text_col).alias("text"), key.alias("key"))
    picked = picked.join(F.broadcast(last), "lang").where(F.col("key") <= F.col("last")).dropDuplicates(["lang", "key"]).select("lang", "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[str]] = {}  # bounded: a byte budget for each language
        for batch in batches:
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts.setdefault(name, []).append(text)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(ContextTrees(texts))], pa.binary())], ["trees"])

    found = picked.repartition(1).mapInArrow(fit, "trees binary").collect()
    return pickle.loads(found[0]["trees"]) if found else ContextTrees({})


def identify(docs: DataFrame, trees: ContextTrees, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (posterior of that language under equal priors) and ``bits_per_byte``."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in pieces(batches):
            texts = batch.column(text_col).to_pylist()
            found = [bool(t) and bool(_ASCII_LETTER.search(t) or _LETTER.search(t)) for t in texts]
            if not known.languages:
                found = [False] * len(texts)
            best = [UNKNOWN] * len(texts)
            value = np.zeros(len(texts))
            rate = np.zeros(len(texts))
            at = [i for i, x in enumerate(found) if x]
            if at:
                data = [_bytes(texts[i]) for i in at]
                bits = known.code_lengths(data)
                first = bits.argmin(1)
                least = bits[np.arange(len(at)), first]
                posterior = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                for k, i in enumerate(at):
                    best[i] = known.languages[first[k]]
                value[at] = posterior
                rate[at] = least / np.maximum([len(x) for x in data], 1)
            arrays = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(best, pa.string()), pa.array(value), pa.array(rate)], [*kept, "lang_pred", "score", "bits_per_byte"])

    return docs.select(*kept).mapInArrow(score, f"{fields}, lang_pred string, score double, bits_per_byte double")
