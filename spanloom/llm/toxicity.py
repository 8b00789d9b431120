"""Toxicity by nearest labelled examples.

Examples are TF-IDF vectors over the ``TERMS`` terms (words and their beginnings)
that separate the labels best by chi-square, and one term that stands in every text,
so that a text with one such word is not taken for a text full of them.  A text's nearest
``NEAREST`` examples by exact cosine come from a block-max inverted index: examples
stand in blocks of ``BLOCK``, each term keeps its largest weight per block, and
blocks are opened by falling upper bound until none can beat the k-th example.
Their similarity-weighted votes, weighted back to the share of each label among all
labelled rows and smoothed by the overall rate, are the score; their ids are the
evidence.

At most ``EXAMPLES`` labelled rows of each label are used (by rank of a hash of the
id), which bounds the index that is broadcast.  Scoring reads every whole text.

Defined results: null counts as the empty text; a text without any of the terms gets
the smoothed share of toxic ones among all examples that have none either (all are
equally near), and no evidence; with no labels every score is 0.  Ties go to the smaller example number.
A row with several labels counts as toxic if one of them says so.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import fresh, pieces

EXAMPLES = 1500
TERMS = 1024
NEAREST = 15
BLOCK = 64
THRESHOLD = 0.3
PRIOR_WEIGHT = 0.5  # votes that the overall rate counts for
_MIN_CHI = 30.0  # chi-square with one degree of freedom at 4e-8: holds over a vocabulary of a million terms
_WORD = re.compile(r"[^\W\d_]+")
_HEADS = (5, 6)
_COMMON = 4.0  # weight of the term that stands in every text


def terms(text: str) -> Counter:
    """Words of letters, and the beginnings of longer ones."""
    found = Counter(_WORD.findall(text.lower()))
    for word, n in list(found.items()):
        for length in _HEADS:
            if len(word) > length:
                found["^" + word[:length]] += n
    return found


class Index:
    """Block-max inverted index over the examples' unit vectors."""

    def __init__(self, examples: list[tuple[int, int, dict[str, int]]], weights: dict[int, float], n_docs: int, df: dict[str, int]):
        self.vocabulary = {t: i for i, t in enumerate(sorted(df))}
        self.idf = np.array([np.log(1 + n_docs / df[t]) for t in sorted(df)])
        rows = [(doc, y, self.vector(tf)) for doc, y, tf in examples]
        filled = [r for r in rows if r[2][0].size > 1] + [r for r in rows if r[2][0].size == 1]
        # examples with the same strongest term stand together, so block bounds are tight
        filled.sort(key=lambda r: (r[2][0][r[2][1][:-1].argmax()] if r[2][0].size > 1 else len(df), r[0]))
        self.ids = np.array([r[0] for r in filled], np.int64)
        self.label = np.array([r[1] for r in filled], float)
        self.weight = np.array([weights[r[1]] for r in filled])
        blocks = -(-len(filled) // BLOCK)
        self.matrix = np.zeros((len(df) + 1, blocks * BLOCK))
        for i, (_, _, (at, value)) in enumerate(filled):
            self.matrix[at, i] = value
        self.bound = self.matrix.reshape(len(df) + 1, blocks, BLOCK).max(2) if blocks else np.zeros((len(df) + 1, 0))
        toxic = sum(weights[y] for _, y, _ in rows if y)
        total = sum(weights[y] for _, y, _ in rows)
        self.rate = toxic / total if total else 0.0
        bare = [(weights[y], y) for _, y, (at, _) in rows if at.size == 1]
        self.bare = (sum(w for w, y in bare if y) + PRIOR_WEIGHT * self.rate) / (sum(w for w, _ in bare) + PRIOR_WEIGHT) if rows else 0.0
        self.heads = {t[1:] for t in df if t[0] == "^"}
        self.words = {t for t in df if t[0] != "^"}

    def vector(self, tf: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector as (term numbers, weights); the last term stands in every text."""
        known = sorted((self.vocabulary[t], n) for t, n in tf.items() if t in self.vocabulary)
        at = np.array([i for i, _ in known] + [len(self.vocabulary)], np.int64)
        value = np.array([(1 + np.log(n)) * self.idf[i] for i, n in known] + [_COMMON])
        return at, value / np.sqrt((value**2).sum())

    def nearest(self, at: np.ndarray, value: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """Exact top k by cosine (only similarities above 0): places and similarities."""
        place, sim = np.empty(0, np.int64), np.empty(0)
        bounds = value @ self.bound[at]
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= 0 or (len(sim) == k and bounds[block] < sim[-1] - 1e-12):
                break
            own = value @ self.matrix[at, block * BLOCK : (block + 1) * BLOCK]
            hit = np.flatnonzero(own > 0)
            place = np.concatenate((place, hit + block * BLOCK))
            sim = np.concatenate((sim, own[hit]))
            best = np.lexsort((place, -np.round(sim, 12)))[:k]
            place, sim = place[best], sim[best]
        return place, sim

    def score(self, text: str) -> tuple[float, list[int]]:
        found = _WORD.findall(text.lower())
        distinct = set(found)
        if self.words.isdisjoint(distinct) and not any(w[:n] in self.heads for n in _HEADS for w in distinct if len(w) > n):
            return self.bare, []
        at, value = self.vector(terms(text))
        place, sim = self.nearest(at, value)
        votes = sim * self.weight[place]
        total = votes.sum() + PRIOR_WEIGHT * self.rate + PRIOR_WEIGHT * (1 - self.rate)
        return float(min(1.0, (votes @ self.label[place] + PRIOR_WEIGHT * self.rate) / total)), self.ids[place].tolist()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable: Column | None = None, per_label: int = EXAMPLES, n_terms: int = TERMS) -> Index:
    """Build the index from at most ``per_label`` examples of each label."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Index([], {}, 0, {})
    key = F.xxhash64(F.col("doc_id").cast("string"))
    sample = [known.where(F.col("y") == y).orderBy(key, "doc_id").limit(per_label) for y in sorted(counts)]
    picked = sample[0] if len(sample) == 1 else sample[0].unionByName(sample[1])
    # 2 x per_label rows at most are broadcast
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ys, words, ns = [], [], [], []
            for doc, y, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "y", "text")), strict=True):
                for word, n in terms(text).items():
                    ids.append(doc)
                    ys.append(y)
                    words.append(word)
                    ns.append(n)
                if len(ids) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["doc_id", "y", "term", "n"])
                    ids, ys, words, ns = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["doc_id", "y", "term", "n"])

    spelled = texts.mapInArrow(spell, "doc_id long, y int, term string, n long").groupBy("doc_id", "y", "term").agg(F.max("n").alias("n")).persist()
    size = {y: min(n, per_label) for y, n in counts.items()}
    toxic, total = size.get(1, 0), sum(size.values())
    a, n = F.col("a"), F.col("df")
    chi = total * F.pow(a * (total - toxic) - (n - a) * toxic, 2) / (n * (total - n) * float(max(toxic * (total - toxic), 1)))
    ranked = (
        spelled.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("a"))
        .where((n >= 5) & (n < total)).withColumn("chi", chi).where(F.col("chi") >= _MIN_CHI)
        .orderBy(F.desc("chi"), "term").limit(n_terms)
    )
    best = {r["term"]: r["df"] for r in ranked.collect()}
    vectors: dict[int, tuple[int, dict[str, int]]] = {r["doc_id"]: (r["y"], {}) for r in picked.collect()}
    for r in spelled.where(F.col("term").isin(list(best))).collect() if best else []:  # examples x terms at most
        vectors[r["doc_id"]][1][r["term"]] = r["n"]
    spelled.unpersist()
    weights = {y: counts[y] / size[y] / max(counts.values()) * max(size.values()) for y in counts}
    return Index([(d, y, tf) for d, (y, tf) in vectors.items()], weights, total, best)


def score(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """Add ``score``, ``predicted`` and ``evidence`` (ids of the nearest examples, nearest first)."""
    model = docs.sparkSession.sparkContext.broadcast(index)
    kept = [c for c in docs.columns if c not in ("score", "predicted", "evidence")]
    others = [c for c in kept if c != text_col]
    (text,) = fresh(docs, "text_to_score")
    rows = docs.select(*others, F.col(text_col).alias(text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in pieces(batches):
            found = [known.score(t or "") for t in batch.column(text).to_pylist()]
            value = np.array([x for x, _ in found])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32)), pa.array([e for _, e in found], pa.list_(pa.int64()))],
                [*others, "score", "predicted", "evidence"],
            )

    return rows.mapInArrow(run, f"{fields}, score double, predicted int, evidence array<long>")
