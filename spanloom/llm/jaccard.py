"""N-gram Jaccard join with Bayesian candidate pruning.

Every pair of documents whose sets of five-word shingles have Jaccard similarity of
``THRESHOLD`` or more is a link.

1. Rows with equal shingle sets are one class; the rest works on the number of one of
   its rows, as ids may repeat or be null.
2. A class has ``HASHES`` MinHash values (16 bits each).  Classes that agree in one of
   the bands of ``ROWS`` values are candidates; at similarity 0.8 a pair is missed with
   probability (1 - 0.8^4)^24, about 3 in a million, and less above.
3. A bucket (equal band) is cut into blocks of about ``BLOCK`` members, and each pair of
   blocks is a unit of work, so no bucket has to fit in a task and pairs never become
   rows.  A pair is handled in its first common band only.  Its MinHash values are
   compared ``STEP`` at a time; it is dropped once the posterior probability (uniform
   prior) of similarity >= THRESHOLD is below ``TOLERANCE``.
4. Surviving pairs are verified on the shingle sets of the two blocks.  A unit returns
   the number of links of each member and edges that connect the linked members, at most
   one for each member.
5. Connected classes form a group; its id is its smallest document id.

Defined results: a text of one to four words has these words as its only shingle; texts
without words (also null) have the empty set and are equal to each other and unlike all
others; every row counts for itself, also if its id repeats or is null; the group id
ignores null ids unless there are only such, and groups that share a repeated id share
their group id.  ``n_links`` counts rows, copies included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Words, fresh, grams, mix, partitions, pieces, slices, utf8, written

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 96
ROWS = 4
BANDS = HASHES // ROWS
STEP = 16
ROWS_AT_ONCE = 1024
TOLERANCE = 1e-7
BLOCK = 256
AT_ONCE = 1 << 19
_SLICE = 1 << 20
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text."""
    for _, part in slices(texts, _SLICE):
        w = Words(part)
        all_ = grams(w.hashes, SHINGLE)
        for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True):
            n = b - a
            if n >= SHINGLE:
                yield np.unique(all_[a : b - SHINGLE + 1])
            elif n:
                yield grams(w.hashes[a:b], int(n)) + np.uint64(n)
            else:
                yield np.empty(0, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """``HASHES`` MinHash values of 16 bits."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        low = np.minimum(low, (part[None, :] * _SEEDS[:, None]).min(1))
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


@lru_cache
def least_matches(hashes: int = HASHES, step: int = STEP, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After step, 2 step, ... values: the fewest matches with which a pair stays.

    With m of n equal values the posterior of the similarity is Beta(m + 1, n - m + 1); its
    upper tail at the threshold is the chance of at most m hits in n + 1 trials.
    """
    out = []
    for n in range(step, hashes + 1, step):
        tail = 0.0
        for m in range(n + 2):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out.append(m)
    return tuple(out)


def _spell(docs: DataFrame) -> DataFrame:
    """name, key (of the shingle set), n (its size), sig, shingles (high 32 bits of the hashes, as bytes)."""
    name = docs.schema["name"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            key, n, sig, sets = [], [], [], []
            for s in shingle_sets(utf8(batch.column("text"))):
                # a hash of the set: two sums of scrambled members
                a = int(mix(s).sum(dtype=np.uint64)) if len(s) else 0
                b = int(mix(s ^ np.uint64(0x5555)).sum(dtype=np.uint64)) if len(s) else 0
                key.append(f"{a:016x}{b:016x}{len(s):x}")
                n.append(len(s))
                sig.append(minhash(s).tobytes() if len(s) else b"")
                sets.append(np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(key), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(sets, pa.binary())], ["name", "key", "n", "sig", "shingles"])

    return docs.select("name", "text").mapInArrow(run, f"name {name}, key string, n int, sig binary, shingles binary")


def _pairs_of(group: np.ndarray, side: np.ndarray, crossed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in the same group (rows are sorted by it), some at a time; in a crossed group only across its two sides."""
    at = np.arange(len(group))
    step = 1
    while len(at := at[at + step < len(group)]) and len(at := at[group[at] == group[at + step]]):
        a, b = at, at + step
        keep = ~crossed[a] | (side[a] != side[b])
        yield a[keep], b[keep]
        step += 1


def _survivors(a: np.ndarray, b: np.ndarray, sig: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drop pairs that share an earlier band, then prune by posterior, STEP values at a time."""
    same = np.ones(len(a), bool)
    for j in range(int(band[a].max()) if len(a) else 0):
        late = band[a] > j
        if not late.any():
            break
        x = sig[:, j * ROWS : (j + 1) * ROWS]
        same[late] &= (x[a[late]] != x[b[late]]).any(1)
    a, b = a[same], b[same]
    hits = np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches()):
        part = slice(k * STEP, (k + 1) * STEP)
        hits += (sig[a, part] == sig[b, part]).sum(1)
        keep = hits >= least
        a, b, hits = a[keep], b[keep], hits[keep]
    return a, b


_CHUNK = 1 << 16


def _prune(rows: DataFrame) -> DataFrame:
    """Units with candidates that survive: unit, and the members' ids and pairs as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            unit = _units(table)
            last = int(np.flatnonzero(unit != unit[-1])[-1]) + 1 if (unit != unit[-1]).any() else 0
            rest = table.slice(last)  # the last unit may go on in the next batch
            yield from some(table, unit, last)
        if rest is not None and rest.num_rows:
            yield from some(rest, _units(rest), rest.num_rows)

    def some(table: pa.Table, unit: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        """Whole units, about ROWS_AT_ONCE rows of them at a time: pairs take more room than rows."""
        edges = np.concatenate((np.flatnonzero(np.diff(unit[:end])) + 1, [end])) if end else []
        low = 0
        for edge, after in zip(edges, [*edges[1:], None], strict=True):
            if after is None or after - low > ROWS_AT_ONCE:
                yield from work(table.slice(low, edge - low))
                low = edge

    def _units(table: pa.Table) -> np.ndarray:
        key = table.column("key").to_numpy().astype(np.uint64)
        return mix(key + mix(table.column("band").to_numpy().astype(np.uint64) * np.uint64(1 << 40) + table.column("i").to_numpy().astype(np.uint64) * np.uint64(1 << 20) + table.column("j").to_numpy().astype(np.uint64)))

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        unit = _units(table)
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        band, side = table.column("band").to_numpy(), table.column("blk").to_numpy()
        crossed = table.column("i").to_numpy() != table.column("j").to_numpy()
        rep = table.column("rep").to_numpy()
        left, right = [], []
        for a, b in _pairs_of(unit, side, crossed):
            for at in range(0, len(a), _CHUNK):
                x, y = _survivors(a[at : at + _CHUNK], b[at : at + _CHUNK], sig, band)
                left.append(x)
                right.append(y)
        a, b = np.concatenate(left or [np.empty(0, int)]), np.concatenate(right or [np.empty(0, int)])
        order = np.argsort(unit[a], kind="stable")
        a, b = a[order], b[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(unit[a])) + 1, [len(a)])) if len(a) else [0]
        ids, members, lefts, rights = [], [], [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            who, place = np.unique(np.concatenate((a[s:e], b[s:e])), return_inverse=True)
            ids.append(f"{rep[a[s]]}:{band[a[s]]}:{unit[a[s]]}")
            members.append(rep[who].tolist())
            lefts.append(place[: e - s].astype(np.int32).tobytes())
            rights.append(place[e - s :].astype(np.int32).tobytes())
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(members, pa.list_(pa.int64())), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())], ["unit", "members", "a", "b"])

    return rows.mapInArrow(run, "unit string, members array<long>, a binary, b binary")


def exact(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of sets have the similarity; by a shingle-by-member matrix where that pays."""
    size = np.array([len(s) for s in sets])
    if len(a) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    else:
        table = np.zeros((len(sets), len(sets)), np.float32)
        # shingles of some values at a time, so that long texts do not meet in one array
        stretches = -(-int(size.sum()) // AT_ONCE)
        edges = [(k << 32) // stretches for k in range(stretches)]
        starts = np.array([np.searchsorted(s, np.array(edges, np.uint32)) for s in sets])
        ends = np.column_stack((starts[:, 1:], size))
        for k in range(stretches):
            own = [s[i:j] for s, i, j in zip(sets, starts[:, k], ends[:, k], strict=True)]
            values, place = np.unique(np.concatenate(own), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in own])
            for low in range(0, len(values), 4096):  # bounded columns at a time
                here = (place >= low) & (place < low + 4096)
                part = np.zeros((len(sets), 4096), np.float32)
                part[owner[here], place[here] - low] = 1
                table += part @ part.T
        common = table[a, b].astype(np.int64)
    # in whole numbers: 10 * common >= 8 * union
    return 10 * common >= round(10 * THRESHOLD) * (size[a] + size[b] - common)


def _verify(rows: DataFrame) -> DataFrame:
    """Links and connecting edges of each unit; rows are sorted by unit, the pairs stand in its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in pieces(batches, 2 * BLOCK):  # rows become Python objects
            out: list[tuple[int, int, int]] = []
            for row in batch.to_pylist():
                if held and held[0]["unit"] != row["unit"]:
                    out += unit(held)
                    held = []
                held.append(row)
            if out:
                yield table(out)
        if held and (out := unit(held)):
            yield table(out)

    def table(out: list) -> pa.RecordBatch:
        rep, links, root = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64())], ["rep", "links", "root"])

    def unit(held: list[dict]) -> list[tuple[int, int, int]]:
        held = sorted({r["pos"]: r for r in held}.values(), key=lambda r: r["pos"])
        pairs = next(r for r in held if r["a"] is not None)
        a, b = np.frombuffer(pairs["a"], np.int32), np.frombuffer(pairs["b"], np.int32)
        sets = [np.frombuffer(r["shingles"], np.uint32) for r in held]
        ok = exact(sets, a, b)
        a, b = a[ok], b[ok]
        copies = np.array([r["copies"] for r in held])
        links = np.zeros(len(held), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = np.arange(len(held))
        while True:  # smallest number reachable
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        linked = np.unique(np.concatenate((a, b)))
        return [(held[i]["rep"], int(links[i]), held[root[i]]["rep"]) for i in linked]

    return rows.mapInArrow(run, "rep long, links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component; ``edges`` has a and b.

    Alternates large and small stars, each a shuffle of the edges; the edges never grow
    and the rounds grow with the logarithm of the longest path.  They end when every node
    has either one neighbour, a smaller one, or none but greater ones: edges that are
    stars from the beginning take no round.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).where("m < a AND n > 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low, F.col("a") == F.col("n"))
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = written(small.where("a != b").distinct(), "edges")


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (name, key), classes (key, first name, rep, copies), links of classes (rep, links) and (node, root); ``docs`` has name and text.

    A class is known by a row number, ``rep``; a group's root is the smallest of its classes, which has no node of its own.
    """
    spark = docs.sparkSession
    # row numbers are written with the rows, so they stay
    spelled = written(_spell(docs).withColumn("row", F.monotonically_increasing_id()), "shingles")
    # Equal sets: one class, known by one of its rows.
    classes = spelled.groupBy("key").agg(F.min("name").alias("first"), F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"))
    classes = written(classes, "classes")
    lead = classes.where("n > 0").select("rep", "copies")
    one = spelled.select("row", "sig").join(lead, F.col("row") == F.col("rep")).select("rep", "sig")
    one = written(one, "leads")  # read three times
    bands = one.select("rep", "sig", F.posexplode(F.array(*[F.substring("sig", 2 * ROWS * j + 1, 2 * ROWS) for j in range(BANDS)])).alias("band", "value"))
    bands = bands.select("rep", "band", F.xxhash64("value").alias("bucket"))
    buckets = bands.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = bands.join(buckets, ["bucket", "band"])
    # the signature joins once more, so that buckets of one member never carry it
    met = met.join(one.select(F.col("rep").alias("_r"), "sig"), F.col("rep") == F.col("_r")).drop("_r")
    blocks = F.ceil(F.col("m") / BLOCK)
    met = met.withColumn("nb", blocks).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), (F.col("nb") - 1).cast("int")))
    met = met.select(F.col("bucket").alias("key"), "band", "rep", "sig", "blk", other.alias("o"))
    met = met.select("key", "band", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "rep", "sig")
    met = met.repartition(partitions(spark), "key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j", "rep")
    units = written(_prune(met), "units")
    members = units.select("unit", F.posexplode("members").alias("pos", "rep"), "a", "b")
    first = F.col("pos") == 0
    members = members.select("unit", "pos", "rep", F.when(first, F.col("a")).alias("a"), F.when(first, F.col("b")).alias("b"))
    # Sets move once: straight to the members that need them.
    members = members.join(lead, "rep")
    full = members.join(spelled.select("row", "shingles"), F.col("rep") == F.col("row"))
    full = full.repartition(partitions(spark), "unit").sortWithinPartitions("unit", "pos")
    found = written(_verify(full.select("unit", "pos", "rep", "a", "b", "shingles", "copies")), "links")
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    return spelled.select("name", "key"), classes, found.select("rep", "links"), roots


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id of the linked group) and n_links of every row."""
    rows, classes, found, roots = _linked(docs.select(F.col("doc_id").alias("name"), "text"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # groups of several classes: their names
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    names = roots.join(classes.select("rep", "first"), F.col("rep") == F.col("node")).groupBy("root").agg(F.min("first").alias("name"))
    roots = roots.join(names, "root")
    named = classes.join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    name = F.when(F.col("node").isNull(), F.col("first")).otherwise(F.col("name"))
    named = named.select("key", name.alias("name"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.withColumnRenamed("name", "doc_id").join(named, "key")
    return out.select("doc_id", F.col("name").alias("class_id"), "n_links")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group stays: that of the smallest id, a row without id only in a group of such.

    An id is one document: of its rows the first by text hash stands for it, before groups
    are formed.  Rows without id are documents of their own.
    """
    none, number, h, h2, first, nth = names = fresh(docs, "no_id", "id", "hash", "hash2", "first", "nth")
    # (id, two hashes of the text) tells rows apart, up to equal texts
    rows = docs.select(*docs.columns, F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).alias(number), F.xxhash64("text").alias(h), F.xxhash64(F.lit(1), "text").alias(h2))
    known = [none, number, h, h2]
    several = rows.where(~F.col(none)).groupBy(number).agg(F.min(h).alias(first), F.max(h).alias(nth)).where(F.col(first) != F.col(nth))
    later = several.select(F.col(number).alias("_id"), F.col(first).alias("_first"))
    first_texts = rows.join(later, ~F.col(none) & (F.col(number) == F.col("_id")) & (F.col(h) > F.col("_first")), "left_anti")
    _, classes, _, roots = _linked(first_texts.select(F.struct(*known).alias("name"), "text"))
    groups = classes.join(roots, F.col("rep") == F.col("node"), "left").groupBy(F.coalesce("root", "rep").alias("root"))
    keep = groups.agg(F.min("first").alias("_name")).select("_name.*").toDF(*(f"_{i}" for i in range(len(known))))
    same = [F.col(c) == F.col(f"_{i}") for i, c in enumerate(known)]
    order = Window.partitionBy(*known).orderBy(F.xxhash64(*docs.columns))
    # rows of later texts are in no class, so they need not be told apart again
    kept = rows.join(keep, same, "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return kept.drop(*names).select(*docs.columns)
