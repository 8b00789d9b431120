"""Benchmark decontamination by SimHash of item-sized windows.

1. Windows.  A window as long as an item may begin at any word.  It is of interest if so
   many of its shingles of five words are shingles of items of that length that the
   similarity can reach ``THRESHOLD``; every other window is below it.  Shingles of all
   documents are looked up among the items' shingles.
2. Fingerprints.  SimHash (64 bits) of each such window and of each item; a shingle
   counts as often as it occurs.
3. Multi-index search.  The 64 bits are four blocks of 16.  If two fingerprints differ in
   at most ``RADIUS`` = 15 bits, some block differs in at most three, so the items'
   blocks with all changes of up to three bits find every fingerprint within the radius.
4. Check.  Exact weighted-shingle similarity (sum of the smaller counts over the sum of
   the larger ones) of at least ``THRESHOLD``.

Only DataFrame functions are used.  What is broadcast comes from the benchmark and is
counted first; a benchmark of more than ``BROADCAST_ROWS`` rows is joined by shuffle.

Defined results: null and empty texts match nothing, and so do texts and items of fewer
than five words; windows are cut at the ends of the text; repeated rows of an id count
as one text each, as do rows without id, and the best window of the id is given; of
equally similar windows the first that has a shingle at its place in the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import WORD, fresh, written

SHINGLE = 5
RADIUS = 15
BLOCKS = 4
THRESHOLD = 0.8
BROADCAST_ROWS = 1_000_000
_BLOCK_BITS = 64 // BLOCKS


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def shingles(w: Column) -> Column:
    """Hashes of all runs of five words, in order."""
    return F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[w[i + k] for k in range(1, SHINGLE)]),
    )


def fingerprints(rows: DataFrame, keys: list[str], shingle: str) -> DataFrame:
    """SimHash of the ``shingle`` rows of each key."""
    votes = [F.sum(F.shiftright(shingle, i).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"_b{i}") for i in range(64)]
    bits = [F.shiftleft(F.when(F.col(f"_b{i}") > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"), i) for i in range(64)]
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return rows.groupBy(*keys).agg(*votes).select(*keys, fp.alias("fp"))


def _blocks(fp: Column) -> Column:
    """(number, value) of the four 16-bit blocks."""
    mask = (1 << _BLOCK_BITS) - 1
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, i * _BLOCK_BITS).bitwiseAND(F.lit(mask)).cast("int").alias("value")) for i in range(BLOCKS)])


def _near(items: DataFrame) -> DataFrame:
    """The items' blocks with every change of up to RADIUS // BLOCKS bits."""
    masks = [m for m in range(1 << _BLOCK_BITS) if m.bit_count() <= RADIUS // BLOCKS]  # 697
    own = items.select("item_id", F.col("fp").alias("item_fp"), F.inline(_blocks(F.col("fp"))))
    own = own.select("*", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    return own.select("item_id", "item_fp", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of shingle hashes, counts as weights.

    Numbering the repeats of a hash turns the bags into sets.
    """
    common = F.size(F.array_intersect(_numbered(a), _numbered(b)))
    return common / (F.size(a) + F.size(b) - common)


def _numbered(a: Column) -> Column:
    """The k-th repeat of a hash becomes a hash of its own; the sorted array is made once."""
    repeated = F.transform(
        F.array(F.sort_array(a)),
        lambda s: F.transform(s, lambda x, i: F.when(F.array_position(s, x) == i + 1, x).otherwise(F.xxhash64(x, i + 1 - F.array_position(s, x)))),
    )
    return F.when(F.size(F.array_distinct(a)) == F.size(a), a).otherwise(F.get(repeated, F.lit(0)))


def _spans(n_doc: Column, n: Column, at: Column) -> Column:
    """(start, end, cut) of the windows of ``n`` words that may reach the threshold; ``cut`` words lie before the text.

    ``at`` are the sorted places of shingles of items of ``n`` words.  A window with k of
    them and w shingles has a similarity of at most k / (w + n - 4 - k).
    """
    share = THRESHOLD / (1 + THRESHOLD)
    own = n - (SHINGLE - 1)
    least = _least(n)  # of any window: w is k at least
    end = lambda a: F.least(a + n, n_doc)

    def enough(i: Column, a: Column) -> Column:
        wanted = F.ceil((end(a) - F.greatest(a, F.lit(0)) - (SHINGLE - 1) + own) * share - 1e-6).cast("int")
        return F.coalesce(F.get(at, i + wanted - 1) <= end(a) - SHINGLE, F.lit(False))

    def starts(i: Column) -> Column:
        """Starts whose first hit is the i-th."""
        low = F.greatest(F.get(at, i + least - 1) - n + SHINGLE, F.when(i > 0, F.get(at, i - 1) + 1))
        all_ = F.when(low <= F.get(at, i), F.sequence(low, F.get(at, i))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(all_, lambda a: enough(i, a)), lambda a: F.struct(F.greatest(a, F.lit(0)).alias("start"), end(a).alias("end"), F.greatest(-a, F.lit(0)).alias("cut")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - least), starts))


def _least(n: Column) -> Column:
    return F.greatest(F.ceil((n - (SHINGLE - 1)) * THRESHOLD - 1e-6), F.lit(1)).cast("int")


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Windows that match: doc_id, hash (of the text), item_id, similarity, distance, start, end, moved (no shingle at its place)."""
    spelled = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= SHINGLE)
    # items and windows are read several times: plans that repeat what makes them would be large
    spelled = written(spelled.select("item_id", F.size("w").alias("n"), shingles(F.col("w")).alias("item_shingles")), "items")
    known = spelled.select("n", F.explode("item_shingles").alias("h")).distinct()
    n_known = known.count()
    # an id may stand for several texts
    text = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.col("text").alias("_text"))
    own = text.select("doc_id", "hash", words(F.col("_text")).alias("w")).where(F.size("w") >= SHINGLE)
    own = own.select("doc_id", "hash", F.size("w").alias("n_doc"), shingles(F.col("w")).alias("s"))
    # posexplode_outer: for the inner form the optimizer adds a filter on the array's size
    # below the projection, where the words are found anew for each element
    hits = own.select("doc_id", "hash", "n_doc", F.posexplode_outer("s").alias("at", "h")).join(_small(known, n_known), "h")
    runs = hits.groupBy("doc_id", "hash", "n_doc", "n").agg(F.collect_set("at").alias("at")).where(F.size("at") >= _least(F.col("n")))
    runs = runs.select("doc_id", "hash", "n_doc", "n", F.sort_array("at").alias("at"))
    # inline_outer for the same reason: the arrays would be sorted anew for each element
    runs = runs.select("doc_id", "hash", F.inline_outer(_spans(F.col("n_doc"), F.col("n"), F.col("at")))).where(F.col("start").isNotNull())
    wanted = runs.groupBy(F.col("doc_id").alias("_d"), F.col("hash").alias("_h")).agg(F.collect_set(F.struct("start", "end", "cut")).alias("spans"))
    windows = text.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("hash") == F.col("_h")))
    windows = windows.select("doc_id", "hash", "spans", words(F.col("_text")).alias("w"))
    windows = windows.select("doc_id", "hash", "spans", shingles(F.col("w")).alias("s"))
    windows = windows.select("doc_id", "hash", "s", F.inline("spans"))
    bag = F.slice("s", F.col("start") + 1, F.col("end") - F.col("start") - (SHINGLE - 1))
    windows = windows.select("doc_id", "hash", "start", "end", "cut", bag.alias("bag"))

    # equal windows of many documents have one fingerprint and are checked once
    windows = written(windows.withColumn("key", F.xxhash64("bag")), "windows")
    distinct = windows.groupBy("key", "cut").agg(F.first("bag").alias("bag"))
    prints = fingerprints(distinct.select("key", "cut", F.explode("bag").alias("h")), ["key", "cut"], "h")
    item_prints = fingerprints(spelled.select("item_id", F.explode("item_shingles").alias("h")), ["item_id"], "h")
    # 2,788 rows an item: the planner takes them for as small as the items and would send them to all
    found = prints.select("key", "cut", "fp", F.inline(_blocks(F.col("fp")))).join(_near(item_prints).hint("shuffle_hash"), ["block", "value"])
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    found = found.where(distance <= RADIUS).select("key", "cut", "item_id", distance.alias("distance")).distinct()
    pairs = found.join(distinct, ["key", "cut"]).join(spelled.select("item_id", "item_shingles"), "item_id")
    placed = F.exists(F.zip_with("bag", F.slice("item_shingles", F.col("cut") + 1, F.size("item_shingles")), lambda x, y: x.eqNullSafe(y) & x.isNotNull()), lambda x: x)
    pairs = pairs.select("key", "cut", "item_id", "distance", similarity(F.col("bag"), F.col("item_shingles")).alias("similarity"), (~placed).alias("moved"))
    pairs = pairs.where(F.col("similarity") >= THRESHOLD)
    return windows.select("doc_id", "hash", "start", "end", "key", "cut").join(pairs, ["key", "cut"]).drop("key", "cut")


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Contaminated pairs: doc_id, item_id, similarity, start (word), n_words (of the window), distance (bits).

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    order = F.struct((-F.col("similarity")).alias("s"), "moved", "start", "end", "distance")
    out = _windows(docs, items).groupBy("doc_id", "item_id").agg(F.min(order).alias("best"))
    return out.select("doc_id", "item_id", (-F.col("best.s")).alias("similarity"), F.col("best.start").alias("start"), (F.col("best.end") - F.col("best.start")).alias("n_words"), F.col("best.distance").alias("distance"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a match."""
    bad, text = fresh(docs, "bad_id", "bad_text")
    found = _windows(docs.select("doc_id", "text"), items).select(F.col("doc_id").alias(bad), F.col("hash").alias(text)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(bad)) & (F.xxhash64("text") == F.col(text)), "left_anti")
