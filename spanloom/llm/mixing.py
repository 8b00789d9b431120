"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source gets the same expected number of copies, target / size of
the source, of which the whole part is certain.  The fractional parts are rounded by
duels: two documents move words from one to the other, at random but without bias,
until one of them is at 0 or 1; the sum of fraction x size never changes.  Duels run
along a reduction tree: documents by bucket, what is left of each bucket in buckets of
``FAN`` buckets, and so on, until one fraction is left for each source.  Every task
streams sorted rows and holds one fraction, so no group has to fit in memory.

The last fraction of a source is rounded to the nearer number; the ``RESERVE``
shortest documents of the source (a third of them at most) wait for that and take up the difference.  So the
words taken differ from the target by less than one of those short documents, as long
as they have words enough.

Defined results: null texts and texts without words have size 0 and are never taken;
a null source is a source of its own; repeated rows are rounded each for themselves,
in buckets by id; an empty table gives an empty mix.  The same rows give the same mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import WORD, fresh, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BUCKET = 4096
FAN = 64
RESERVE = 64
_STATE = "doc_id long, source string, size long, nth int, h long, base long, part double, bucket long, reserve boolean, copies long"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Words each source shall give: (source, source_size, target).

    ``sizes`` has a row for each source.  Sources by code point, null last, get the
    weights in turn; a target above ``most`` x size stops there and the excess is shared
    again by weight.  With the caps ordered by cap / weight, the level at which all the
    words are shared is the largest of (words left) / (weight left) over the prefixes of
    sources that may have stopped.
    """
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    ranked = sizes.withColumn("w", F.array(*[F.lit(float(w)) for w in weights])[turn]).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / weight_left)
    level = level.withColumn("level", F.max("level").over(everything))
    return level.select(*sizes.columns, F.least("cap", F.col("level") * F.col("w")).alias("target"))


def duel(pa_: float, wa: float, pb: float, wb: float, u: float) -> tuple[float, float]:
    """Move words between two fractions until one is 0 or 1; fair, and pa * wa + pb * wb stays."""
    up_full, up_empty = (1 - pa_) * wa, pb * wb
    down_full, down_empty = (1 - pb) * wb, pa_ * wa
    up, down = min(up_full, up_empty), min(down_full, down_empty)
    if u * (up + down) < down:
        a = 1.0 if up_full <= up_empty else pa_ + up / wa
        b = 0.0 if up_empty <= up_full else pb - up / wb
    else:
        b = 1.0 if down_full <= down_empty else pb + down / wb
        a = 0.0 if down_empty <= down_full else pa_ - down / wa
    return a, b


def _chance(h: int, level: int) -> float:
    x = (h ^ (level * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 29)) >> 11) / (1 << 53)


def _settled(row: dict, part: float) -> dict:
    return row | {"part": part, "copies": row["base"] + int(part)}


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _shift(reserve: list[dict], owed: float) -> None:
    """Spread ``owed`` words over the fractions of the reserve, as far as they go."""
    room = [((1 - r["part"]) if owed > 0 else r["part"]) * r["size"] for r in reserve]
    total = sum(room)
    if total > 0:
        move = max(-1.0, min(1.0, owed / total))
        for r, x in zip(reserve, room, strict=True):
            r["part"] = min(1.0, max(0.0, r["part"] + move * x / r["size"]))


def _level(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """One level of the tree: in each (source, bucket) at most one fraction is left open (copies null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, at, reserve, schema = None, None, [], None

        def close() -> list[dict]:
            out = []
            if last:
                owed = 0.0
                if open_ is not None:
                    nearest = float(round(open_["part"]))
                    owed = (open_["part"] - nearest) * open_["size"]
                    out.append(_settled(open_, nearest))
                _shift(reserve, owed)
                left = None
                for r in reserve:
                    out, left = _meet(out, left, r, level)
                if left is not None:
                    out.append(_settled(left, float(round(left["part"]))))
            elif open_ is not None:
                out.append(open_)
            return out

        for batch in batches:
            schema, done = batch.schema, []
            for row in batch.to_pylist():
                if at != (row["source"], row["bucket"]):
                    done += close()
                    open_, at, reserve = None, (row["source"], row["bucket"]), []
                if row["reserve"]:
                    reserve.append(row)
                else:
                    done, open_ = _meet(done, open_, row, level)
            if done:
                yield _rows(done, schema)
        if schema is not None and (done := close()):
            yield _rows(done, schema)

    by = ["source", "bucket"]
    return rows.repartition(*by).sortWithinPartitions(*by, "reserve", F.desc("size"), "h", "doc_id", "nth").mapInArrow(run, _STATE)


def _meet(done: list[dict], open_: dict | None, row: dict, level: int) -> tuple[list[dict], dict | None]:
    if row["part"] in (0.0, 1.0):
        done.append(_settled(row, row["part"]))
        return done, open_
    if open_ is None:
        return done, row
    a, b = duel(open_["part"], open_["size"], row["part"], row["size"], _chance(row["h"], level))
    open_, row = open_ | {"part": a}, row | {"part": b}
    if a in (0.0, 1.0):
        done.append(_settled(open_, a))
        open_ = None
    if b in (0.0, 1.0):
        done.append(_settled(row, b))
        return done, open_
    return done, row


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Copies of each document: doc_id, nth (among rows of that id), source, size, source_size, target, copies, taken."""
    rows = written(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("t")), "sizes")
    n = rows.count()
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("source_docs"))
    wanted = written(targets(sizes, weights, share, most), "targets")  # read twice below
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("source", "size", "t"))
    # ids are few per source row; the sources' table is joined as adaptive execution sees fit
    ready = rows.select("doc_id", "source", "size", nth.cast("int").alias("nth")).join(
        wanted.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    h = F.xxhash64(F.col("doc_id"), F.col("nth"))
    ready = ready.withColumns({"h": h, "base": F.floor(each), "part": each - F.floor(each)})
    buckets = max(1, -(-n // BUCKET))
    shortest = F.row_number().over(Window.partitionBy("source").orderBy(F.col("size") == 0, "size", "h", "doc_id", "nth"))
    short = ready.where(F.col("size") > 0).select("source", "doc_id", "nth", "size", "h", "source_docs").withColumn("r", shortest)
    short = short.where((F.col("r") <= RESERVE) & (F.col("r") <= F.col("source_docs") / 3))
    # RESERVE rows a source
    ready = ready.join(short.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("nth").alias("k"), F.lit(True).alias("reserve")), F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("nth") == F.col("k")), "left").drop("s", "d", "k")
    ready = ready.withColumns({
        "reserve": F.coalesce("reserve", F.lit(False)),
        "bucket": F.pmod("h", F.lit(buckets)),
        "part": F.when(F.col("size") > 0, F.col("part")).otherwise(0.0),
        "base": F.when(F.col("size") > 0, F.col("base")).otherwise(0),
        "copies": F.lit(None).cast("long"),
    })
    state = ["doc_id", "source", "size", "nth", "h", "base", "part", "bucket", "reserve", "copies"]
    ready = ready.select(*state)
    waiting = ready.where("reserve").withColumn("bucket", F.lit(0).cast("long"))
    settled, open_, level = [], ready.where("not reserve"), 0
    while True:
        last = buckets == 1
        if last:
            open_ = open_.unionByName(waiting).withColumn("bucket", F.lit(0).cast("long"))
        result = written(_level(open_, level, last), f"mix-{level}")
        settled.append(result.where(F.col("copies").isNotNull()))
        if last:
            break
        buckets, level = -(-buckets // FAN), level + 1
        open_ = result.where(F.col("copies").isNull()).withColumn("bucket", F.floor(F.col("bucket") / FAN))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    out = out.join(wanted.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return out.select("doc_id", "nth", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row as often as :func:`mix` takes it."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("source", words(F.col("text")), F.xxhash64("text"))).cast("int")
    own, picked_id, picked_nth, copies, copy = fresh(docs, "own_nth", "picked_id", "picked_nth", "n_copies", "copy")
    picked = mix(docs, **how).where(F.col("copies") > 0)
    picked = picked.select(F.col("doc_id").alias(picked_id), F.col("nth").alias(picked_nth), F.col("copies").alias(copies))
    rows = docs.withColumn(own, nth).join(picked, F.col("doc_id").eqNullSafe(F.col(picked_id)) & (F.col(own) == F.col(picked_nth)))
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)
