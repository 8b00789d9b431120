"""Interval operators: nesting, begin/end pairing and overlaps.

Everything is cut into stretches of rows, not of time, so that no key and no moment,
however hot, has to fit one task, and no operator compares all rows of a key with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.ordered import range_slices, sliced_window
from spanloom.session import cut

ROWS_PER_SLICE = 65_536
_NEVER = np.iinfo(np.int64).min


def pair_begin_end(events: DataFrame, keys: list[str]) -> DataFrame:
    """Match every end with the latest begin of its key when nothing lies between.

    ``keys`` are trace, process, thread and name.  ``events`` need ``ph``,
    ``ts_ns``, ``seq`` and ``args`` (map).  A second begin replaces an open one,
    and an end closes it, so an end pairs exactly when the event before it is a
    begin.  End arguments win over begin arguments.
    """
    marks = range_slices(events.where(F.col("ph").isin("B", "E")), keys, ["ts_ns", "seq"])
    seen = sliced_window(
        marks, keys, "_slice", ["ts_ns", "seq"],
        lags={"_before": F.struct("ph", "ts_ns", "args", "seq", "cat")}, write_input=False,
    )
    none = F.create_map().cast("map<string,string>")
    return seen.where((F.col("ph") == "E") & (F.col("_before.ph") == "B")).select(
        *[c for c in events.columns if c not in ("ph", "ts_ns", "dur_ns", "args", "seq", "cat")],
        F.lit("X").alias("ph"),
        F.col("_before.ts_ns").alias("ts_ns"),
        (F.col("ts_ns") - F.col("_before.ts_ns")).alias("dur_ns"),
        F.map_concat(F.coalesce("_before.args", none), F.coalesce("args", none)).alias("args"),
        F.col("_before.cat").alias("cat"),
        "seq",
    )


def last_before(ends: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each (place, start) the last index below ``place`` whose end is greater than ``start``; -1 for none.

    A tree of block maxima, climbed and descended by all queries side by side: 2 log2(n) array operations.
    """
    levels = [ends]
    while len(levels[-1]) > 1:
        low = levels[-1]
        if len(low) % 2:
            low = np.append(low, _NEVER)
            levels[-1] = low
        levels.append(np.maximum(low[::2], low[1::2]))
    edge, block, height = places.copy(), np.full(len(places), -1), np.zeros(len(places), np.int64)
    for k, level in enumerate(levels):
        look = np.flatnonzero((block < 0) & (edge % 2 == 1))
        left = edge[look] - 1
        hit = level[left] > starts[look]
        block[look[hit]], height[look[hit]] = left[hit], k
        edge = edge // 2
    for k in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero((block >= 0) & (height == k))
        right = block[down] * 2 + 1
        block[down] = right - (levels[k - 1][right] <= starts[down])
        height[down] = k - 1
    return block


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one unit at a time; units come in order."""
    unit, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("_unit").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and own[a] != unit:
                yield pa.Table.from_batches(held)
                held = []
            unit = own[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _groups(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Number the runs of equal keys."""
    change = np.zeros(rows.num_rows, bool)
    for key in keys:
        codes = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= np.diff(codes) != 0
    return np.cumsum(change)


def _numbers(rows: pa.Table, *columns: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy() for c in columns]


_ROW, _LEFT_OPEN, _UNIT = 0, 1, 2


def _match(keys: list[str]):
    """Match the points of each unit; what a unit cannot know goes out as its effect on others.

    Three kinds of rows: every opening with its innermost event as far as the unit shows it, the events a
    key's part of the unit leaves open (outermost to innermost), and one row for that part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches):
            group = _groups(rows, keys)
            unit, at, kind, neg, seq = _numbers(rows, "_unit", "at", "kind", "neg", "seq")
            first = np.searchsorted(group, np.arange(group[-1] + 1))
            head = first[group]
            start = np.where(kind == 1, at, at + neg)
            same = (start == at[head]) & (kind[head] == 1)
            here = (start > at[head]) | ((start == at[head]) & (kind[head] == 0)) | (same & ((neg > neg[head]) | ((neg == neg[head]) & (seq >= seq[head]))))
            opens = np.flatnonzero(kind == 1)
            early = np.flatnonzero((kind == 0) & ~here)  # they close here and opened in an earlier unit
            early = early[np.lexsort((seq[early], neg[early], start[early], group[early]))]
            known = np.concatenate([early, opens])
            known = known[np.lexsort((np.arange(len(known)), kind[known], group[known]))]
            ends = np.where(kind[known] == 1, at[known] - neg[known], at[known])
            place = np.empty(rows.num_rows, np.int64)
            place[known] = np.arange(len(known))
            begin = np.searchsorted(group[known], np.arange(group[-1] + 1))
            found = last_before(ends, place[opens], at[opens])
            found[found < begin[group[opens]]] = -1
            hit = found >= 0
            parent = known[np.maximum(found, 0)]
            settled = hit & (kind[parent] == 1)
            guess = hit & ~settled
            yield _table(rows, keys, opens, unit[opens], _ROW, seq[opens], _nullable(seq[parent], hit), _nullable(start[parent], guess), _nullable(neg[parent], guess), None, settled)
            # only the first and the last key of a unit reach into others
            edge = np.unique([0, group[-1]])
            last = np.searchsorted(group, edge, "right") - 1
            until = np.where(kind[last] == 1, at[last], at[last] - 1)
            tops = []
            for g, limit in zip(edge.tolist(), until.tolist()):
                own = opens[group[opens] == g]
                end = at[own] - neg[own]
                greatest = np.maximum.accumulate(end[::-1])[::-1]
                keep = (end > limit) & (end > np.append(greatest[1:], _NEVER))
                tops.append(greatest[0] if len(own) and keep.any() else None)
                own, end = own[keep], end[keep]
                yield _table(rows, keys, own, unit[own], _LEFT_OPEN, seq[own], None, start[own], neg[own], end, None)
            yield _table(rows, keys, last, unit[last], _UNIT, until, None, None, None, tops, None)

    return run


def _nullable(values: np.ndarray, valid: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=~valid)


def _table(rows: pa.Table, keys: list[str], which: np.ndarray, unit, what: int, *columns) -> pa.RecordBatch:
    n = len(which)
    own = rows.select(keys).take(pa.array(which)).combine_chunks()
    kinds = [pa.int64()] * 5 + [pa.bool_()]
    arrays = [own.column(k).combine_chunks() if own.column(k).num_chunks != 1 else own.column(k).chunk(0) for k in keys]
    arrays += [pa.array(unit, pa.int64()), pa.array(np.full(n, what, np.int32))]
    arrays += [pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, [*keys, "_unit", "what", "seq", "parent_seq", "start", "neg", "end", "settled"])


def _holders(keys: list[str]):
    """For each part of a key the last earlier part that leaves an event open over all of it."""

    def run(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("_unit")
        top = parts.column("end").to_numpy()
        top = np.where(np.isnan(top), _NEVER, top).astype(np.int64) if top.dtype.kind == "f" else top
        unit, until = _numbers(parts, "_unit", "until")
        found = last_before(top, np.arange(len(unit)), until)
        hit = np.flatnonzero(found >= 0)
        out = parts.take(pa.array(hit)).select([*keys, "_unit", "until"])
        return out.append_column("holder", pa.array(unit[found[hit]], pa.int64()))

    return run


def unit_number(rows_per_slice: int) -> Column:
    """Number stretches of so many rows of a :func:`range_slices` result, in order; the low 20 bits stay free."""
    return F.shiftleft(F.col("_slice").cast("bigint"), 43) + F.shiftleft(F.floor(F.col("_ord") / rows_per_slice).cast("bigint"), 20)


def nest_by_containment(
    events: DataFrame, keys: list[str], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """(keys, seq, parent_seq): the innermost event still open when an event starts.

    Events are ordered by start, then longer first, then ``seq``; the parent is the last earlier one that
    ends after the start.  Matching parentheses in parallel: openings and closings are sorted together and
    cut into units of ``rows_per_slice`` of them, whatever their times.  A unit settles what it can see and
    reduces to the events it leaves open.  An event that opened before a unit either closes inside it, so the
    unit has its closing, or covers all of it; of those only the last one counts, and one row brings it.  No
    event is copied into the units it spans.  Units of a key are combined by one row each.
    """
    opening = F.struct(F.col("ts_ns").alias("at"), F.lit(1).alias("kind"))
    closing = F.struct((F.col("ts_ns") + F.col("dur_ns")).alias("at"), F.lit(0).alias("kind"))
    points = events.select(
        *keys, "seq", (-F.col("dur_ns")).alias("neg"),
        F.explode(F.when(F.col("dur_ns") > 0, F.array(opening, closing)).otherwise(F.array(opening))).alias("p"),
    ).select(*keys, "p.*", "neg", "seq")
    points = range_slices(points, keys, ["at", "kind", "neg", "seq"]).withColumn("_unit", unit_number(rows_per_slice))
    named = [f"{f.name} {f.dataType.simpleString()}" for f in events.select(*keys).schema]
    schema = ", ".join([*named, "_unit bigint, what int, seq bigint, parent_seq bigint, start bigint, neg bigint, end bigint, settled boolean"])
    local = cut(points.select(*keys, "_unit", "at", "kind", "neg", "seq").mapInArrow(_match(keys), schema))

    parts = local.where(F.col("what") == _UNIT).select(*keys, "_unit", F.col("seq").alias("until"), "end")
    held = parts.groupBy(*keys).applyInArrow(_holders(keys), ", ".join([*named, "_unit bigint, until bigint, holder bigint"]))
    # in the holder: of the events left open, which end later the earlier they began, the last that outlasts the part
    rank = F.struct("start", "neg", F.col("seq").alias("at_seq"))
    left = local.where(F.col("what") == _LEFT_OPEN).select(*keys, F.col("_unit").alias("holder"), F.col("end").alias("value"), F.lit(1).alias("side"), rank.alias("cover"), F.lit(None).cast("bigint").alias("_unit"))
    asked = held.select(*keys, "holder", F.col("until").alias("value"), F.lit(0).alias("side"), F.lit(None).cast(left.schema["cover"].dataType).alias("cover"), "_unit")
    later = Window.partitionBy(*keys, "holder").orderBy(F.col("value").desc(), "side").rowsBetween(Window.unboundedPreceding, -1)
    covers = left.unionByName(asked).withColumn("cover", F.when(F.col("side") == 0, F.last("cover", ignorenulls=True).over(later)))
    covers = covers.where(F.col("side") == 0).select(*keys, "_unit", "cover")

    rows = local.where(F.col("what") == _ROW)
    guess = F.when(F.col("start").isNotNull(), F.struct("start", "neg", F.col("parent_seq").alias("at_seq")))
    open_rows = rows.where(~F.col("settled")).withColumn("guess", guess).join(covers, [*keys, "_unit"], "left")
    found = open_rows.select(*keys, "seq", F.greatest("guess", "cover")["at_seq"].alias("parent_seq"))
    return rows.where("settled").select(*keys, "seq", "parent_seq").unionByName(found)


def _pairs(keys: list[str], order: str, own_pairs: bool):
    """Pairs of each unit: its rows with the earlier ones of the same key that are still open, itself or brought along.

    Every row asks for the last earlier row that ends after its start, then for the last one before that, and so on;
    all rows of the unit ask side by side, so a unit costs what it finds, and finds leave it step by step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches):
            rows = rows.combine_chunks()
            group = _groups(rows, keys)
            side, start, end = _numbers(rows, "side", "start", "end")
            begin = np.searchsorted(group, group)
            ends = end if own_pairs else np.where(side == 0, end, _NEVER)
            who = np.flatnonzero(side == 1)
            place = who
            ids = rows.column(order)
            while len(who):
                place = last_before(ends, place, start[who])
                live = place >= begin[who]
                who, place = who[live], place[live]
                met = start[place] < end[who]
                a, b = ids.take(pa.array(place[met])), ids.take(pa.array(who[met]))
                low, high = pc.if_else(pc.less(a, b), a, b), pc.if_else(pc.less(a, b), b, a)
                out = rows.select(keys).take(pa.array(who[met])).append_column(f"{order}_1", low).append_column(f"{order}_2", high)
                yield from out.filter(pc.not_equal(low, high)).to_batches()

    return run


def _asof(probes: DataFrame, marks: DataFrame, keys: list[str], unique: str, wanted: str) -> DataFrame:
    """Give each probe the ``wanted`` of the last mark of its key with a smaller ``value``."""
    both = probes.withColumns({"_mark": F.lit(1), wanted: F.lit(None).cast(marks.schema[wanted].dataType)}).unionByName(
        marks.select(*keys, "value", wanted).withColumn("_mark", F.lit(2)), allowMissingColumns=True
    )
    seen = sliced_window(
        range_slices(both, keys, ["value", "_mark", unique]), keys, "_slice", ["value", "_mark", unique],
        lasts={"_seen": F.col(wanted)}, write_input=False,
    )
    return seen.where(F.col("_mark") == 1).drop(wanted, "_mark", "_slice", "_ord").withColumnRenamed("_seen", wanted)


def overlapping_pairs(
    intervals: DataFrame, keys: list[str], order: str, start: str = "start_ms", end: str = "end_ms",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """All pairs that overlap inside a key, once each, lower ``order`` first.

    A sweep join whose work follows its output.  Rows are sorted by start and cut into units of so many rows; a
    pair is found where the later one starts.  An interval that outlasts its unit is brought to the later units it
    reaches: all rows of those, but for the last one, overlap it, so copies are fewer than pairs.  Where many reach
    the same unit they are cut into blocks, each met by the unit's rows in a task of its own.  Rows without start or
    end overlap nothing.  The result holds every overlapping pair: :func:`overlap_counts` is linear.
    """
    rows = intervals.select(*keys, order, F.col(start).cast("bigint").alias("start"), F.col(end).cast("bigint").alias("end"))
    rows = rows.where(F.col("start").isNotNull() & F.col("end").isNotNull()).withColumn("side", F.lit(1))
    placed = range_slices(rows, keys, ["start", order]).withColumn("_unit", unit_number(rows_per_slice)).drop("_slice", "_ord")
    named = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema]
    kind = rows.schema[order].dataType.simpleString()
    schema = ", ".join([*named, f"{order}_1 {kind}", f"{order}_2 {kind}"])
    inside = placed.mapInArrow(_pairs(keys, order, True), schema)

    chain = Window.partitionBy(*keys).orderBy("_unit")
    units = placed.groupBy(*keys, "_unit").agg(F.min("start").alias("value"))
    units = cut(units.withColumns({"_n": F.row_number().over(chain).cast("bigint"), "_next": F.lead("value").over(chain)}))
    later = placed.join(units.where(F.col("_next").isNotNull()).drop("value"), [*keys, "_unit"]).where(F.col("end") > F.col("_next"))
    probes = later.select(*keys, order, "start", "end", F.col("end").alias("value"), F.col("_n").alias("_own"))
    reach = _asof(probes, units.select(*keys, "value", F.col("_n").alias("_until")), keys, order, "_until")
    carried = reach.withColumn("_n", F.explode(F.sequence(F.col("_own") + 1, "_until"))).select(*keys, "_n", order, "start", "end")
    carried = cut(carried.join(units.select(*keys, "_n", "_unit"), [*keys, "_n"]).drop("_n"))
    blocks = carried.groupBy(*keys, "_unit").agg(F.ceil(F.count(F.lit(1)) / rows_per_slice).alias("_blocks"))
    guests = carried.join(blocks, [*keys, "_unit"]).withColumns({"side": F.lit(0), "_block": F.pmod(F.xxhash64(order), "_blocks")}).drop("_blocks")
    hosts = placed.join(blocks, [*keys, "_unit"]).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).drop("_blocks")
    met = guests.unionByName(hosts).withColumn("_unit", F.col("_unit") + F.col("_block")).drop("_block")
    across = (
        met.repartition(*keys, "_unit").sortWithinPartitions("_unit", *keys, "side", "start", order)
        .mapInArrow(_pairs(keys, order, False), schema)
    )
    return inside.unionByName(across)


def overlap_counts(
    intervals: DataFrame, keys: list[str], id_col: str, start: str = "start_ms", end: str = "end_ms",
) -> DataFrame:
    """How many other intervals of the key each one overlaps, in linear space.

    Those that start before my end, less those that ended by my start, less me.
    """
    points = intervals.select(
        *keys,
        F.explode(F.array(
            F.struct(F.col(start).alias("ts"), F.lit(1).alias("s"), F.lit(0).alias("e")),
            F.struct(F.col(end).alias("ts"), F.lit(0).alias("s"), F.lit(1).alias("e")),
        )).alias("p"),
    ).groupBy(*keys, "p.ts").agg(F.sum("p.s").alias("s"), F.sum("p.e").alias("e"))
    run = sliced_window(
        range_slices(points, keys, ["ts"]), keys, "_slice", ["ts"], sums={"_starts": F.col("s"), "_ends": F.col("e")}, write_input=False
    )
    by_end = run.select(*keys, F.col("ts").alias(end), (F.col("_starts") - F.col("s")).alias("_before"))
    by_start = run.select(*keys, F.col("ts").alias(start), F.col("_ends").alias("_gone"))
    return (
        intervals.join(by_end, [*keys, end]).join(by_start, [*keys, start])
        .select(*keys, id_col, (F.col("_before") - F.col("_gone") - 1).alias("overlaps"))
    )


def islands(rows: DataFrame, keys: list[str], slice_col: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Number the runs of equal consecutive ``value`` inside each key."""
    marked = sliced_window(rows.withColumn("_v", value), keys, slice_col, order, lags={"_p": F.col("_v")},
                           sums={"_row": F.lit(1)})
    change = F.when((F.col("_row") > 1) & F.col("_p").eqNullSafe(F.col("_v")), 0).otherwise(1)
    flagged = marked.withColumn("_c", change)
    return sliced_window(flagged, keys, slice_col, order, sums={name: F.col("_c")}).drop("_v", "_p", "_row", "_c")
