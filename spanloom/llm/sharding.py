"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``2**CELL_BITS`` cells.  Every shard has ``VNODES`` virtual nodes at hashed
cells; a key goes clockwise from the cell of its hash to the next virtual node.  A shard
that has reached its capacity is passed over: the keys beyond it, in ring order, continue
clockwise to the next shard with room.  With ``slack`` 0 the capacities are the number of
rows / shards, rounded down or up, so counts differ by one at most; with more slack fewer
keys move when a shard is added.

Where keys end depends on the number of keys in each arc alone.  Those counts (one for
each virtual node) are walked on the driver, giving each arc a few rank intervals; rows
find their place by rank within the arc: the rank within a cell plus the keys of the
cells before it.  A cell holds 1/65,536 of the keys.  Rows move once.

Defined results: a null key hashes as the text ``null``; equal keys stand by text
hash and are placed each for themselves; a null text has one byte; an empty table gives
no rows.  Columns named as the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import fresh

VNODES = 64
CELL_BITS = 16
_HASH_BITS = 60  # fifteen hex digits of md5


def ring_hash(key: Column) -> Column:
    """60 bits of md5: the same on every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def _nodes(df: DataFrame, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in ring order; of two in a cell the smaller shard stays."""
    spark = df.sparkSession
    cell = F.shiftright(ring_hash(F.concat_ws("-", F.lit("shard"), F.col("id") % shards, F.floor(F.col("id") / shards))), _HASH_BITS - CELL_BITS)
    nodes: dict[int, int] = {}
    for r in spark.range(shards * vnodes).select(cell.alias("cell"), (F.col("id") % shards).cast("int").alias("shard")).collect():
        nodes[r["cell"]] = min(r["shard"], nodes.get(r["cell"], r["shard"]))
    for shard in range(shards):  # a shard that lost all its nodes gets the first free cell
        if shard not in nodes.values():
            nodes[next(c for c in range(1 << CELL_BITS) if c not in nodes)] = shard
    return sorted(nodes.items())


def capacities(n: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [int(-(-n * (1 + slack) // shards))] * shards
    return [n // shards + (i < n % shards) for i in range(shards)]


def intervals(counts: list[int], owners: list[int], room: list[int]) -> list[list[tuple[int, int, int, int]]]:
    """For each arc (first rank, end rank, shard, slot of the first rank).

    Every arc first fills its own shard, in ring order; then what is left over walks
    clockwise, in ring order.
    """
    used = [0] * len(room)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in counts]
    placed = [0] * len(counts)

    def put(arc: int, shard: int) -> None:
        take = min(counts[arc] - placed[arc], room[shard] - used[shard])
        if take > 0:
            out[arc].append((placed[arc], placed[arc] + take, shard, used[shard]))
            placed[arc] += take
            used[shard] += take

    for arc, owner in enumerate(owners):
        put(arc, owner)
    for arc in range(len(counts)):
        step = 1
        while placed[arc] < counts[arc]:
            put(arc, owners[(arc + step) % len(owners)])
            step += 1
    return out


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text_col: str = "text", vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 within a shard)."""
    spark = docs.sparkSession
    nodes = _nodes(docs, shards, vnodes)
    cells = [c for c, _ in nodes]
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    hash_, cell_, rank_, parts_, part_, before_ = fresh(docs, "_h", "_cell", "_rank", "_parts", "_part", "_before")
    rows = docs.select(*kept).withColumn(hash_, ring_hash(F.col(key)))
    rows = rows.withColumn(cell_, F.shiftright(hash_, _HASH_BITS - CELL_BITS).cast("int"))
    # The arc of a cell: the first virtual node at or after it, else the first of the ring.
    ends = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({arc}, {(cells[arc - 1] + 1) if arc else 0}, {cell})" for arc, cell in enumerate(cells)) + " AS t(arc, low, high)")
    spans = ends.select("arc", F.explode(F.sequence("low", "high")).alias(cell_))
    if cells[-1] < (1 << CELL_BITS) - 1:
        tail = spark.range(cells[-1] + 1, 1 << CELL_BITS).select(F.lit(0).alias("arc"), F.col("id").cast("int").alias(cell_))
        spans = spans.unionByName(tail)
    # Counts of at most 2**CELL_BITS cells.  Ring order within the first arc begins after the last node.
    turn = F.when((F.col("arc") == 0) & (F.col(cell_) > cells[-1]), F.col(cell_) - (1 << CELL_BITS)).otherwise(F.col(cell_))
    before = Window.partitionBy("arc").orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    tally = rows.groupBy(cell_).agg(F.count(F.lit(1)).alias("n")).join(spans, cell_)
    tally = tally.select(cell_, "arc", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(before_))
    counts = [0] * len(nodes)
    for r in tally.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # one row for each virtual node
        counts[r["arc"]] = r["n"]
    found = intervals(counts, [s for _, s in nodes], capacities(sum(counts), shards, slack))
    flat = [f"({arc}, {a}L, {b}L, {s}, {slot}L)" for arc, parts in enumerate(found) for a, b, s, slot in parts]
    if not flat:
        return docs.select(*kept, F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot")).limit(0)
    parts = spark.sql(f"SELECT arc, collect_list(struct(a, b, s, slot)) AS {parts_} FROM VALUES {', '.join(flat)} AS t(arc, a, b, s, slot) GROUP BY arc")
    places = tally.select(cell_, "arc", before_).join(parts, "arc").drop("arc")
    order = Window.partitionBy(cell_).orderBy(hash_, key, F.xxhash64(text_col) if text_col in kept else F.lit(0))
    ranked = rows.withColumn(rank_, F.row_number().over(order) - 1).join(places, cell_)
    rank = F.col(rank_) + F.col(before_)
    part = F.filter(parts_, lambda p: (p["a"] <= rank) & (rank < p["b"]))[0]
    placed = ranked.withColumn(part_, part).withColumn(rank_, rank)
    return placed.select(*kept, F.col(part_)["s"].alias("shard"), (F.col(part_)["slot"] + F.col(rank_) - F.col(part_)["a"]).alias("slot"))
