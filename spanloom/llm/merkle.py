"""A Merkle manifest of a dataset: digests of all rows, proofs, and versions of the tree for altered rows.

The tree is persistent: an altered leaf makes a new version that copies the leaf's ancestors
and shares every other node.  Leaves are cut into aligned blocks of 2**bits; a block is one
row and one unit of work, whose root is a leaf of the level above, and so on.  A version
copies the ancestors inside its block and goes on over the block's upper siblings, so
versions of all blocks are made side by side and no task holds more than a block.

Leaves form one tree for each value of a column.  Two consecutive nodes become one; the last
of a level may stand alone and is hashed alone.  The roots of these trees, ordered by that
value (null first, by bytes), are the leaves of the top tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import partitions, written
from spanloom.operators.ordered import rank_sliced

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 12
HEX = 64
TREE = ["known", "tree"]
#: What becomes of a node on its way up: hashed alone, or with a sibling on its left or right.
ALONE, LEFT, RIGHT = b"-", b"L", b"R"


def encoded(value: Column) -> Column:
    """``-`` for null, otherwise the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def joined(*nodes: bytes) -> bytes:
    """The digest of nodes next to each other; digests are lower-case hex."""
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


class PersistentTree:
    """A binary hash tree over the nodes of one block. Nodes are never changed; a version is a root."""

    def __init__(self, leaves: list[bytes], depth: int):
        self.digests = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        level = list(range(len(leaves)))
        for _ in range(depth):
            level = [self._node(tuple(level[i : i + 2])) for i in range(0, len(level), 2)]
        self.depth = depth
        (self.root,) = level

    def _node(self, children: tuple[int, ...]) -> int:
        self.digests.append(joined(*[self.digests[c] for c in children]))
        self.children.append(children)
        return len(self.digests) - 1

    def _walk(self, place: int) -> list[tuple[int, int]]:
        """(node, which child leads on) from the root of the first version to the leaf at ``place``."""
        steps, node = [], self.root
        for height in range(self.depth - 1, -1, -1):
            side = place >> height & 1
            steps.append((node, side))
            node = self.children[node][side]
        return steps

    def path(self, place: int) -> list[tuple[bytes, bytes]]:
        """(side, sibling) for each level from the leaf up."""
        out = []
        for node, side in reversed(self._walk(place)):
            pair = self.children[node]
            if len(pair) == 1:
                out.append((ALONE, b""))
            else:
                out.append((LEFT if side else RIGHT, self.digests[pair[1 - side]]))
        return out

    def version(self, place: int, leaf: bytes) -> list[int]:
        """Copy the ancestors of a leaf that changes; the copies from the bottom up, the last is the version's root."""
        self.digests.append(leaf)
        self.children.append(())
        copies = [len(self.digests) - 1]
        for node, side in reversed(self._walk(place)):
            pair = list(self.children[node])
            pair[side] = copies[-1]
            copies.append(self._node(tuple(pair)))
        return copies


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> list[bytes]:
    """The node and its ancestors, recomputed from siblings."""
    out = [node]
    for side, sibling in path:
        out.append(joined(out[-1]) if side == ALONE else joined(sibling, out[-1]) if side == LEFT else joined(out[-1], sibling))
    return out


def spell(path: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    return b"".join(s for s, _ in path), b"".join(d for _, d in path)


def unspell(sides: bytes, siblings: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    for i in range(len(sides)):
        side = sides[i : i + 1]
        size = 0 if side == ALONE else HEX
        out.append((side, siblings[at : at + size]))
        at += size
    return out


def cut_up(data: bytes) -> list[bytes]:
    return [data[i : i + HEX] for i in range(0, len(data), HEX)]


def depth_of(nodes: int, bits: int) -> int:
    """Levels of a block: all of them if other blocks follow, otherwise until one node remains."""
    return min(bits, (nodes - 1).bit_length())


_BLOCK = "known boolean, tree string, n long, block long, ids array<long>, leaves binary, changed binary, places array<int>, root binary"


def blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """Pack nodes (known, tree, n, at, id, node, other) into rows of aligned blocks with their roots; written.

    ``n`` counts the nodes of the tree, ``at`` is a node's place in it, ``other`` the node it is altered to or null.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("known", "tree", "n", "block", "at", "id", "node", "other")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (known, tree, n, block), group in groupby(rows(batches), key=lambda r: r[:4]):
            own = list(group)
            leaves = [r[6].encode() for r in own]
            base = PersistentTree(leaves, depth_of(n, bits))
            changed = [(i, r[7].encode()) for i, r in enumerate(own) if r[7] is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([known]), pa.array([tree]), pa.array([n], pa.int64()), pa.array([block], pa.int64()),
                    pa.array([[r[5] for r in own]], pa.list_(pa.int64())), pa.array([b"".join(leaves)]), pa.array([b"".join(x for _, x in changed)], pa.binary()),
                    pa.array([[i for i, _ in changed]], pa.list_(pa.int32())), pa.array([base.digests[base.root]]),
                ],
                ["known", "tree", "n", "block", "ids", "leaves", "changed", "places", "root"],
            )

    by = [*TREE, "block"]
    placed = nodes.withColumn("block", F.shiftright("at", bits))
    moved = placed.repartition(partitions(nodes.sparkSession), *by).sortWithinPartitions(*by, "at")
    return written(moved.mapInArrow(run, _BLOCK), "merkle-blocks")


def climb(packed: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Hash on above the blocks until each tree has one node.

    Returns (known, tree, root), and for each block the (side, sibling) pairs from its root to its tree's:
    (known, tree, block, sides, siblings).
    """
    levels = [packed]
    while levels[-1].where(F.col("n") > (1 << bits)).limit(1).count():
        below = levels[-1]
        levels.append(blocks(below.where(F.col("n") > (1 << bits)).select(
            *TREE, F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"), F.col("block").alias("at"), F.lit(None).cast("long").alias("id"),
            F.decode("root", "utf-8").alias("node"), F.lit(None).cast("string").alias("other"),
        ), bits))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for known, tree, n, block, leaves, sides, siblings in zip(*[batch.column(c).to_pylist() for c in ("known", "tree", "n", "block", "leaves", "sides", "siblings")], strict=True):
                nodes = cut_up(leaves)
                base = PersistentTree(nodes, depth_of(n, bits))
                own = [spell(base.path(i)) for i in range(len(nodes))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([known] * len(own)), pa.array([tree] * len(own)), pa.array([(block << bits) + i for i in range(len(own))], pa.int64()),
                        pa.array([a + sides for a, _ in own]), pa.array([b + siblings for _, b in own]),
                    ],
                    ["known", "tree", "block", "sides", "siblings"],
                )

    def tops(level: DataFrame) -> DataFrame:
        return level.where(F.col("n") <= (1 << bits))

    none = F.lit("").cast("binary")
    paths = upper = None
    for level in reversed(levels):
        whole = tops(level).select(*TREE, "block", none.alias("sides"), none.alias("siblings"))
        if upper is not None:  # the leaves of the level above are the blocks of this one
            opened = upper.select(*TREE, "block", "n", "leaves").join(written(paths, "merkle-paths"), [*TREE, "block"])
            whole = whole.unionByName(opened.mapInArrow(down, "known boolean, tree string, block long, sides binary, siblings binary"))
        paths, upper = whole, level
    roots = None
    for level in levels:
        own = tops(level).select(*TREE, "root")
        roots = own if roots is None else roots.unionByName(own)
    return roots, paths


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add each node's place ``at`` in its tree and the tree's size ``n``; hot trees are cut by range."""
    by = [*TREE, *order]
    ranged = nodes.repartitionByRange(partitions(nodes.sparkSession), *by).sortWithinPartitions(*by)
    ranged = written(ranged.withColumn("_pos", F.monotonically_increasing_id()), "merkle-order")
    sliced = ranged.withColumn("_slice", F.shiftright("_pos", 33)).withColumn("_ord", F.col("_pos").bitwiseAND((1 << 33) - 1))
    return rank_sliced(sliced, TREE, "at", "n").withColumn("at", F.col("at") - 1).drop("_slice", "_ord", "_pos")


_OUT = "id long, known boolean, tree string, at long, leaf string, subroot string, root string, sides string, proof string, folded_root string, copies array<string>"


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None, where: Column | None = None, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id", bits: int = BITS) -> DataFrame:
    """One row for each row of ``docs``: its leaf, the roots above it, its proof, and what an altered copy folds to.

    ``altered`` gives new values of fields for the rows of ``where`` (a dataset that was tampered with); the tree and
    the proofs are those of ``docs`` as they are.  Columns: ``id`` (of ``order``), ``tree`` (null where ``known`` is
    false), ``at`` (place in the tree), ``leaf``, ``subroot``, ``root``, ``proof`` (siblings from the leaf to the root,
    hex, end to end; ``sides`` has a letter for each level: L or R where the sibling stands, - for none),
    ``folded_root`` (from the altered leaf, if any, and the proof), ``verified`` (it equals the root), ``copies`` (the
    digests of the nodes an altered row's version copies, from the leaf to the root; null for other rows).

    Null fields are hashed as ``-``, empty and long texts whole.  Rows with a null tree value form the first tree.
    Within a tree rows stand by ``order``, null first, then by leaf; equal rows have equal leaves, each its own place.
    An empty table gives no rows.  Other columns, whatever their names, are left out.
    """
    where = F.lit(False) if where is None else F.coalesce(where, F.lit(False))
    altered = altered or {}
    nodes = docs.select(
        F.col(tree).isNotNull().alias("known"), F.coalesce(F.col(tree).cast("string"), F.lit("")).alias("tree"), F.col(order).alias("id"),
        digest([F.col(c) for c in fields]).alias("node"), F.when(where, digest([altered.get(c, F.col(c)) for c in fields])).alias("other"),
    )
    packed = blocks(placed(written(nodes, "merkle-leaves"), ["id", "node"]), bits)
    roots, paths = climb(packed, bits)
    roots = written(roots, "merkle-roots")

    # the roots are the leaves of the top tree
    one = [F.lit(True).alias("known"), F.lit("").alias("tree")]
    tops = placed(roots.select(*one, F.col("known").alias("own"), F.col("tree").alias("name"), F.decode("root", "utf-8").alias("node")), ["own", "name"])
    tops = written(tops, "merkle-tops")
    top = blocks(tops.select(*TREE, "n", "at", F.lit(None).cast("long").alias("id"), "node", F.lit(None).cast("string").alias("other")), bits)
    top_root, top_paths = climb(top, bits)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Paths of the leaves of the top tree's blocks."""
        for batch in batches:
            for n, block, leaves, root, sides, siblings in zip(*[batch.column(c).to_pylist() for c in ("n", "block", "leaves", "root", "sides", "siblings")], strict=True):
                subroots = cut_up(leaves)
                base = PersistentTree(subroots, depth_of(n, bits))
                own = [spell(base.path(i)) for i in range(len(subroots))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(block << bits) + i for i in range(len(own))], pa.int64()), pa.array(subroots), pa.array([root] * len(own)),
                        pa.array([a + sides for a, _ in own]), pa.array([b + siblings for _, b in own]),
                    ],
                    ["at", "subroot", "top", "top_sides", "top_siblings"],
                )

    over = top.drop("root").join(top_paths, [*TREE, "block"]).join(top_root, TREE)
    over = over.mapInArrow(spread, "at long, subroot binary, top binary, top_sides binary, top_siblings binary")
    over = tops.select(F.col("own").alias("known"), F.col("name").alias("tree"), "at").join(over, "at").drop("at")
    units = packed.drop("root").join(paths, [*TREE, "block"]).join(written(over, "merkle-over"), TREE)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time
                yield block_rows(batch.slice(i, 1).to_pylist()[0], bits)

    out = units.mapInArrow(prove, _OUT).withColumn("tree", F.when(F.col("known"), F.col("tree"))).drop("known")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def block_rows(block: dict, bits: int) -> pa.RecordBatch:
    leaves = cut_up(block["leaves"])
    base = PersistentTree(leaves, depth_of(block["n"], bits))
    inner = unspell(block["sides"], block["siblings"])
    outer = unspell(block["top_sides"], block["top_siblings"])
    above = [*inner, *outer]
    sides, siblings = spell(above)
    versions = dict(zip(block["places"], cut_up(block["changed"]), strict=True))
    shared: dict[bytes, bytes] = {}  # block roots already taken to the top
    rows = []
    for i, leaf in enumerate(leaves):
        path = base.path(i)
        copies = None
        if i in versions:
            own = [base.digests[c] for c in base.version(i, versions[i])]
            copies = own[:-1] + fold(own[-1], above)
            folded = copies[-1]
        else:
            block_root = fold(leaf, path)[-1]
            folded = shared.get(block_root)
            if folded is None:
                folded = shared[block_root] = fold(block_root, above)[-1]
        a, b = spell(path)
        rows.append((a + sides, b + siblings, folded, copies))
    n = len(leaves)
    first = block["block"] << bits
    text = pa.string()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block["ids"], pa.int64()), pa.array([block["known"]] * n), pa.array([block["tree"]] * n), pa.array(range(first, first + n), pa.int64()),
            pa.array(leaves).cast(text), pa.array([block["subroot"]] * n).cast(text), pa.array([block["top"]] * n).cast(text),
            pa.array([r[0] for r in rows]).cast(text), pa.array([r[1] for r in rows]).cast(text), pa.array([r[2] for r in rows]).cast(text),
            pa.array([None if r[3] is None else [c.decode() for c in r[3]] for r in rows], pa.list_(text)),
        ],
        ["id", "known", "tree", "at", "leaf", "subroot", "root", "sides", "proof", "folded_root", "copies"],
    )
