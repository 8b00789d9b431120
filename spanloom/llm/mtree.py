"""Exact top-k by inner product with an M-tree searched best first.

The greatest inner product becomes the smallest distance by one more coordinate: data get
sqrt(M - |v|^2), M the greatest squared norm, queries get 0.  The tree has three levels.
Routing objects (at most ``CELLS``, taken from distinct vectors in hash order) split the data
into cells.  A cell is split into subtrees of about ``SUBTREE`` vectors, by row number, so that
a cell of equal vectors spreads too; a subtree is one row and one unit of work.  It has its own
routing objects, whose members are cut, by their distance, into pages of ``PAGE`` vectors.  A
node stores its covering radii and each entry its distance to the parent.

A query is first searched in one subtree of its nearest cell.  The score of its k-th neighbour
then rules out cells and, in the subtrees left, pages and members by stored distances and the
triangle inequality, before any distance to them is computed.  Queries meet subtrees in blocks.
Bounds are rounded up to whole scores, so nothing is lost to floating point.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import partitions, pieces, written

CELLS = 1024
SUBTREE = 16_384
ROUTERS = 64
PAGE = 256
BLOCK = 256
#: Components up to this size keep every inner product exact in doubles.
EXACT = 1 << 20
_LONG = 1 << 63


def scaled(vector, factor: int = 256):
    """Components floor(factor * x) as whole numbers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor))


def usable(vector):
    """No null vector, no null or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


class Shape:
    """What is known of all vectors: length, greatest squared norm, storage type."""

    def __init__(self, dims: int, top: int, low: int, high: int):
        self.dims, self.top, self.exact = max(1, dims), float(top), max(-low, high) <= EXACT
        size = max(-low - 1, high)
        self.dtype = np.dtype(np.int16 if size < 1 << 15 else np.int32 if size < 1 << 31 else np.int64)

    def rows(self, column: pa.ListArray) -> np.ndarray:
        """Vectors as rows; shorter ones are filled with zeros."""
        lengths = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if (lengths == self.dims).all():
            return flat.reshape(-1, self.dims)
        out = np.zeros((len(lengths), self.dims), np.int64)
        out[np.arange(self.dims) < lengths[:, None]] = flat
        return out

    def unpack(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.dtype).reshape(-1, self.dims).astype(np.int64)

    def lifted(self, v: np.ndarray) -> np.ndarray:
        """Data with the additional coordinate."""
        x = v.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))])

    def scores(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        if self.exact:
            return q.astype(np.float64) @ v.astype(np.float64).T
        return q.astype(object) @ v.astype(object).T

    def ceiling(self, squares: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The greatest whole score at a distance of ``least`` or more from a query of that squared norm."""
        if not self.exact:
            return np.full(np.broadcast(squares, least).shape, np.inf)
        both = squares + self.top
        return np.floor((both - np.maximum(least, 0) ** 2) / 2 + 0.01 + 1e-6 * both)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def distances_to(a: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - one) ** 2).sum(1))


class Index:
    """Subtrees (one row each) and the routing objects above them."""

    def __init__(self, subtrees: DataFrame, shape: Shape, routers: np.ndarray, splits: dict[int, int], radii: np.ndarray):
        self.subtrees, self.shape, self.routers, self.splits, self.radii = subtrees, shape, routers, splits, radii


def numbered(vectors: DataFrame) -> DataFrame:
    """Give rows their own number, as ids may repeat; written."""
    return written(vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("row")), "vectors")


def nearest(shape: Shape, routers: np.ndarray):
    """(row, vec_id, cell, data) for (row, vec_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = shape.rows(batch.column("v"))
            far = distances(shape.lifted(v), routers)
            cell = far.argmin(1)
            data = v.astype(shape.dtype)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell]), pa.array([x.tobytes() for x in data], pa.binary())],
                ["row", "vec_id", "cell", "parent", "data"],
            )

    return run


_PLACED = "row long, vec_id long, cell int, parent double, data binary"


def build(vectors: DataFrame, cells: int = CELLS, subtree: int = SUBTREE, page: int = PAGE) -> Index | None:
    """Index numbered vectors (row, vec_id, v array<long>); None for an empty table.

    The driver sees at most ``cells`` routing objects and as many counts; every vector is indexed.
    """
    spark = vectors.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    known = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"), F.max(norm).alias("top"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    if not known["n"]:
        return None
    shape = Shape(known["dims"], known["top"], known["low"] or 0, known["high"] or 0)
    wanted = min(cells, -(-known["n"] // subtree))
    # distinct vectors in hash order; copies combine before the shuffle
    h = F.xxhash64("v")
    share = min(1.0, 64 * wanted / known["n"])
    few = vectors.where(h < int((share * 2 - 1) * _LONG)) if share < 1 else vectors
    picked = few.groupBy(h.alias("h")).agg(F.first("v").alias("v")).orderBy("h").limit(wanted).select("v").toArrow().column("v")
    if not len(picked):
        picked = vectors.select("v").limit(1).toArrow().column("v")
    routers = shape.lifted(shape.rows(picked.combine_chunks()))

    placed = written(vectors.select("row", "vec_id", "v").mapInArrow(nearest(shape, routers), _PLACED), "placed")
    counted = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("parent").alias("radius")).collect()  # one row a cell
    splits = {r["cell"]: -(-r["n"] // subtree) for r in counted}
    radii = np.zeros(len(routers))
    for r in counted:
        radii[r["cell"]] = r["radius"]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in by_unit(batches):
            ids = np.concatenate([r.column("vec_id").to_numpy() for r in rows])
            own = np.concatenate([r.column("row").to_numpy() for r in rows])
            v = np.concatenate([shape.unpack(b"".join(r.column("data").to_pylist())) for r in rows])
            data = pickle.dumps(subtree_of(shape, routers[key >> 32], ids, own, v, page))
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([key >> 32], pa.int32()), pa.array([data])], ["unit", "cell", "tree"])

    units = placed.join(F.broadcast(spark.createDataFrame(sorted(splits.items()), "cell int, splits long")), "cell")  # at most `cells` rows
    units = units.select("row", "vec_id", "data", (F.shiftleft(F.col("cell").cast("long"), 32) + F.pmod("row", "splits")).alias("unit"))
    grown = units.repartition(partitions(spark), "unit").sortWithinPartitions("unit", "row").mapInArrow(grow, "unit long, cell int, tree binary")
    return Index(written(grown, "subtrees"), shape, routers, splits, radii)


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of one subtree at a time, from rows sorted by unit."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column("unit").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if unit[a] != key:
                if held:
                    yield key, held
                key, held = int(unit[a]), []
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def subtree_of(shape: Shape, parent: np.ndarray, ids: np.ndarray, own: np.ndarray, v: np.ndarray, page: int) -> dict:
    """Routing objects over pages of members, each page a ring around its routing object."""
    _, first = np.unique(v, axis=0, return_index=True)
    first = np.sort(first)
    routers = shape.lifted(v[first[:: max(1, len(first) // ROUTERS)][:ROUTERS]])
    lifted = shape.lifted(v)
    far = distances(lifted, routers)
    home = far.argmin(1)
    far = far[np.arange(len(v)), home]
    order = np.lexsort((own, ids, far, home))
    ids, own, v, home, far = ids[order], own[order], v[order].astype(shape.dtype), home[order], far[order]
    edges = np.flatnonzero(np.diff(home)) + 1
    starts = np.concatenate([np.arange(a, b, page) for a, b in zip([0, *edges], [*edges, len(v)], strict=True)])
    ends = np.append(starts[1:], len(v))
    return {
        "parent": parent, "routers": routers, "to_parent": distances_to(routers, parent), "home": home[starts], "starts": starts, "ends": ends,
        "low": np.minimum.reduceat(far, starts), "high": np.maximum.reduceat(far, starts), "least_id": np.minimum.reduceat(ids, starts),
        "ids": ids, "rows": own, "v": v, "far": far,
    }


class Best:
    """The k best members of each query of a block so far."""

    def __init__(self, bounds: np.ndarray, bound_ids: np.ndarray, k: int, exact: bool):
        self.k = k
        # score and id of the k-th neighbour known; whole numbers beyond doubles stay Python's
        self.bounds, self.bound_ids = bounds.copy() if exact else bounds.astype(object), bound_ids.copy()
        self.found: list[list[tuple]] = [[] for _ in bounds]

    def beaten(self, which: np.ndarray, ceiling: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether entries of at most that score, and at least that id, can no longer matter."""
        bound, bound_id = self.bounds[which], self.bound_ids[which]
        if ceiling.ndim == 2:
            bound, bound_id = bound[:, None], bound_id[:, None]
        return (ceiling < bound) | ((ceiling == bound) & (ids > bound_id))

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(ids) > self.k and scores.dtype != object:
            keep = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[keep], ids[keep]
        own = self.found[q] = sorted([*self.found[q], *zip((-scores).tolist(), ids.tolist(), strict=True)])[: self.k]
        if len(own) == self.k:
            worst, last = -own[-1][0], own[-1][1]
            if worst > self.bounds[q] or (worst == self.bounds[q] and last < self.bound_ids[q]):
                self.bounds[q], self.bound_ids[q] = worst, last


def search_block(shape: Shape, tree: dict, q: np.ndarray, rows: np.ndarray, best: Best) -> int:
    """Best-first search of one subtree for a block of queries; returns how many inner products were computed.

    Pages are taken by their greatest possible score, 1, 2, 4, ... at a time, until none can help.
    """
    n, pages = len(q), len(tree["starts"])
    x = np.column_stack([q.astype(np.float64), np.zeros(n)])
    squares = (x * x).sum(1)
    everyone = np.arange(n)
    # by the stored distances to the parent alone: which pages' routing objects need a distance
    to_parent = distances_to(x, tree["parent"])
    home = tree["home"]
    least = np.abs(to_parent[:, None] - tree["to_parent"][None, home]) - tree["high"][None, :]
    open_ = ~best.beaten(everyone, shape.ceiling(squares[:, None], least), tree["least_id"][None, :])
    need = np.zeros((n, len(tree["routers"])), bool)
    np.logical_or.at(need, (slice(None), home), open_)
    far = np.full((n, len(tree["routers"])), np.inf)
    used = need.any(1)
    if used.any():
        columns = need.any(0)
        far[np.ix_(used, columns)] = distances(x[used], tree["routers"][columns])
    to_router = far[:, home]
    with np.errstate(invalid="ignore"):
        least = np.maximum(to_router - tree["high"][None, :], tree["low"][None, :] - to_router)
    top = np.where(open_, shape.ceiling(squares[:, None], np.where(open_, least, 0)), -np.inf)
    order = np.lexsort((np.broadcast_to(tree["least_id"], top.shape), -top), axis=1)
    at, step, computed = 0, 1, 0
    while at < pages:
        taken = order[:, at : at + step]
        who = np.repeat(everyone, taken.shape[1])
        page = taken.ravel()
        live = open_[who, page] & ~best.beaten(who, top[who, page], tree["least_id"][page])
        who, page = who[live], page[live]
        if not len(who):
            break  # pages come by falling ceiling: what follows cannot help either
        turn = np.argsort(page, kind="stable")
        who, page = who[turn], page[turn]
        cuts = [0, *(np.flatnonzero(np.diff(page)) + 1).tolist(), len(page)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            p, own = page[a], who[a:b]
            span = slice(tree["starts"][p], tree["ends"][p])
            ids = tree["ids"][span]
            ceiling = shape.ceiling(squares[own, None], np.abs(to_router[own, p][:, None] - tree["far"][None, span]))
            needed = ~best.beaten(own, ceiling, ids[None, :]) & (tree["rows"][None, span] != rows[own, None])
            columns = np.flatnonzero(needed.any(0))
            if not len(columns):
                continue
            scores = shape.scores(q[own], tree["v"][span][columns].astype(np.int64))
            computed += scores.size
            hit = needed[:, columns] & ~best.beaten(own, scores, ids[None, columns])
            for i in np.flatnonzero(hit.any(1)):
                found = columns[hit[i]]
                best.add(own[i], scores[i][hit[i]], ids[found])
        at += step
        step *= 2
    return computed


_FOUND = "home long, row long, query_id long, data binary, vec_ids array<long>, scores array<long>"
_NO_ID = _LONG - 1
_ASKED = {"home": "long", "row": "long", "query_id": "long", "bound": "double", "bound_id": "long", "data": "binary"}


def visit(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """Search each (unit, query) row in its subtree; queries of a subtree stream past it in blocks."""
    shape = index.shape

    def answer(part: pa.RecordBatch, found: list[list[tuple]]) -> pa.RecordBatch:
        ids = [[i for _, i in f] for f in found]
        scores = [[min(max(-int(s), -_LONG), _LONG - 1) for s, _ in f] for f in found]
        kept = [part.column(c) for c in ("home", "row", "query_id", "data")]
        return pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.int64()))], ["home", "row", "query_id", "data", "vec_ids", "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = tree = None
        for batch in pieces(batches, BLOCK):
            keys, kinds = batch.column("unit").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1
            cuts = [0, *edges.tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    unit, tree = keys[a], pickle.loads(part.column("tree")[0].as_py())
                elif keys[a] == unit:
                    q = shape.unpack(b"".join(part.column("data").to_pylist()))
                    best = Best(part.column("bound").to_numpy(), part.column("bound_id").to_numpy(), k, shape.exact)
                    search_block(shape, tree, q, part.column("row").to_numpy(), best)
                    yield answer(part, best.found)
                else:  # no row fell to this subtree
                    yield answer(part, [[]] * part.num_rows)

    trees = index.subtrees.select("unit", F.lit(0).alias("kind"), "tree", *[F.lit(None).cast(t).alias(c) for c, t in _ASKED.items()])
    asked = queries.select("unit", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("tree"), *_ASKED)
    both = trees.unionByName(asked).repartition(partitions(queries.sparkSession), "unit").sortWithinPartitions("unit", "kind", "home", "row")
    return both.mapInArrow(run, _FOUND)


def search(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of each query with vectors of other rows.

    ``queries`` are (row, vec_id, v) as :func:`numbered` gives them; a query's own row is no candidate for it.  Ties go to
    the smaller vec_id.  Each query row is answered, also if its id repeats.  Fewer rows than k give fewer ranks.
    Vectors of different lengths count as filled with zeros.  Scores beyond 64 bits are clipped to them
    and then tie.
    """
    shape, routers, radii, splits = index.shape, index.routers, index.radii, index.splits
    cells = np.array(sorted(splits))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = shape.rows(batch.column("v"))
                x = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
                cell = cells[distances(x, routers[cells]).argmin(1)]
                rows = batch.column("row").to_numpy()
                unit = (cell.astype(np.int64) << 32) + rows % np.array([splits[c] for c in cell.tolist()], np.int64)
                kind = shape.dtype if np.abs(q).max(initial=0) <= np.iinfo(shape.dtype).max else None
                if kind is None:
                    raise ValueError("queries have components beyond those of the indexed vectors")
                yield pa.RecordBatch.from_arrays([pa.array(unit), batch.column("row"), batch.column("vec_id"), pa.array([r.tobytes() for r in q.astype(kind)], pa.binary())], ["unit", "row", "query_id", "data"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that may still hold one of the k best."""
        for batch in batches:
            if batch.num_rows:
                q = shape.unpack(b"".join(batch.column("data").to_pylist()))
                x = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
                least = distances(x, routers[cells]) - radii[cells]
                ids, scores = batch.column("vec_ids").to_pylist(), batch.column("scores").to_pylist()
                bound = np.array([s[-1] if shape.exact and len(s) == k else -np.inf for s in scores], np.float64)
                bound_id = np.array([i[-1] if len(i) == k else _NO_ID for i in ids], np.int64)
                open_ = shape.ceiling((x * x).sum(1)[:, None], least) >= bound[:, None]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("home", "row", "query_id", "data")] + [pa.array(bound), pa.array(bound_id), pa.array([cells[o].tolist() for o in open_], pa.list_(pa.int32()))],
                    ["home", "row", "query_id", "data", "bound", "bound_id", "cells"],
                )

    first = queries.mapInArrow(start, "unit long, row long, query_id long, data binary")
    first = first.select("unit", F.col("unit").alias("home"), "row", "query_id", F.lit(float("-inf")).alias("bound"), F.lit(_NO_ID).alias("bound_id"), "data")
    homes = written(visit(index, first, k), "homes")
    routed = homes.mapInArrow(route, "home long, row long, query_id long, data binary, bound double, bound_id long, cells array<int>")
    pairs = routed.withColumn("cell", F.explode("cells")).drop("cells").join(index.subtrees.select("cell", "unit"), "cell").where("unit <> home")
    found = homes.unionByName(visit(index, pairs, k)).select("row", "query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("f"))
    order = Window.partitionBy("row").orderBy(F.col("f.scores").desc(), "f.vec_ids")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("f.vec_ids").alias("vec_id"), F.col("f.scores").alias("score"))


def top_k(vectors: DataFrame, is_query, k: int = 5, **sizes) -> DataFrame:
    """Search the rows of ``vectors`` (vec_id, v array<long>) where ``is_query`` holds against all rows.

    Rows without vec_id or vector take no part, as no result could name them; an empty table gives no rows.  Equal
    vectors and repeated rows count each for themselves.  Other columns, whatever their names, are left out.
    """
    rows = numbered(vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()))
    index = build(rows, **sizes)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return search(index, rows.where(is_query), k)
