"""Span hierarchies without recursion.

A node is ``(source_id, trace_id, span_id)``.  Trees are contracted by pointer
jumping: each round looks up the next ``STEPS`` ancestors and gives every node a
pointer that reaches so many times further, so rounds grow with the logarithm of
the depth.  On the way up, values of all descendants combine (subtree sizes,
bounds of shown children); on the way down, values of all ancestors add up
(depth, place in preorder).  A flat tree holds the interval ``pre``..``last`` of
preorder places for each node instead of its ancestors: space n, not n x depth,
and "below" and "above" become comparisons of numbers.

Ids may repeat (steps of one name in a job, spans that were sent again).  Every
row stays a node of its own; children hang below the first row of their parent's
id, so a tree never has more rows than there are spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import ids
from spanloom.functions.codes import attribute
from spanloom.operators import filters
from spanloom.operators.ordered import range_slices, rank_sliced, sliced_window
from spanloom.session import landed, sorted_join

STEPS = 4  # ancestors looked up in one round
PLACES_PER_SLICE = 65_536
ROOT = ""


def node_key(source: Column, trace: Column, span: Column) -> Column:
    """Markers carry no trace id; an empty part keeps the key comparable."""
    return F.concat_ws(
        "/", F.coalesce(source.cast("string"), F.lit("")), F.coalesce(trace, F.lit("")), span
    )


def link_parents(spans: DataFrame) -> DataFrame:
    """Add ``node`` and ``parent`` (null for roots and for spans whose parent is absent).

    The first row of an id is the node of that name; later ones get their row number
    added.  ``row_id``, if present, numbers the rows of a written input; ``parent_row`` is
    the row of the parent.  Keys alone are brought together, and written once.
    """
    if "row_id" not in spans.columns:
        spans = landed(spans.withColumn("row_id", F.monotonically_increasing_id()))
    node = node_key(F.col("source_id"), F.col("trace_id"), F.col("span_id"))
    wanted = F.coalesce(F.col("parent_span_id"), F.lit("")).isin("", ids.ZERO_SPAN)
    claimed = node_key(F.col("source_id"), F.col("trace_id"), F.col("parent_span_id"))
    order = F.struct(F.coalesce("seq", "start_ns").alias("a"), F.col("start_ns").alias("b"), F.col("row_id").alias("r"))
    firsts = sorted_join(landed(spans.groupBy(node.alias("_node")).agg(F.min(order)["r"].alias("row_id"))))
    children = spans.where(~wanted).select("row_id", claimed.alias("parent"))
    known = children.join(firsts.select(F.col("_node").alias("parent"), F.col("row_id").alias("parent_row")), "parent")
    name = F.when(F.col("_first"), F.col("_node")).otherwise(F.concat_ws("#", "_node", F.col("row_id").cast("string")))
    links = (
        spans.select("row_id", node.alias("_node"))
        .join(firsts.select("row_id", F.lit(True).alias("_first")), "row_id", "left")
        .join(sorted_join(known), "row_id", "left")
        .select("row_id", name.alias("node"), "parent", "parent_row")
    )
    return spans.join(sorted_join(landed(links)), "row_id")


def build_span_tree(spans: DataFrame, earliest_ns: int | None = None, latest_ns: int | None = None) -> DataFrame:
    """Classified spans inside the bounds, first of each dedup key, linked to parents."""
    kept = filters.overlapping(filters.classified(spans), earliest_ns, latest_ns)
    keyed = kept.withColumn("_dedup", F.col("hints.dedup_key"))
    # Written once, in columns: the steps below read some of them several times.
    keyed = landed(keyed.withColumn("row_id", F.monotonically_increasing_id()))
    order = [F.coalesce("seq", "start_ns"), "start_ns", "span_id"]
    return link_parents(filters.first_seen(keyed, "_dedup", order).drop("_dedup"))


def sort_key(mode: str = "start") -> Column:
    """Sibling order: by start (markers first at equal times) or by duration."""
    duration = F.col("end_ns") - F.col("start_ns")
    first = {
        "start": F.col("start_ns"),
        "duration_desc": -duration,
        "duration_asc": duration,
    }[mode]
    priority = F.col("hints.sort_priority") if mode == "start" else F.lit(0)
    return F.struct(first.alias("a"), priority.alias("b"), F.col("start_ns").alias("c"), F.col("node").alias("d"))


def sibling_rank(tree: DataFrame, mode: str = "start") -> DataFrame:
    """Add ``sibling``, the 0-based place among siblings, for families of any size."""
    key = sort_key(mode)
    linked = "parent_row" in tree.columns
    family = F.coalesce("parent_row", F.lit(-1)) if linked else F.coalesce("parent", F.lit(ROOT))
    by = "row_id" if linked else "node"
    rows = tree.select(by, "node", family.alias("_family"), key["a"].alias("_a"), key["b"].alias("_b"), "start_ns")
    sliced = range_slices(rows, ["_family"], ["_a", "_b", "start_ns", "node"]).select(by, "_family", "_slice", "_ord")
    ranked = rank_sliced(sliced, ["_family"])
    return tree.join(sorted_join(ranked.select(by, (F.col("rn") - 1).alias("sibling"))), by)


def numbered(tree: DataFrame, *columns: Column | str) -> tuple[DataFrame, DataFrame]:
    """Nodes by number for the rounds below, written: (id, node, parent and more columns), and (id, up) with their parents'."""
    if "parent_row" in tree.columns:
        rows = landed(tree.select(F.col("row_id").alias("id"), "node", F.col("parent_row").alias("parent"), *columns))
        return rows, _linked(rows, "id", F.coalesce("parent", -1 - F.col("id")))
    rows = landed(tree.select("node", "parent", *columns).withColumn("id", F.monotonically_increasing_id()))
    # A key that no node has, another one for each root: absent keys would all meet in one task.
    return rows, _linked(rows, "node", F.coalesce("parent", F.concat(F.lit("\0"), F.col("id").cast("string"))))


def _linked(rows: DataFrame, name: str, claimed: Column) -> DataFrame:
    above = rows.select(F.col(name).alias("_above"), F.col("id").alias("up"))
    return rows.select("id", claimed.alias("_claimed")).join(sorted_join(above), F.col("_claimed") == F.col("_above"), "left").select("id", "up")


def _ancestors(opened: DataFrame, state: DataFrame, carried: list[str]) -> DataFrame:
    """Follow the pointer ``up`` of the opened rows STEPS times: up_1 .. up_STEPS, with the ``carried`` columns of the nodes passed.

    Where a path has ended, the key is a number that no node has, another one for each row.
    """
    out = opened.withColumnRenamed("up", "up_1")
    for k in range(1, STEPS):
        passed = [F.col(c).alias(f"{c}_{k}") for c in carried]
        step = state.select(F.col("id").alias("_at"), F.col("up").alias(f"up_{k + 1}"), *passed)
        out = out.join(sorted_join(step), F.coalesce(f"up_{k}", -1 - F.col("id")) == F.col("_at"), "left").drop("_at")
    return out


def fold_up(links: DataFrame, values: dict[str, Callable[[str], Column]]) -> tuple[DataFrame, int]:
    """Combine the values of every node and all nodes below it; returns (id, values) and the rounds it took.

    ``links`` has id, up (null for roots) and the values; a value's function aggregates a column of that name, and
    must be associative, commutative and skip nulls.  Nodes on a cycle and below one are left out.
    """
    state = landed(links.select("id", "up", *values))
    still, rounds = state.where(F.col("up").isNotNull()).count(), 0
    while still:
        moved = _ancestors(state.where(F.col("up").isNotNull()), state, [])
        none = F.lit(None).cast("bigint")
        gifts = [F.struct(F.col("id"), F.col(f"up_{STEPS}").alias("up"), F.lit(True).alias("own"))]
        gifts += [F.struct(F.col(f"up_{k}").alias("id"), none.alias("up"), F.lit(False).alias("own")) for k in range(1, STEPS)]
        # to itself with the new pointer, and to the ancestors passed
        given = moved.select(F.explode(F.filter(F.array(*gifts), lambda g: g["id"].isNotNull())).alias("g"), *values).select("g.*", *values)
        ended = state.where(F.col("up").isNull()).select("id", "up", F.lit(True).alias("own"), *values)
        state = landed(
            given.unionByName(ended).groupBy("id")
            .agg(F.max(F.when(F.col("own"), F.col("up"))).alias("up"), *[f(v).alias(v) for v, f in values.items()])
        )
        before, still, rounds = still, state.where(F.col("up").isNotNull()).count(), rounds + 1
        if still == before:  # every round reaches the roots of some, unless only cycles are left
            break
    return state.where(F.col("up").isNull()).drop("up"), rounds


def sum_down(links: DataFrame, values: list[str], rounds: int) -> DataFrame:
    """(id, values): each value summed over a node and all its ancestors, in the rounds :func:`fold_up` took."""
    state = links.select("id", "up", *values)
    for _ in range(rounds):
        state = landed(state)
        moved = _ancestors(state.where(F.col("up").isNotNull()), state, values)
        total = {v: F.col(v) for v in values}
        for k in range(1, STEPS):
            total = {v: t + F.coalesce(f"{v}_{k}", F.lit(0)) for v, t in total.items()}
        moved = moved.select("id", F.col(f"up_{STEPS}").alias("up"), *[t.alias(v) for v, t in total.items()])
        state = moved.unionByName(state.where(F.col("up").isNull()))
    return state.drop("up")


def paths(links: DataFrame, step: str) -> DataFrame:
    """Root-to-node arrays for (node, parent, step): ``path`` of steps, ``id_path`` of nodes.

    Nodes on a parent cycle and below one are unreachable from any root and drop
    out.
    """
    state = landed(links.select(
        "node", F.col("parent").alias("anc"), F.array(step).alias("path"), F.array("node").alias("id_path")
    ))
    done = state.where(F.col("anc").isNull())
    while True:  # ends: a path doubles each round and stops growing at a cycle
        open_rows = state.where(F.col("anc").isNotNull() & ~F.array_contains("id_path", F.col("anc")))
        if open_rows.isEmpty():
            break
        up = done.unionByName(state.where(F.col("anc").isNotNull())).select(
            F.col("node").alias("anc"), F.col("anc").alias("_anc"),
            F.col("path").alias("_path"), F.col("id_path").alias("_ids"),
        )
        moved = open_rows.join(sorted_join(up), "anc").select(
            "node", F.col("_anc").alias("anc"), F.concat("_path", "path").alias("path"),
            F.concat("_ids", "id_path").alias("id_path"),
        )
        # paths that have reached a root are not written again
        state = landed(moved)
        done = done.unionByName(state.where(F.col("anc").isNull()))
    return done.drop("anc")


def flatten(tree: DataFrame, mode: str = "start") -> DataFrame:
    """Nodes with ``depth``, ``pre`` (place in preorder, from 0) and ``last`` (the last place below the node).

    Subtree sizes come up from the leaves; a node's place is its parent's, one more, and the sizes of its earlier
    siblings, summed down from the root.  Only numbers go through the rounds; the rows are joined once at the end.
    Nodes whose parent is missing, on a parent cycle or below either drop out.
    """
    key = sort_key(mode)
    rows, links = numbered(tree, key["a"].alias("_a"), key["b"].alias("_b"), F.col("start_ns").alias("_c"))
    lost = F.col("parent").isNotNull() & F.col("up").isNull()
    links = sorted_join(links).join(rows.select("id", "parent"), "id").select("id", F.when(lost, F.col("id")).otherwise(F.col("up")).alias("up"))
    links = sorted_join(landed(links))
    sizes, rounds = fold_up(links.withColumn("size", F.lit(1).cast("bigint")), {"size": F.sum})
    family = rows.select("id", "node", "_a", "_b", "_c").join(links, "id").join(sorted_join(sizes), "id").withColumn("_family", F.coalesce("up", F.lit(-1)))
    ranked = range_slices(family, ["_family"], ["_a", "_b", "_c", "node"]).select("id", "up", "_family", "size", "_slice", "_ord")
    ranked = sliced_window(ranked, ["_family"], "_slice", ["_ord"], sums={"_upto": F.col("size")}, write_input=False)
    below = F.col("up").isNotNull().cast("bigint")
    steps = landed(ranked.select("id", "up", "size", below.alias("depth"), (F.col("_upto") - F.col("size") + below).alias("pre")))
    places = sum_down(steps, ["depth", "pre"], rounds).join(sorted_join(steps.select("id", "size")), "id")
    found = places.select("id", F.col("depth").cast("int").alias("depth"), "pre", (F.col("pre") + F.col("size") - 1).alias("last"))
    if "parent_row" in tree.columns:
        return tree.join(sorted_join(landed(found.withColumnRenamed("id", "row_id"))), "row_id")
    return tree.join(sorted_join(landed(found.join(sorted_join(rows.select("id", "node")), "id").drop("id"))), "node")


def preorder(flat: DataFrame) -> DataFrame:
    return flat.orderBy("pre")


def node_ids(tree: DataFrame) -> DataFrame:
    """Readable ids ``name/index/name/index`` along the path from the root."""
    ranked = sibling_rank(tree)
    step = F.concat("name", F.lit("/"), F.col("sibling").cast("string"))
    found = paths(ranked.select("node", "parent", step.alias("_step")), "_step")
    return ranked.join(found.select("node", F.array_join("path", "/").alias("node_path")), "node")


def child_counts(tree: DataFrame) -> DataFrame:
    counts = tree.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("children")
    )
    return tree.join(counts, "node", "left").fillna(0, ["children"])


def item_type(hints: Column, has_children: Column) -> Column:
    category = hints["category"]
    return (
        F.when(hints["is_marker"], "Marker")
        .when(category.isin("workflow", "pipeline"), "Root")
        .when(category.isin("job", "task"), "Intermediate")
        .when(category == "step", "Leaf")
        .when(hints["is_root"], "Root")
        .when(hints["is_leaf"] | ~has_children, "Leaf")
        .otherwise("Intermediate")
    )


def with_item_type(tree: DataFrame) -> DataFrame:
    return child_counts(tree).withColumn("item_type", item_type(F.col("hints"), F.col("children") > 0))


def _upto(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(pre, last) with the sum of ``value`` over all places up to the node's; slices are stretches of places."""
    rows = rows.select("pre", "last", value.alias("_v"), F.floor(F.col("pre") / PLACES_PER_SLICE).alias("_slice"))
    return sliced_window(rows, [], "_slice", ["pre"], sums={name: F.col("_v")}).drop("_slice")


def _places(flat: DataFrame, chosen: DataFrame) -> DataFrame:
    """(pre, last) of the chosen nodes; from here on a node is known by its place."""
    return sorted_join(flat.select("node", "pre", "last")).join(chosen.select("node"), "node", "left_semi").drop("node")


def _covered(flat: DataFrame, chosen: DataFrame, itself: bool) -> DataFrame:
    """(pre, covered): how many chosen nodes each node lies below (or is); one more from a chosen node on, one less after its last place."""
    begin = F.col("pre") if itself else F.col("pre") + 1
    edges = F.array(F.struct(begin.alias("pre"), F.lit(1).alias("net")), F.struct((F.col("last") + 1).alias("pre"), F.lit(-1).alias("net")))
    net = _places(flat, chosen).select(F.explode(edges).alias("e")).groupBy("e.pre").agg(F.sum("e.net").alias("_net"))
    rows = flat.select("pre", "last").join(sorted_join(net), "pre", "left")
    return _upto(rows, F.coalesce("_net", F.lit(0)), "covered")


def _holding(flat: DataFrame, chosen: DataFrame) -> DataFrame:
    """(pre, inside, _hit): how many chosen nodes lie below each node, itself counted by ``_hit``."""
    marks = _places(flat, chosen).select("pre", F.lit(1).alias("_hit"))
    rows = flat.select("pre", "last").join(sorted_join(marks), "pre", "left")
    upto = landed(_upto(rows, F.coalesce("_hit", F.lit(0)), "_at"))
    until = upto.select(F.col("pre").alias("last"), F.col("_at").alias("_until"))
    return upto.join(sorted_join(until), "last").select("pre", F.col("_v").alias("_hit"), (F.col("_until") - F.col("_at")).alias("inside"))


def descendants(flat: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen nodes and everything below them; ``chosen`` has a ``node`` column."""
    return flat.join(sorted_join(_covered(flat, chosen, True).where("covered > 0").select("pre")), "pre", "left_semi")


def ancestors(flat: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every node above a chosen one."""
    return flat.join(sorted_join(_holding(flat, chosen).where("inside > 0").select("pre")), "pre", "left_semi")


def search(flat: DataFrame, query: str) -> DataFrame:
    """Nodes whose name contains the text, any case, with all their ancestors."""
    hit = F.lower("name").contains(query.lower())
    shown = _holding(flat, flat.where(hit)).where("inside + _hit > 0").select("pre")
    return flat.join(sorted_join(shown), "pre", "left_semi").withColumn("is_match", hit)


def to_depth(flat: DataFrame, depth: int) -> DataFrame:
    return flat.where(F.col("depth") <= depth)


def below_expanded(flat: DataFrame, expanded: DataFrame) -> DataFrame:
    """Nodes all of whose ancestors are expanded."""
    closed = sorted_join(flat.select("node")).join(expanded.select("node"), "node", "left_anti")
    return flat.join(sorted_join(_covered(flat, closed, False).where("covered = 0").select("pre")), "pre", "left_semi")


def exclude(spans: DataFrame, hidden: DataFrame) -> DataFrame:
    """Spans whose span id is not hidden."""
    return spans.join(hidden.select("span_id"), "span_id", "left_anti")


def steps_of_jobs(spans: DataFrame) -> DataFrame:
    """Step spans joined to the job span above them."""
    kind = attribute(spans, "type")
    jobs = spans.where(kind == "job").select(
        "source_id", "trace_id", F.col("span_id").alias("parent_span_id"),
        attribute(spans, "github.job_id").cast("bigint").alias("job_id"), F.col("name").alias("job_name"),
    )
    steps = spans.where(kind == "step").withColumn(
        "number", attribute(spans, "github.step_number").cast("int")
    )
    # ids travel as bytes, half as long as their hex digits
    keys = ["source_id", "trace_id", "parent_span_id"]
    steps = steps.withColumns({c: ids.packed(F.col(c)) for c in [*keys[1:], "span_id"]})
    found = steps.join(jobs.withColumns({c: ids.packed(F.col(c)) for c in keys[1:]}), keys)
    return found.withColumns({c: ids.unpacked(F.col(c)) for c in [*keys[1:], "span_id"]})


def effective_times(flat: DataFrame, hidden: Column, info: Column | None = None) -> DataFrame:
    """Bounds of every node from its shown children, bottom-up.

    A node without shown children has null times; a node whose shown children
    all have null times keeps its own; a leaf keeps its own.  Which of these a
    node is, its children tell in one pass; bounds then come up over the shown
    nodes that have times, so rounds grow with the logarithm of the depth.
    """
    info = F.lit(False) if info is None else info
    names, links = numbered(flat, "start_ns", "end_ns", (~hidden & ~info).alias("shown"))
    rows = landed(names.select("id", "start_ns", "end_ns", "shown").join(sorted_join(links), "id"))
    kids = rows.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("id")).agg(F.count_if("shown").alias("n_shown"))
    rows = rows.join(sorted_join(kids), "id", "left").withColumn("bare", F.coalesce(F.col("n_shown") == 0, F.lit(False)))
    rows = landed(rows.withColumn("gives", F.col("shown") & ~F.col("bare")))
    takers = rows.where(F.col("gives")).select(F.col("up").alias("id")).where(F.col("id").isNotNull()).distinct().withColumn("takes", F.lit(True))
    rows = landed(rows.join(sorted_join(takers), "id", "left"))
    own = F.col("takes").isNull() & ~F.col("bare")
    links = rows.select(
        "id", F.when(F.col("gives"), F.col("up")).alias("up"),
        F.when(own, F.col("start_ns")).alias("low"), F.when(own, F.col("end_ns")).alias("high"),
    )
    bounds, _ = fold_up(links, {"low": F.min, "high": F.max})

    def kept(bound: str, times: str) -> Column:
        return F.when(~F.col("bare"), F.coalesce(bound, times))

    return rows.join(sorted_join(bounds), "id").join(sorted_join(names.select("id", "node")), "id").select(
        "node", kept("low", "start_ns").alias("effective_start_ns"), kept("high", "end_ns").alias("effective_end_ns")
    )


def tree_counts(tree: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Roots, and nodes that are neither root, marker nor leaf."""
    h = F.col("hints")
    return tree.groupBy(*(keys or [])).agg(
        F.count_if(F.col("parent").isNull() & h["is_root"]).alias("workflows"),
        F.count_if(~h["is_root"] & ~h["is_marker"] & ~h["is_leaf"]).alias("jobs"),
    )


def tree_stats(items: DataFrame, hidden: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts, compute time and bounds over items that are not hidden.

    ``items`` come from :func:`with_item_type`.  Roots count once per name, with
    the outcome of the first seen.
    """
    by = keys or []
    shown = items.join(hidden.select("node"), "node", "left_anti")
    h = F.col("hints")
    work = (F.col("item_type") == "Intermediate") & h["category"].isin("job", "task")
    took = ids.ns_to_ms(F.col("end_ns") - F.col("start_ns"))
    base = shown.groupBy(*by).agg(
        F.count_if(work).alias("total_jobs"),
        F.count_if(work & (h["outcome"] == "failure")).alias("failed_jobs"),
        F.count_if(F.col("item_type") == "Leaf").alias("step_count"),
        F.coalesce(F.sum(F.when(work & (took > 0), took)), F.lit(0)).alias("compute_ms"),
        F.min("start_ns").alias("start_ns"),
        F.max("end_ns").alias("end_ns"),
    )
    first = shown.where(F.col("item_type") == "Root").groupBy(*by, "name").agg(
        F.min_by(h["outcome"], F.struct("start_ns", "node")).alias("outcome")
    )
    roots = first.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(F.col("outcome") == "success").alias("successful_runs")
    )
    wall = F.greatest(ids.ns_to_ms(F.col("end_ns") - F.col("start_ns")), F.lit(0))
    if by:
        out = base.join(roots, by, "left")
    else:
        one = F.lit(1)
        out = base.withColumn("_one", one).join(roots.withColumn("_one", one), "_one", "left").drop("_one")
    return out.fillna(0, ["total_runs", "successful_runs"]).withColumn("wall_ms", wall)


def after_end(spans: DataFrame, end_ns: int) -> DataFrame:
    """Flag spans that start after a chosen logical end."""
    return spans.withColumn("is_after_end", F.col("start_ns") > end_ns)


def effective_duration(spans: DataFrame, end_ns: int) -> DataFrame:
    span = (F.lit(end_ns) - F.min("start_ns")) / 1e9
    return spans.agg(F.greatest(span, F.lit(0.0)).alias("effective_seconds"))


def timeline_bucket(start: Column, low: Column, high: Column, width: int) -> Column:
    """Place of a start time in 0..width-1 of the bounds; null when the bounds are empty."""
    inside = F.least(F.greatest(start, low), high)
    place = F.floor((inside - low) / (high - low) * width).cast("int")
    return F.when(high > low, F.greatest(F.least(place, F.lit(width - 1)), F.lit(0)))


def attr_groups(spans: DataFrame) -> DataFrame:
    """Dotted attribute keys as a collapsed tree, one row per node, without a shuffle.

    A prefix is a node when it is a key itself or branches; chains with one child
    melt into their child's label.  Empty values are skipped.
    """
    keys = F.map_keys(F.map_filter("attrs", lambda _, v: F.coalesce(v, F.lit("")) != ""))
    rows = spans.select("source_id", "trace_id", "span_id", "attrs", keys.alias("keys"))

    def prefixes(key: Column) -> Column:
        parts = F.split(key, r"\.")
        return F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ".")
        )

    rows = rows.withColumn(
        "prefixes", F.array_distinct(F.flatten(F.transform("keys", prefixes)))
    )

    def is_child(p: Column, q: Column) -> Column:
        """q is one segment below p."""
        return q.startswith(F.concat(p, F.lit("."))) & ~F.contains(
            F.substring(q, F.length(p) + F.lit(2), F.length(q)), F.lit(".")
        )

    rows = rows.withColumn(
        "nodes",
        F.filter(
            "prefixes",
            lambda p: F.array_contains(F.col("keys"), p)
            | (F.size(F.filter(F.col("prefixes"), lambda q: is_child(p, q))) > 1),
        ),
    )
    out = rows.select(
        "source_id", "trace_id", "span_id", "attrs", "nodes", F.explode("nodes").alias("path")
    )
    over = F.filter("nodes", lambda q: F.col("path").startswith(F.concat(q, F.lit("."))))
    parent = F.array_max(F.transform(over, lambda q: F.struct(F.length(q).alias("l"), q.alias("q"))))["q"]
    out = out.withColumn("parent_path", F.coalesce(parent, F.lit("")))
    label = F.when(F.col("parent_path") == "", F.col("path")).otherwise(
        F.expr("substring(path, length(parent_path) + 2)")
    )
    return out.select(
        "source_id", "trace_id", "span_id", "path", "parent_path", label.alias("label"),
        F.coalesce(F.col("attrs")[F.col("path")], F.lit("")).alias("value"),
    )
