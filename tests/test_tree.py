import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import enrich, tree
from spanloom.schemas import conform_spans
from spanloom.session import cut, landed


def test_repeated_ids_keep_their_rows(spark):
    # one job with two steps of one name, below a chain of eight
    rows = [(f"{i:016x}", f"{i - 1:016x}" if i > 1 else None, f"n{i}", i) for i in range(1, 9)]
    rows += [(f"{100:016x}", f"{8:016x}", "Run x", 20), (f"{100:016x}", f"{8:016x}", "Run x", 21), (f"{200:016x}", f"{100:016x}", "below", 22)]
    spans = conform_spans(spark.createDataFrame(rows, "span_id string, parent_span_id string, name string, seq long").withColumns({
        "source_id": F.lit(0), "trace_id": F.lit("a" * 32), "kind": F.lit("INTERNAL"), "start_ns": F.col("seq") * 1000, "end_ns": F.col("seq") * 1000 + 10,
    }))
    built = tree.build_span_tree(enrich.enrich(spans, enrich.chain(ci=False)))
    flat = tree.flatten(built).collect()
    assert len(flat) == len(rows) and len({r["node"] for r in flat}) == len(rows)
    assert sorted(r["depth"] for r in flat) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9]
    assert tree.sibling_rank(built).count() == len(rows)
    assert tree.node_ids(built).count() == len(rows)
    below = next(r for r in flat if r["name"] == "below")
    assert below["parent"] == next(r["node"] for r in flat if r["name"] == "Run x" and r["start_ns"] == 20_000)
    assert sorted(r["pre"] for r in flat) == list(range(len(rows)))


def shape(spark, rows):
    """(node, parent, start, end, name) as a tree."""
    df = spark.createDataFrame(rows, "node string, parent string, start_ns long, end_ns long, name string")
    return df.withColumn("hints", F.struct(F.lit(0).alias("sort_priority"))).repartition(3)


def plain_order(rows):
    """{node: (depth, pre, last)} by walking; nodes no root reaches are missing."""
    kids = {}
    for node, parent, start, *_ in rows:
        kids.setdefault(parent, []).append((start, node))
    out = {}

    def walk(node, depth):
        pre = len(out)
        out[node] = None
        for _, child in sorted(kids.get(node, [])):
            walk(child, depth + 1)
        out[node] = (depth, pre, len(out) - 1)

    for _, node in sorted(kids.get(None, [])):
        walk(node, 0)
    return out


def plain_bounds(rows, hidden):
    kids = {}
    for node, parent, *_ in rows:
        kids.setdefault(parent, []).append(node)
    own = {r[0]: (r[2], r[3]) for r in rows}

    def bounds(node):
        below = kids.get(node, [])
        if not below:
            return own[node]
        shown = [bounds(c) for c in below if not hidden(c)]
        if not shown:
            return (None, None)
        shown = [b for b in shown if b[0] is not None]
        return (min(b[0] for b in shown), max(b[1] for b in shown)) if shown else own[node]

    return {n: bounds(n) for n in own}


def random_tree(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        up = None if i == 0 or r.random() < 0.03 else r.randrange(max(0, i - 3), i) if seed % 2 else r.randrange(i)
        start = r.randrange(50)
        rows.append((f"n{i}", None if up is None else f"n{up}", start, start + r.randrange(30), r.choice(["ab", "Cd"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_flat_tree_equals_a_walk(spark, seed):
    rows = random_tree(seed, 150)
    cycle = [("x", "y", 1, 2, "ab"), ("y", "x", 1, 2, "ab"), ("z", "x", 1, 2, "ab"), ("lost", "nowhere", 1, 2, "ab"), ("under", "lost", 1, 2, "ab")]
    flat = cut(tree.flatten(shape(spark, rows + cycle)))
    got = {r["node"]: (r["depth"], r["pre"], r["last"]) for r in flat.collect()}
    assert got == plain_order(rows)
    parent = {r[0]: r[1] for r in rows}

    def above(node):
        while parent[node] is not None:
            node = parent[node]
            yield node

    chosen = {f"n{i}" for i in range(0, 150, 11)}
    picked = spark.createDataFrame([(c,) for c in chosen], "node string")
    assert {r["node"] for r in tree.descendants(flat, picked).collect()} == {n for n in parent if n in chosen or chosen & set(above(n))}
    assert {r["node"] for r in tree.ancestors(flat, picked).collect()} == {a for c in chosen for a in above(c)}
    hits = {r[0] for r in rows if r[4] == "Cd"}
    assert {r["node"]: r["is_match"] for r in tree.search(flat, "cD").collect()} == {n: n in hits for n in hits | {a for c in hits for a in above(c)}}
    opened = {n for n in parent if hash(n[1:]) % 3}
    seen = tree.below_expanded(flat, spark.createDataFrame([(c,) for c in opened], "node string"))
    assert {r["node"] for r in seen.collect()} == {n for n in parent if set(above(n)) <= opened}
    want = plain_bounds(rows, lambda n: int(n[1:]) % 3 == 0)
    times = tree.effective_times(flat, F.substring("node", 2, 9).cast("int") % 3 == 0).collect()
    assert {r["node"]: (r["effective_start_ns"], r["effective_end_ns"]) for r in times} == want


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_long_chain_takes_few_jobs(spark):
    n = 2_000
    rows = spark.range(n).select(
        F.format_string("c%d", "id").alias("node"), F.when(F.col("id") > 0, F.format_string("c%d", F.col("id") - 1)).alias("parent"),
        F.col("id").alias("start_ns"), (F.lit(2 * n) - F.col("id")).alias("end_ns"), F.lit("x").alias("name"), F.struct(F.lit(0).alias("sort_priority")).alias("hints"),
    )
    flat, took = jobs(spark, "chain", lambda: cut(tree.flatten(rows)))
    assert flat.where(F.col("depth") == F.col("start_ns")).where(F.col("pre") == F.col("start_ns")).where(F.col("last") == n - 1).count() == n
    times, more = jobs(spark, "bounds", lambda: cut(tree.effective_times(flat, F.lit(False))))
    assert times.where((F.col("effective_start_ns") == n - 1) & (F.col("effective_end_ns") == n + 1)).count() == n
    print("jobs", took, more)


def test_a_star(spark):
    n = 20_000
    rows = spark.range(n).select(
        F.format_string("c%d", "id").alias("node"), F.when(F.col("id") > 0, F.lit("c0")).alias("parent"),
        F.col("id").alias("start_ns"), (F.col("id") + 1).alias("end_ns"), F.lit("x").alias("name"), F.struct(F.lit(0).alias("sort_priority")).alias("hints"),
    )
    flat = cut(tree.flatten(rows))
    assert flat.where(F.col("pre") == F.col("start_ns")).count() == n
    top = tree.effective_times(flat, F.lit(False)).where("node = 'c0'").first()
    assert (top["effective_start_ns"], top["effective_end_ns"]) == (1, n)


def test_ended_paths_do_not_meet_in_one_task(spark):
    state = spark.range(4_000).select("id", F.when(F.col("id") % 100 == 1, F.col("id") - 1).alias("up"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sizes = [r["count"] for r in tree._ancestors(state, state, []).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4_000 and max(sizes) < 2_000


def test_rows_whose_parent_was_taken_out_drop_out(spark):
    rows = [(f"{i:016x}", f"{i - 1:016x}" if i > 1 else None, f"n{i}", i) for i in range(1, 7)]
    spans = conform_spans(spark.createDataFrame(rows, "span_id string, parent_span_id string, name string, seq long").withColumns({
        "source_id": F.lit(0), "trace_id": F.lit("a" * 32), "kind": F.lit("INTERNAL"), "start_ns": F.col("seq") * 1000, "end_ns": F.col("seq") * 1000 + 10,
    }))
    built = tree.build_span_tree(enrich.enrich(spans, enrich.chain(ci=False)))
    names = {r["row_id"]: r["name"] for r in built.collect()}
    assert {(r["name"], names.get(r["parent_row"])) for r in built.collect()} == {(f"n{i}", f"n{i - 1}" if i > 1 else None) for i in range(1, 7)}
    left = tree.flatten(built.where("name <> 'n4'")).collect()
    assert {(r["name"], r["depth"], r["last"]) for r in left} == {("n1", 0, 2), ("n2", 1, 2), ("n3", 2, 2)}


def test_written_row_numbers_are_not_broadcast(spark):
    # 300,000 rows that pack to a fraction of the 10 MB up to which Spark broadcasts
    links = landed(spark.range(300_000).select("id", F.when(F.col("id") > 0, F.floor(F.col("id") / 5)).alias("up")))
    plans = [tree._ancestors(links.withColumn("size", F.lit(1)), links, [])]
    places = landed(spark.range(1000).select(
        F.col("id").cast("string").alias("node"), F.col("id").alias("pre"), F.when(F.col("id") == 0, 999).otherwise(F.col("id")).alias("last"),
        F.lit("n").alias("name"),
    ))
    chosen = places.where(F.col("pre") % 7 == 0).select("node")
    plans += [tree.descendants(places, chosen), tree.ancestors(places, chosen), tree.search(places, "n"), tree.below_expanded(places, chosen)]
    rows = [("r", None, 0, 9, "r")] + [(f"c{i}", "r", i, i + 2, "c") for i in range(20)]
    built = shape(spark, rows)
    plans += [tree.flatten(built), tree.effective_times(built, F.col("start_ns") % 3 == 0)]
    for df in plans:
        plan = df._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "_slice" not in x]
    assert plans[0].where(F.col("up_2") == F.floor(F.col("up_1") / 5)).count() == 299_995
