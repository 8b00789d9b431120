"""Sliced operators against plain windows, with one key holding most rows."""

import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import intervals, metrics
from spanloom.operators.ordered import global_rank, order_stats, sliced_window


def hot_rows(spark, n=600):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(50), i, rng.randrange(9000)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t int, id int, v bigint")


def test_global_rank_equals_row_number(spark):
    df = hot_rows(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("k")))
    got = global_rank(df, ["k"], ["t", "id"])
    assert sorted(map(tuple, got.select("id", "rn", "n").collect())) == sorted(map(tuple, want.select("id", "rn", "n").collect()))


def test_global_rank_without_keys(spark):
    df = hot_rows(spark, 100)
    got = {r["id"]: r["rn"] for r in global_rank(df, [], ["t", "id"]).collect()}
    order = sorted(df.collect(), key=lambda r: (r["t"], r["id"]))
    assert got == {r["id"]: i + 1 for i, r in enumerate(order)}


def test_sliced_window_equals_plain_windows(spark):
    df = hot_rows(spark).withColumn("s", F.floor(F.col("t") / 7)).withColumn("m", F.when(F.col("v") % 5 == 0, F.col("v")))
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select(
        "id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("a"), F.lag("m").over(w).alias("b"),
        F.lead("v").over(w).alias("c"), F.last("m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("d"),
    )
    got = sliced_window(
        df, ["k"], "s", ["t", "id"], sums={"a": F.col("v")}, lags={"b": F.col("m")}, leads={"c": F.col("v")}, lasts={"d": F.col("m")}
    ).select("id", "a", "b", "c", "d")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_order_stats_equal_sorted_values(spark):
    df = hot_rows(spark)
    got = {r["k"]: (r["p95"], r["med"]) for r in order_stats(df, ["k"], "v", {"p95": 95}, "med", width=100).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r["k"], []).append(r["v"])
    for key, values in groups.items():
        values.sort()
        n = len(values)
        mid = values[n // 2] if n % 2 else (values[n // 2 - 1] + values[n // 2]) / 2
        assert got[key] == (values[-(-n * 95 // 100) - 1], mid)


def test_islands_number_runs(spark):
    rows = [("a", i, c) for i, c in enumerate("xxyxxxzz")]
    df = spark.createDataFrame(rows, "k string, i int, c string").withColumn("s", F.floor(F.col("i") / 3))
    got = intervals.islands(df, ["k"], "s", ["i"], F.col("c"), "run").orderBy("i").collect()
    assert [r["run"] for r in got] == [1, 1, 2, 3, 3, 3, 4, 4]


def test_max_concurrency_orders_ties_both_ways(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("b", 1000, 4000), ("b", 2000, 3500), ("b", 3000, 5000)], "k string, start_ms bigint, end_ms bigint")
    starts = {r[0]: r[1] for r in metrics.max_concurrency(df, ["k"]).collect()}
    ends = {r[0]: r[1] for r in metrics.max_concurrency(df, ["k"], ends_first=True).collect()}
    assert starts == {"a": 2, "b": 3}
    assert ends == {"a": 1, "b": 3}


def innermost(rows):
    """Row by row: the last earlier event that ends after the start."""
    out = {}
    for key in {r[0] for r in rows}:
        order = sorted([r for r in rows if r[0] == key], key=lambda r: (r[2], -r[3], r[1]))
        for i, r in enumerate(order):
            open_ = [p for p in order[:i] if p[2] + p[3] > r[2]]
            out[r[1]] = open_[-1][1] if open_ else None
    return out


def check_nesting(spark, rows, per):
    df = spark.createDataFrame(rows, "tid string, seq bigint, ts_ns bigint, dur_ns bigint").repartition(3)
    got = intervals.nest_by_containment(df, ["tid"], rows_per_slice=per).collect()
    assert len(got) == len(rows) and {r["seq"]: r["parent_seq"] for r in got} == innermost(rows)


@pytest.mark.parametrize("per", [1, 3, 25])
def test_nesting_equals_stack_on_hot_threads(spark, per):
    rng = random.Random(per)
    check_nesting(spark, [("t", i, rng.randrange(500), rng.choice([0, 1, 5, 40, 300])) for i in range(300)], per)
    check_nesting(spark, [(rng.choice("abc"), i, rng.randrange(40), rng.choice([0, 1, 2, 30])) for i in range(300)], per)
    check_nesting(spark, [("t", i, i, 1000 - 2 * i) for i in range(200)], per)  # one inside the other
    check_nesting(spark, [(chr(97 + i % 20), i, rng.randrange(40), rng.choice([0, 1, 200])) for i in range(200)], per)


def test_nesting_of_a_dense_moment(spark):
    """60,000 events in one microsecond and one far away: cut by rows, not by time."""
    n = 60_000
    df = spark.range(n).select(
        F.lit("t").alias("tid"), F.col("id").alias("seq"), F.expr("CASE WHEN id = 0 THEN 0 WHEN id = 1 THEN 900000000000 ELSE id % 1000 END").alias("ts_ns"),
        F.expr("CASE WHEN id = 0 THEN 5000 WHEN id = 1 THEN 10 WHEN id % 7 = 0 THEN 40 ELSE id % 3 END").alias("dur_ns"),
    )
    rows = [tuple(r) for r in df.collect()]
    order = sorted(rows, key=lambda r: (r[2], -r[3], r[1]))
    stack, want = [], {}
    for _, seq, start, length in order:
        while stack and stack[-1][0] <= start:
            stack.pop()
        want[seq] = stack[-1][1] if stack else None
        if length:
            stack.append((start + length, seq))
    got = intervals.nest_by_containment(df, ["tid"], rows_per_slice=4096)
    assert {r["seq"]: r["parent_seq"] for r in got.collect()} == want


def test_concurrency_equals_sweep(spark):
    rng = random.Random(9)
    rows = [(rng.choice("aab"), a := rng.randrange(200), a + rng.randrange(0, 50)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, start_ms bigint, end_ms bigint").repartition(3)
    for ends_first in (False, True):
        want = {}
        for k in "ab":
            points = sorted((t, d if ends_first else -d) for r in rows if r[0] == k for t, d in ((r[1], 1), (r[2], -1)))
            now = peak = 0
            for i, (t, d) in enumerate(points):
                now += d if ends_first else -d
                if i + 1 == len(points) or points[i + 1] != (t, d):
                    peak = max(peak, now) if not ends_first or i + 1 == len(points) or points[i + 1][0] != t else peak
            want[k] = peak
        assert dict(map(tuple, metrics.max_concurrency(df, ["k"], ends_first=ends_first).collect())) == want


@pytest.mark.parametrize("per", [2, 13, 1000])
def test_overlaps_match_brute_force(spark, per):
    rng = random.Random(per)
    rows = [(rng.choice("sst"), i, a := rng.randrange(300), a + rng.choice([0, 1, 5, 60])) for i in range(120)]
    rows += [("s", 1000 + i, i, 400 - i) for i in range(10)] + [("s", 2000, None, 5), ("s", 2001, 5, None)]  # long ones over many units
    df = spark.createDataFrame(rows, "k string, id bigint, start_ms bigint, end_ms bigint").repartition(3)
    full = [r for r in rows if None not in r]
    want = {(x[1], y[1]) for x in full for y in full if x[0] == y[0] and x[1] < y[1] and x[2] < y[3] and y[2] < x[3]}
    pairs = [(r["id_1"], r["id_2"]) for r in intervals.overlapping_pairs(df, ["k"], "id", rows_per_slice=per).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_overlap_counts_match_brute_force(spark):
    rng = random.Random(5)
    rows = [("s", i, a := rng.randrange(300), a + rng.randrange(1, 60)) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, id bigint, start_ms bigint, end_ms bigint")
    want = {(x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and x[2] < y[3] and y[2] < x[3]}
    counts = {r["id"]: r["overlaps"] for r in intervals.overlap_counts(df, ["k"], "id").collect()}
    assert counts == {i: sum(i in p for p in want) for i in range(80)}
