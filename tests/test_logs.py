import datetime as dt

from pyspark.sql import functions as F

from spanloom.operators import logs

BASE = dt.datetime(2024, 1, 15, 10, 0, 0)


def stamp(seconds):
    at = BASE + dt.timedelta(seconds=seconds)
    return at.strftime("%Y-%m-%dT%H:%M:%S.%f") + "0Z"


def parsed(spark, lines, end, gaps=None):
    raw = spark.createDataFrame([(1, i, f"{stamp(t)} {c}") for i, (t, c) in enumerate(lines)], "job_id bigint, pos bigint, line string")
    steps = spark.createDataFrame([(1, 1, "Build", BASE, BASE + dt.timedelta(seconds=end))], "job_id bigint, number int, name string, started_at timestamp, completed_at timestamp")
    rows = logs.parse_lines(logs.assign_steps(raw, steps))
    spans = logs.parsed_spans(rows, logs.step_bounds(steps), gaps=gaps)
    return spans.orderBy("start_t", "depth").collect()


def test_gaps_make_spans_named_by_their_first_line(spark):
    lines = [(0, "first"), (0.1, "b"), (0.2, "c"), (2.2, "second"), (2.3, "d"), (5.3, "third")]
    got = parsed(spark, lines, 6, logs.Gaps(gap=5_000_000))
    assert [r["name"] for r in got] == ["first", "second", "third"]
    assert [(r["end_t"] - r["start_t"]) / 1e7 for r in got] == [2.2, 3.1, 0.7]


def test_one_piece_gives_nothing(spark):
    assert parsed(spark, [(0, "a"), (0.1, "b")], 6) == []


def test_gradle(spark):
    got = parsed(spark, [(0, "> Task :app:compile"), (5, "> Task :app:test FAILED"), (9, "BUILD FAILED")], 10)
    assert [(r["name"], r["attrs"]["gradle.task.outcome"]) for r in got] == [(":app:compile", "SUCCESS"), (":app:test", "FAILED")]
    assert got[0]["parser"] == "gradle" and got[1]["end_t"] - got[1]["start_t"] == 5 * 10_000_000


def test_bazel_start_phase_and_merge(spark):
    lines = [(2, "Loading: 3 packages"), (3, "[1 / 9] Compiling a"), (4, "Loading: late"), (5, "[2 / 9] Compiling a"), (6, "[3 / 9] 1 / 2 tests; no actions running"), (7, "[3 / 9] 2 / 2 tests; no actions running")]
    got = parsed(spark, lines, 10)
    assert [r["name"] for r in got] == ["Starting", "Loading", "Compiling a (×2)", "1 / 2 tests; no actions running (×2)"]


def test_setup_phases(spark):
    lines = [(0, "Current runner version: 2"), (1, "Getting action download info"), (2, "Download action repository 'a'"), (3, "Download action repository 'b'"), (4, "Complete job name: x")]
    got = parsed(spark, lines, 5)
    assert [r["name"] for r in got] == ["Runner setup", "Resolve actions", "Download actions", "Prepare job"]


def test_groups_hold_their_pieces(spark):
    lines = [(0, "##[group]Run tests"), (0.5, "alpha"), (3, "beta"), (5, "##[endgroup]"), (6, "##[group]Lost"), (6.5, "x"), (7, "##[group]Upload"), (8, "y")]
    got = {r["name"]: r for r in parsed(spark, lines, 10)}
    assert set(got) == {"Run tests", "alpha", "beta", "Upload"}
    assert got["alpha"]["parent_key"] == got["Run tests"]["key"] and got["alpha"]["attrs"]["log.line_number"] == "1"
    assert got["Run tests"]["end_t"] == got["Upload"]["start_t"]


def test_prefix_runs_and_noise(spark):
    lines = [(0, "Compiling a"), (2, "Compiling b"), (4, "Compiling c"), (6, "...."), (8, "-----"), (10, "done here")]
    got = parsed(spark, lines, 12)
    names = [r["name"] for r in got]
    assert names == ["Compiling (x3, 6s)", "a", "b", "c", ".... (x2, 4s)", "done here"]


def test_lines_find_their_step(spark):
    steps = spark.createDataFrame(
        [(1, 1, "a", BASE + dt.timedelta(seconds=10), BASE + dt.timedelta(seconds=20)), (1, 2, "b", BASE + dt.timedelta(seconds=20), BASE + dt.timedelta(seconds=30)),
         (1, 3, "c", BASE + dt.timedelta(seconds=40), BASE + dt.timedelta(seconds=50))],
        "job_id bigint, number int, name string, started_at timestamp, completed_at timestamp")
    times = [(5, 1), (15, 1), (20, 2), (35, 2), (45, 3), (99, 3)]
    raw = spark.createDataFrame([(1, i, f"{stamp(t)} x") for i, (t, _) in enumerate(times)] + [(1, 90, "short"), (1, 91, "x" * 40)], "job_id bigint, pos bigint, line string")
    got = {r["pos"]: r["number"] for r in logs.assign_steps(raw, steps).collect()}
    assert got == {**{i: n for i, (_, n) in enumerate(times)}, 90: 3}


def test_texts_stay_whole_on_request(spark):
    from spanloom.functions import text
    from spanloom.operators import enrich
    from spanloom.sinks import spans as sink

    long = "select " + "x" * 3000
    one = spark.createDataFrame([(long,)], "t string")
    assert one.select(text.truncate(F.col("t"), None)).first()[0] == long and len(one.select(text.truncate(F.col("t"), 80)).first()[0]) == 80
    span = one.select(
        F.lit(0).alias("source_id"), F.lit("a" * 32).alias("trace_id"), F.lit("b" * 16).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"),
        F.lit("q").alias("name"), F.lit("CLIENT").alias("kind"), F.lit(1).cast("long").alias("start_ns"), F.lit(9).cast("long").alias("end_ns"), F.lit("OK").alias("status_code"),
        F.create_map(F.lit("db.system"), F.lit("pg"), F.lit("db.statement"), F.col("t")).alias("attrs"), F.create_map().cast("map<string,string>").alias("resource"),
    )
    details = [enrich.enrich(span, enrich.chain(ci=False, statement_bytes=n)).first()["hints"]["detail"] for n in (None, 80)]
    assert details == [f"pg: {long}", f"pg: {long[:77]}..."]
    values = [sink.assign_tracks(span, n).first()["attrs"]["db.statement"] for n in (None, 1000)]
    assert values == [long, long[:1000] + "..."]
