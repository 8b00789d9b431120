import datetime as dt

from pyspark.sql import functions as F

from spanloom.functions import codes, ids
from spanloom.operators import ci_spans, enrich, metrics, tree
from spanloom.schemas import RUNS, conform, conform_spans

START = dt.datetime(2026, 3, 18, 17)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def ci_tables(spark):
    """Three runs, one of them retried; the second run's job goes on."""
    runs = spark.createDataFrame(
        [(0, r, a, "CI", s, c, at(0), at(5), at(500), "o", "r") for r, a, s, c in [(1, 2, "completed", "success"), (2, 1, "in_progress", None), (3, 1, "completed", "failure")]],
        "source_id int, run_id bigint, run_attempt bigint, name string, status string, conclusion string, created_at timestamp, "
        "run_started_at timestamp, updated_at timestamp, owner string, repo string",
    )
    rows = [(1, 10, 1, "completed", "failure"), (1, 11, 2, "completed", "success"), (2, 20, 1, "in_progress", None), (3, 30, 1, "completed", "skipped"), (3, 31, 1, "completed", "failure")]
    jobs = spark.createDataFrame(
        [(r, j, a, f"job{j}", s, c, at(1), at(10), at(100) if c else None, "runner", "") for r, j, a, s, c in rows],
        "run_id bigint, job_id bigint, run_attempt bigint, name string, status string, conclusion string, created_at timestamp, "
        "started_at timestamp, completed_at timestamp, runner_name string, html_url string",
    )
    steps = F.array(*[
        F.struct(F.lit(n).alias("number"), F.lit(f"Step {n}").alias("name"), F.lit("completed").alias("status"), F.lit("success").alias("conclusion"),
                 F.col("started_at"), (F.col("started_at") + F.expr(f"INTERVAL {n} SECONDS") if n < 3 else F.lit(None).cast("timestamp")).alias("completed_at"))
        for n in (1, 2, 3)
    ])
    jobs = jobs.withColumn("steps", steps)
    return conform(runs, RUNS), jobs, jobs.select("run_id", "job_id", "run_attempt", F.explode("steps").alias("s")).select("run_id", "job_id", "run_attempt", "s.*")


def rows_of(spans):
    maps = [c for c, kind in spans.dtypes if "map" in kind]
    return sorted(str(r) for r in spans.withColumns({c: F.to_json(c) for c in maps}).collect())


def test_jobs_are_read_once_for_all_spans(spark):
    runs, jobs, steps = ci_tables(spark)
    read = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            read.add(batch.num_rows)
            yield batch

    jobs = jobs.drop("steps")
    spans = ci_spans.build_spans(runs, jobs.mapInArrow(count, jobs.schema), steps)
    assert spans.where(F.col("attrs")["type"] == "job").count() == 5
    spans.collect()
    assert read.value == 5


def test_nested_steps_make_the_same_spans(spark):
    runs, jobs, steps = ci_tables(spark)
    joined, nested = ci_spans.build_spans(runs, jobs.drop("steps"), steps), ci_spans.build_spans(runs, jobs)
    assert rows_of(nested) == rows_of(joined) and nested.where(F.col("attrs")["type"] == "step").count() == 10


def test_known_attributes_change_no_hint(spark):
    runs, jobs, _ = ci_tables(spark)
    keys = [*enrich.looked_up(), "queue_time_ms", "github.run_attempt", "no.such"]
    plain, beside = ci_spans.build_spans(runs, jobs), ci_spans.build_spans(runs, jobs, known=keys)
    differ = [~beside["attrs"][k].eqNullSafe(codes.attribute(beside, k)) for k in keys]
    for test in differ:
        assert beside.where(test).count() == 0
    flat = enrich.enrich(beside).drop(*[codes.known_column(k) for k in keys])
    assert rows_of(flat) == rows_of(enrich.enrich(plain))
    assert metrics.summarize(enrich.enrich(beside)).collect() == metrics.summarize(enrich.enrich(plain)).collect()


def test_a_kind_of_known_spans_is_chosen_without_the_others(spark):
    runs, jobs, _ = ci_tables(spark)
    spans = ci_spans.build_spans(runs, jobs, known=["type", "github.status"])
    chosen = spans.where(codes.attribute(spans, "type") == "job").groupBy(codes.attribute(spans, "github.status")).count()
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "map(" not in plan


def test_packed_ids_come_back(spark):
    texts = ["a" * 32, "0123456789abcdef", "0123456789ABCDEF", "", "abc", "é" * 8, "ab" * 4, "\x00" * 8, "0123456789abcdef0", None, "x" * 16, "ab" * 17]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", ids.packed(F.col("t")))
    got = df.select("t", "p", ids.unpacked(F.col("p")).alias("back")).collect()
    assert all(r["t"] == r["back"] for r in got)
    packs = [bytes(r["p"]) for r in got if r["t"] is not None]
    assert len(set(packs)) == len(packs) and len(packs[0]) == 16 and len(packs[1]) == 8


def test_steps_of_jobs_travel_packed(spark):
    rows = [("job", "T1", "a", None, "7"), ("job", "f" * 32, "0" * 15 + "1", None, "8"), ("step", "T1", "b", "a", "1"), ("step", "f" * 32, "0" * 15 + "2", "0" * 15 + "1", "2"), ("step", "t1", "c", "a", "3")]
    df = spark.createDataFrame(rows, "kind string, trace_id string, span_id string, parent_span_id string, n string")
    spans = conform_spans(df.withColumns({
        "source_id": F.lit(0), "name": F.col("span_id"), "start_ns": F.lit(0), "end_ns": F.lit(1),
        "attrs": F.create_map(F.lit("type"), F.col("kind"), F.lit("github.job_id"), F.col("n"), F.lit("github.step_number"), F.col("n")),
    }).drop("kind", "n"))
    found = tree.steps_of_jobs(spans)
    got = {(r["trace_id"], r["parent_span_id"], r["span_id"], r["job_id"], r["number"], r["job_name"]) for r in found.collect()}
    assert got == {("T1", "a", "b", 7, 1, "a"), ("f" * 32, "0" * 15 + "1", "0" * 15 + "2", 8, 2, "0" * 15 + "1")}
    plan = found.select("span_id", "job_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex" in plan


def test_formats_that_no_file_has_cost_nothing(spark, tmp_path):
    import gzip
    import json

    from spanloom.sources import traces

    def line(i):
        return json.dumps({"Name": f"n{i}", "SpanContext": {"TraceID": "a" * 32, "SpanID": f"{i + 1:016x}"}, "StartTime": "2026-03-18T17:00:00Z", "EndTime": "2026-03-18T17:00:01Z"}) + "\n"

    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a").write_text(line(0) + line(1))
    plain = traces.read_traces(spark, str(tmp_path / "plain"))
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["name"] for r in plain.collect()) == ["n0", "n1"] and "Union" not in plan
    # a compressed file without a name that tells is unpacked once, not again for each format
    (tmp_path / "plain" / "b").write_bytes(gzip.compress((line(2) + line(3)).encode()) + b"\n")
    both = traces.read_traces(spark, str(tmp_path / "plain"))
    assert sorted(r["name"] for r in both.collect()) == ["n0", "n1", "n2", "n3"]
    assert "MapInArrow" not in both._jdf.queryExecution().optimizedPlan().toString()
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty").write_text("")
    nothing = traces.read_traces(spark, str(tmp_path / "none"))
    assert nothing.columns == plain.columns and nothing.count() == 0
