import datetime as dt

from pyspark.sql import functions as F

from spanloom.operators import ci_spans, enrich, metrics, tree
from spanloom.schemas import JOBS, REVIEW_EVENTS, RUNS, STEPS, conform


def ts(text):
    return dt.datetime.fromisoformat(f"2026-03-18 {text}")


def one_run(spark, attempt=1, updated="18:50:30", job_attempts=((200, 1, "17:56:49", "18:47:19", "success"),)):
    runs = spark.createDataFrame(
        [(0, 100, attempt, "CI", "completed", "success", ts("17:17:33"), ts("17:47:58"), ts(updated), "o", "r")],
        "source_id int, run_id bigint, run_attempt bigint, name string, status string, conclusion string, created_at timestamp, "
        "run_started_at timestamp, updated_at timestamp, owner string, repo string",
    )
    jobs = spark.createDataFrame(
        [(0, 100, j, a, f"job{j}", "completed", c, ts("17:47:58"), ts(s), ts(e), "runner-1") for j, a, s, e, c in job_attempts],
        "source_id int, run_id bigint, job_id bigint, run_attempt bigint, name string, status string, conclusion string, "
        "created_at timestamp, started_at timestamp, completed_at timestamp, runner_name string",
    )
    return conform(runs, RUNS), conform(jobs, JOBS)


def test_queue_spans(spark):
    runs, jobs = one_run(spark)
    windows = ci_spans.run_windows(runs, ci_spans.attempt_of(jobs, runs))
    queue = ci_spans.run_queue_spans(windows).first()
    assert queue["attrs"]["queue_time_ms"] == str((30 * 60 + 25) * 1000)
    job = ci_spans.job_queue_spans(ci_spans.job_facts(runs, jobs)).first()
    assert (job["attrs"]["queue_time_ms"], job["name"]) == (str((8 * 60 + 51) * 1000), "⏳ Queued")


def test_job_never_outlives_the_effective_end(spark):
    runs, jobs = one_run(spark, updated="18:00:00")
    window = ci_spans.run_windows(runs, ci_spans.attempt_of(jobs, runs)).first()
    assert window["effective_end_ms"] > window["end_ms"]
    fact = ci_spans.job_facts(runs, jobs).first()
    assert fact["end_ms"] == window["effective_end_ms"]


def test_retry_makes_an_attempt_span_and_a_link(spark):
    runs, jobs = one_run(spark, 2, job_attempts=((200, 1, "17:50:00", "17:52:00", "failure"), (201, 1, "17:50:00", "17:53:00", "cancelled"), (202, 2, "18:00:00", "18:01:00", "success")))
    old = ci_spans.attempt_spans(runs, jobs).first()
    assert (old["name"], old["status_code"], old["attrs"]["github.conclusion"]) == ("#1 CI", "ERROR", "failure")
    new = ci_spans.workflow_spans(runs, jobs).first()
    assert new["name"] == "#2 CI" and new["attrs"]["cicd.pipeline.name"] == "CI"
    assert new["links"][0]["trace_id"] == old["trace_id"] and new["links"][0]["span_id"] == old["span_id"]
    parents = {r["attrs"]["github.job_id"]: r["parent_span_id"] for r in ci_spans.job_spans(ci_spans.job_facts(runs, jobs)).collect()}
    assert parents["200"] == old["span_id"] and parents["202"] == new["span_id"]


def test_steps_are_clamped_to_their_job(spark):
    runs, jobs = one_run(spark)
    steps = spark.createDataFrame([(200, 1, "Build", "completed", "success", ts("18:00:00"), ts("18:59:00"))],
                                  "job_id bigint, number int, name string, status string, conclusion string, started_at timestamp, completed_at timestamp")
    fact = ci_spans.step_facts(ci_spans.job_facts(runs, jobs), conform(steps, STEPS)).first()
    assert fact["end_ms"] == fact["job_end_ms"] and fact["category"] == "step_build"
    assert fact["url"] == "https://github.com/o/r/actions/runs/100/job/200#step:1:1"


def test_required_contexts(spark):
    df = spark.createDataFrame([("test (ubuntu, 18)", "CI", ["test"]), ("lint", "CI", ["CI"]), ("lint", "CI", ["other"]), ("x", "CI", None)],
                               "job string, wf string, ctx array<string>")
    got = [r[0] for r in df.select(ci_spans.is_required(F.col("job"), F.col("wf"), F.col("ctx"))).collect()]
    assert got == [True, True, False, True]


def test_bottleneck_and_fallback(spark):
    rows = [(0, 1, "FastJob", 1000, 2000), (0, 2, "SlowJob", 1500, 10000), (0, 3, "MediumJob", 2000, 5000)]
    rows += [(1, 10 + i, f"s{i}", i * 100000, i * 100000 + 1100 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "source_id int, job_id bigint, name string, start_ms bigint, end_ms bigint").withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    found = metrics.bottlenecks(df).orderBy("source_id", F.col("duration_ms").desc()).collect()
    assert [r["name"] for r in found] == ["SlowJob", "MediumJob", "s4", "s3"]


def test_every_child_is_one_level_below_its_parent(spark):
    runs, jobs = one_run(spark, 2, job_attempts=((200, 1, "17:50:00", "17:52:00", "failure"), (202, 2, "18:00:00", "18:01:00", "success")))
    steps = conform(spark.createDataFrame([(202, 1, "Checkout", ts("18:00:00"), ts("18:00:10"))], "job_id bigint, number int, name string, started_at timestamp, completed_at timestamp"), STEPS)
    reviews = conform(spark.createDataFrame([(0, "review", "APPROVED", ts("18:10:00"), "ann", "u")], "source_id int, type string, state string, time timestamp, user string, url string"), REVIEW_EVENTS)
    spans = ci_spans.build_spans(runs, jobs, steps, reviews, spark.createDataFrame([], "source_id int, commit_time timestamp, pushed_at timestamp, changed_files int, additions int, deletions int"))
    twice = spans.unionByName(spans.where(F.col("attrs")["type"] == "marker"))
    flat = tree.flatten(tree.build_span_tree(enrich.enrich(twice)))
    depth = {r["node"]: r["depth"] for r in flat.collect()}
    for r in flat.collect():
        assert r["depth"] == (0 if r["parent"] is None else depth[r["parent"]] + 1)
    assert flat.where(F.col("hints.is_marker")).count() == 1
    assert flat.where("depth = 2").count() == 3
    summary = metrics.summarize(enrich.enrich(spans)).first()
    assert (summary["total_runs"], summary["successful_runs"], summary["retried_runs"]) == (2, 1, 1)


def test_cycles_are_unreachable(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "a", 1), ("c", "d", 1), ("d", "c", 1), ("e", "c", 1)], "node string, parent string, s int")
    assert sorted(r["node"] for r in tree.paths(df, "s").collect()) == ["a", "b"]


def test_deep_chain_paths(spark):
    df = spark.createDataFrame([(str(i), str(i - 1) if i else None, i) for i in range(40)], "node string, parent string, s int")
    longest = tree.paths(df, "s").orderBy(F.size("path").desc()).first()
    assert longest["path"] == list(range(40))


def test_landed_pages_become_spans(spark, tmp_path):
    """Pages of two repositories through the readers to every kind of span and to review events."""
    import json

    from spanloom.sources import ci

    def run(i, repo):
        return {"id": i, "run_attempt": 1, "name": "CI", "status": "completed", "conclusion": "success", "created_at": "2024-01-01T00:00:00Z", "run_started_at": "2024-01-01T00:00:01Z",
                "updated_at": "2024-01-01T00:05:00Z", "head_sha": "abc", "event": "push", "repository": {"owner": {"login": "o"}, "name": repo}}

    def job(i, of):
        return {"id": i, "run_id": of, "run_attempt": 1, "name": "build", "status": "completed", "conclusion": "success", "created_at": "2024-01-01T00:00:02Z", "started_at": "2024-01-01T00:00:03Z",
                "completed_at": "2024-01-01T00:04:00Z", "steps": [{"name": "Run x", "number": n, "status": "completed", "conclusion": "success", "started_at": "2024-01-01T00:00:04Z", "completed_at": "2024-01-01T00:01:00Z"} for n in (1, 2)]}

    (tmp_path / "runs.json").write_text(json.dumps({"workflow_runs": [run(1, "a"), run(2, "b"), run(3, "elsewhere")]}))
    (tmp_path / "jobs.json").write_text(json.dumps({"jobs": [job(10, 1), job(20, 2), job(30, 3)]}))
    (tmp_path / "reviews.json").write_text(json.dumps({"id": 1, "state": "APPROVED", "submitted_at": "2024-01-01T00:00:00Z", "user": {"login": "u"}, "pull_request_url": "https://api.github.com/repos/o/b/pulls/7"}))
    (tmp_path / "pulls.json").write_text(json.dumps({"number": 7, "title": "t", "merged_at": "2024-01-02T00:00:00Z", "merged_by": {"login": "m"}, "html_url": "https://github.com/o/b/pull/7"}))
    sources = spark.createDataFrame([(5, "o", "a"), (6, "o", "b")], "source_id int, owner string, repo string")
    runs, jobs = ci.read_runs(spark, str(tmp_path / "runs.json"), sources), ci.read_jobs(spark, str(tmp_path / "jobs.json"))
    spans = ci_spans.build_spans(runs, jobs, ci.steps_of(jobs))
    kinds = [(r["source_id"], r["name"]) for r in spans.collect()]
    assert {s for s, _ in kinds} == {5, 6} and sum("Run x" in n for _, n in kinds) == 4
    reviews, pulls = ci.read_reviews(spark, str(tmp_path / "reviews.json"), sources), ci.read_pulls(spark, str(tmp_path / "pulls.json"), sources)
    assert reviews.first()["pr_number"] == 7 and pulls.first()["source_id"] == 6
    events = ci_spans.review_events(reviews, reviews.limit(0), pulls)
    assert {(r["source_id"], r["type"]) for r in events.collect()} == {(6, "review"), (6, "merged")}


def test_job_facts_read_jobs_once(spark, tmp_path):
    runs, jobs = one_run(spark, 2, job_attempts=((200, 1, "17:50:00", "17:52:00", "failure"), (201, 1, "17:50:00", "17:53:00", "cancelled"), (202, 2, "18:00:00", "18:59:00", "success")))
    jobs.write.parquet(str(tmp_path / "jobs"))
    facts = ci_spans.job_facts(runs, spark.read.parquet(str(tmp_path / "jobs")))
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    ends = {r["job_id"]: (r["attempt"], r["span_end_ms"] - r["start_ms"]) for r in facts.collect()}
    assert ends == {200: (1, 120_000), 201: (1, 180_000), 202: (2, 59 * 60_000)}


def test_jobs_are_numbered_in_their_attempt(spark):
    from spanloom.functions import codes
    from spanloom.sinks import trace_events

    facts = spark.createDataFrame([(1, 1, 7, "a", None), (1, 1, 5, "b", "x"), (1, 2, 6, "c", "x"), (2, 1, 9, "d", None)], "run_id long, attempt long, job_id long, name string, v string")
    numbered = trace_events.numbered_jobs(facts)
    assert {(r["job_id"], r["name"], r["tid"]) for r in numbered.collect()} == {(5, "b", 10), (7, "a", 11), (6, "c", 10), (9, "d", 10)}
    maps = facts.select("job_id", codes.present([("name", F.col("name")), ("v", F.col("v"))]).alias("m")).collect()
    assert {r["job_id"]: r["m"] for r in maps} == {7: {"name": "a"}, 5: {"name": "b", "v": "x"}, 6: {"name": "c", "v": "x"}, 9: {"name": "d"}}


def test_report_works_out_its_facts_once(spark):
    from spanloom.plans.q_landed import report_parts

    parts = report_parts(spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in f for name in ("pending", "slowest_jobs", "run_summary") for f in parts[name].inputFiles())
    assert parts["summary"].first()["total_jobs"] > 0
