import gzip
import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import ids, text
from spanloom.operators import enrich, filters, lint
from spanloom.sinks import spans as sink
from spanloom.sources import ci, traces
from spanloom.streaming import ingest

T = "4bf92f3577b34da6a3ce929d0e0e4736"
KV = lambda k, v: {"key": k, "value": v}


def otlp(span_id="b7ad6b7169203331", **more):
    span = {"traceId": T, "spanId": span_id, "name": "HTTP GET", "kind": 2, "startTimeUnixNano": "1705312800000000001", "endTimeUnixNano": 1705312801000000000,
            "attributes": [KV("http.method", {"stringValue": "GET"}), KV("http.status_code", {"intValue": "200"}), KV("list", {"arrayValue": {}})], "status": {"code": 1}, **more}
    return {"resourceSpans": [{"resource": {"attributes": [KV("service.name", {"stringValue": "web"})]}, "scopeSpans": [{"scope": {"name": "lib", "version": "2"}, "spans": [span]}]}]}


STDOUT = {"Name": "CI", "SpanContext": {"TraceID": T, "SpanID": "00f067aa0ba902b7"}, "Parent": {"TraceID": "0" * 32, "SpanID": "0" * 16}, "SpanKind": 1,
          "StartTime": "2024-01-15T10:00:00Z", "EndTime": "2024-01-15T10:05:00.123456789Z", "Attributes": [{"Key": "n", "Value": {"Type": "INT64", "Value": 5}}], "Status": {"Code": "Ok"}}
FLAT = {"Name": "GET /user", "SpanContext": {"TraceID": T, "SpanID": "00f067aa0ba902b8"}, "ParentSpanID": "0" * 16, "StartTime": "2024-01-15T10:00:00Z", "EndTime": "2024-01-15T10:00:01Z",
        "Attributes": {"a": "x", "n": 5, "f": 0.5, "b": True}, "Events": [{"Name": "database_query", "Time": "2024-01-15T10:00:00.5Z", "Attributes": {}}], "Resource": {"service.name": "s"}}
JAEGER = {"data": [{"traceID": T, "processes": {"p1": {"serviceName": "svc", "tags": []}}, "spans": [
    {"traceID": T, "spanID": "00f067aa0ba902b9", "operationName": "op", "references": [{"refType": "CHILD_OF", "traceID": T, "spanID": "00f067aa0ba902b7"}], "startTime": 1000, "duration": 500,
     "tags": [{"key": "otel.status_code", "type": "string", "value": "ERROR"}, {"key": "n", "type": "int64", "value": 3}],
     "logs": [{"timestamp": 1200, "fields": [{"key": "event", "type": "string", "value": "boom"}]}], "processID": "p1"}]}]}
ZIPKIN = [{"traceId": "a3ce929d0e0e4736", "id": "00f067aa0ba902ba", "name": "get", "kind": "CLIENT", "timestamp": 1000, "duration": 5, "localEndpoint": {"serviceName": "front"}, "tags": {"k": "v"}}]
CHROME = {"traceEvents": [
    {"name": "thread_name", "ph": "M", "pid": 1, "tid": 1, "ts": 0, "args": {"name": "main"}},
    {"name": "Parent", "ph": "X", "ts": 1000000, "dur": 5000000, "pid": 1, "tid": 1}, {"name": "Child", "ph": "X", "ts": 2000000, "dur": 1000000, "pid": 1, "tid": 1},
    {"name": "Sibling", "ph": "X", "ts": 1000000, "dur": 2000000, "pid": 1, "tid": 2}, {"name": "short", "ph": "X", "ts": 1000000, "dur": 10, "pid": 1, "tid": 1},
    {"name": "task", "ph": "B", "ts": 7000000, "pid": 1, "tid": 1, "args": {"a": "1"}}, {"name": "task", "ph": "E", "ts": 8000000, "pid": 1, "tid": 1, "args": {"result": "ok"}},
    {"name": "now", "ph": "i", "ts": 2500000, "pid": 1, "tid": 1}]}


def test_otlp_fields(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(otlp()) + "\n\n" + json.dumps(otlp("zz")) + "\n")
    row = traces.read_traces(spark, str(tmp_path), "otlp").collect()
    assert len(row) == 1
    row = row[0]
    assert (row["kind"], row["status_code"], row["start_ns"], row["scope_name"]) == ("SERVER", "OK", 1705312800000000001, "lib")
    assert row["attrs"] == {"http.method": "GET", "http.status_code": "200"} and row["attr_types"] == {"http.status_code": "INT64"}
    assert row["resource"] == {"service.name": "web"} and row["parent_span_id"] is None


def test_pretty_otlp(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(otlp(), indent=2))
    assert traces.read_traces(spark, str(tmp_path), "otlp", pretty=True).count() == 1


def test_stdout_skips_brackets_commas_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text("[\n" + json.dumps(STDOUT) + ",\nnot json\n" + json.dumps({**STDOUT, "Name": "two"}) + "\n]\n")
    rows = traces.read_traces(spark, str(tmp_path), "stdout").orderBy("name").collect()
    assert [r["name"] for r in rows] == ["CI", "two"] and rows[0]["parent_span_id"] is None
    assert rows[0]["end_ns"] % 1_000_000_000 == 123456789 and rows[0]["status_code"] == "OK"


def test_mixed_folder_is_told_apart(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write(json.dumps(otlp()))
    for name, doc in {"b": STDOUT, "c": FLAT, "d": JAEGER, "e": ZIPKIN, "f": CHROME}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    rows = {r["name"]: r for r in traces.read_traces(spark, str(tmp_path)).collect()}
    assert set(rows) == {"HTTP GET", "CI", "GET /user", "op", "get", "Parent", "Child", "Sibling", "task", "now"}
    assert rows["GET /user"]["attr_types"] == {"n": "INT64", "f": "FLOAT64", "b": "BOOL"} and rows["GET /user"]["attrs"]["resource.service.name"] == "s"
    assert rows["GET /user"]["events"][0]["name"] == "database_query"
    assert (rows["op"]["status_code"], rows["op"]["parent_span_id"], rows["op"]["events"][0]["name"]) == ("ERROR", "00f067aa0ba902b7", "boom")
    assert rows["get"]["trace_id"] == "0" * 16 + "a3ce929d0e0e4736" and rows["get"]["kind"] == "CLIENT"
    parent = rows["Parent"]
    assert rows["Child"]["parent_span_id"] == parent["span_id"] and rows["Sibling"]["parent_span_id"] is None
    assert rows["now"]["parent_span_id"] == rows["Child"]["span_id"] and parent["attrs"]["chrome.thread_name"] == "main"
    assert rows["task"]["attrs"]["chrome.args.result"] == "ok" and rows["task"]["end_ns"] - rows["task"]["start_ns"] == 1_000_000_000


def test_written_spans_read_back(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps(otlp()))
    spans = traces.read_traces(spark, str(tmp_path / "in.json"), "otlp")
    sink.write_span_json(spans, str(tmp_path / "out"))
    back = traces.read_traces(spark, str(tmp_path / "out"), "stdout").first()
    first = spans.first()
    for c in ("trace_id", "span_id", "name", "kind", "start_ns", "end_ns", "attrs", "attr_types", "resource", "status_code", "scope_name"):
        assert back[c] == first[c]
    sink.write_span_table(spans, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1


def test_ci_pages(spark, tmp_path):
    page = {"total_count": 1, "workflow_runs": [{"id": 7, "run_attempt": 1, "name": "CI", "created_at": "2026-03-18T17:17:33Z", "updated_at": "bad", "repository": {"owner": {"login": "o"}, "name": "r"}}]}
    (tmp_path / "runs.json").write_text(json.dumps(page))
    run = ci.read_runs(spark, str(tmp_path / "runs.json")).first()
    assert (run["run_id"], run["owner"], run["updated_at"]) == (7, "o", None) and run["created_at"].hour == 17
    (tmp_path / "jobs.json").write_text(json.dumps({"jobs": [{"id": 9, "run_id": 7, "name": "b", "started_at": "2026-03-18T17:18:00Z", "steps": [{"name": "Checkout", "number": 1, "started_at": "2026-03-18T17:18:00Z"}]}]}))
    jobs = ci.read_jobs(spark, str(tmp_path / "jobs.json"))
    step = ci.steps_of(jobs).first()
    assert (step["job_id"], step["number"], step["completed_at"]) == (9, 1, None)


def test_job_logs_keep_file_order(spark, tmp_path):
    (tmp_path / "12.txt").write_text("\n".join(f"line {i}" for i in range(500)))
    rows = ci.read_job_logs(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r["line"] for r in rows] == [f"line {i}" for i in range(500)] and rows[0]["job_id"] == 12 and rows[0]["pos"] == 1


@pytest.mark.parametrize("pattern,value,want", [("*", "x", True), ("ab*", "abc", True), ("*bc", "abc", True), ("*b*", "abc", True), ("abc", "abc", True), ("ab", "abc", False), ("*x*", "abc", False)])
def test_glob(spark, pattern, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(text.glob(F.col("v"), pattern)).first()[0] is want


def test_text_functions(spark):
    df = spark.createDataFrame([("\x1b[31mred\x1b[0m x",)], "v string")
    assert df.select(text.strip_ansi(F.col("v")), text.strip_terminal(F.concat(F.lit("\x1b]8;;u\x07"), "v"))).first()[:] == ("red x", "red x")
    assert df.select(text.format_bytes(F.lit(1536)), text.format_duration_ms(F.lit(90000)), text.truncate(F.lit("a" * 90), 80)).first()[:] == ("1.5 KB", "1.5m", "a" * 77 + "...")
    assert df.select(text.log_deep_link(F.lit("https://x/job/4#step:2:1"), F.lit(77))).first()[0] == "https://x/job/4#step:2:77"
    got = ids.parse_source(F.lit("o/r/actions/runs/5/job/6"))
    assert df.select(*got.values()).first()[:] == ("o", "r", "run", "5")


def test_filters_rules_and_lint(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(otlp()))
    spans = traces.read_traces(spark, str(tmp_path), "otlp")
    for conditions, n in (([("http.status_code", "2*", False)], 1), ([("missing", "*", False)], 0), ([("missing", "*", True)], 1), ([("service.name", "web", True)], 0), ([("otel.status_code", "OK", False)], 1)):
        assert filters.filter_spans(spans, conditions).count() == n
    hint = enrich.enrich(spans, enrich.chain(ci=False)).first()["hints"]
    assert (hint["category"], hint["detail"], hint["service_name"], hint["outcome"]) == ("http", "GET [200]", "web", "success")
    rules = [{"match": {"attributes": {"http.method": "G*"}}, "hints": {"category": "mine", "is_root": True}}]
    (tmp_path / "r.rules").write_text(json.dumps({"enrichers": rules}))
    mine = enrich.enrich(spans, enrich.chain(ci=False, rules=enrich.load_rules(spark, str(tmp_path / "r.rules")))).first()["hints"]
    assert (mine["category"], mine["is_root"], mine["icon"], mine["bar_char"]) == ("mine", True, "● ", "█")
    assert sorted(r["message"] for r in lint.lint(spans).collect()) == ["Deprecated attribute 'http.method' (value: GET)", "Deprecated attribute 'http.status_code' (value: 200)"]


def test_stream_equals_batch_and_drops_repeats(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.json").write_text(json.dumps(otlp()) + "\nbroken\n" + json.dumps(otlp("00f067aa0ba902b7")) + "\n")
    lines = ingest.stream_lines(spark, str(landing))
    for q in ingest.ingest_spans(lines, str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "bad"), available_now=True):
        q.awaitTermination(120)
    batch = traces.read_traces(spark, str(landing), "otlp").drop("seq")
    stored = spark.read.parquet(str(tmp_path / "out"))
    key = lambda df: sorted((r["span_id"], r["start_ns"], str(sorted(r["attrs"].items()))) for r in df.collect())
    assert key(stored) == key(batch) and stored.count() == 2
    assert spark.read.json(str(tmp_path / "bad")).count() == 1
    live = ingest.live_summary(ingest.stream_spans(lines)).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    live.awaitTermination(120)
    assert spark.table("live").first()["total_jobs"] == 2
    (landing / "b.json").write_text(json.dumps(otlp()) + "\n")
    once = ingest.once_per_span(ingest.stream_spans(ingest.stream_lines(spark, str(landing)))).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination(120)
    assert spark.table("once").count() == 2


def test_webhooks(spark):
    docs = [{"repository": {"full_name": "o/r"}, "workflow_run": {"head_sha": "a"}, "workflow_job": {"head_sha": "b"}}, {"repository": {"full_name": "o/r"}, "workflow_job": {"head_sha": "b"}},
            {"repository": {"full_name": "o/r"}, "workflow_run": {"head_sha": ""}, "workflow_job": {"head_sha": "b"}}, {"workflow_run": {"head_sha": "a"}}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("x",)], "text string")
    assert sorted(r["source"] for r in ingest.webhook_sources(df).collect()) == ["o/r/commit/a", "o/r/commit/b"]


def test_equal_chrome_documents_stay_apart(spark):
    """Two documents of the same names, phases and times in two sources: spans of their own, parents of their own."""
    def doc(length):
        return json.dumps({"traceEvents": [
            {"name": "outer", "ph": "X", "ts": 0, "dur": length, "pid": 1, "tid": 1}, {"name": "inner", "ph": "X", "ts": 1000, "dur": 2000, "pid": 1, "tid": 1},
        ]})

    docs = spark.createDataFrame([(1, doc(9000)), (2, doc(5000)), (2, doc(5000))], "source_id int, text string")
    rows = traces.chrome_spans(docs).collect()
    assert len(rows) == 6
    for source in (1, 2):
        own = [r for r in rows if r["source_id"] == source]
        outer = {r["span_id"] for r in own if r["name"] == "outer"}
        assert all(r["parent_span_id"] in outer and r["span_id"] != r["parent_span_id"] for r in own if r["name"] == "inner")
        assert {r["end_ns"] - r["start_ns"] for r in own if r["name"] == "outer"} == {9_000_000 if source == 1 else 5_000_000}
    assert not {r["trace_id"] for r in rows if r["source_id"] == 1} & {r["trace_id"] for r in rows if r["source_id"] == 2}


def scanned(df):
    """Rows that the scans of an executed plan gave out."""
    def walk(plan):
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            yield from walk(plan.executedPlan())
        elif "QueryStage" in plan.nodeName():
            yield from walk(plan.plan())
        elif plan.nodeName().startswith("Scan parquet"):
            yield plan.metrics().apply("numOutputRows").value()
        else:
            for i in range(plan.children().size()):
                yield from walk(plan.children().apply(i))

    df._jdf.collect()
    return sum(walk(df._jdf.queryExecution().executedPlan()))


def test_trace_lookup_skips_row_groups(spark, tmp_path):
    n = 200_000
    spans = spark.range(n).select(
        F.md5((F.col("id") % 5000).cast("string")).alias("trace_id"), F.col("id").cast("string").alias("span_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 5000 * 60).alias("start_time"),
    )
    table, dates = str(tmp_path / "t"), str(tmp_path / "d")
    sink.write_span_table(spans, table)
    sink.write_trace_dates(spans, dates)
    ids = [r[0] for r in spans.where("id IN (7, 4000)").select("trace_id").collect()]
    read = spark.read.parquet(table)
    plain = traces.of_traces(read, ids)
    assert plain.count() == 2 * n // 5000
    assert scanned(plain) < n / 4  # of all rows, those of row groups and pages that may hold the ids
    looked_up = traces.of_traces(read, ids, spark.read.parquet(dates))
    assert looked_up.count() == plain.count()
