"""Registered queries over landed files: the given tables are written as API pages or span files and read back."""

from __future__ import annotations

import gzip
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom import session
from spanloom.operators import ci_spans, enrich, metrics, trends
from spanloom.plans import fixtures as fx
from spanloom.plans.q_ci import facts_of
from spanloom.plans.q_sources import otlp_docs, shown, stdout_docs, want
from spanloom.plans.registry import query
from spanloom.session import ensure_checkpoint_dir
from spanloom.sinks import spans as sink
from spanloom.sources import ci, traces
from spanloom.streaming import assemble, ingest


def landing(spark, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def landed(rows: DataFrame, name: str, **options: str) -> str:
    folder = landing(rows.sparkSession, name)
    rows.select("text").write.options(**options).text(folder)
    return folder


def landed_pages(rows: DataFrame, name: str) -> str:
    """API pages repeat their field names in every row; readers tell the codec by the files' extension."""
    return landed(rows, name, compression="lz4")


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso(col):
    return F.date_format(col, ISO)


def run_pages(spark, folder) -> DataFrame:
    run = F.struct(
        F.col("run_id").alias("id"), "run_attempt", "name", "path", "status", "conclusion", *[iso(F.col(c)).alias(c) for c in ("created_at", "run_started_at", "updated_at")],
        "head_sha", "head_branch", "event", F.struct(F.struct(F.col("owner").alias("login")).alias("owner"), F.col("repo").alias("name")).alias("repository"),
    )
    return fx.runs(spark, folder).select(F.to_json(F.struct(F.lit(1).alias("total_count"), F.array(run).alias("workflow_runs"))).alias("text"))


def job_pages(spark, folder) -> DataFrame:
    """A page for each run, with its jobs of any attempt; times are spelled once the jobs are together."""
    times = ("created_at", "started_at", "completed_at")
    job = F.struct(F.col("job_id").alias("id"), "run_id", "run_attempt", "name", "status", "conclusion", *times, "runner_name", "html_url")
    pages = fx.jobs(spark, folder).groupBy("run_id").agg(F.collect_list(job).alias("jobs"))
    return pages.select(F.to_json(F.struct("jobs"), {"timestampFormat": ISO}).alias("text"))


@query("S9_S10_landed_ci_pages", ["facts"], """
SELECT source_id, run_id, job_id, attempt, name, is_pending, is_failed, start_ms, end_ms, duration_ms FROM facts""")
def landed_ci_pages(spark, folder):
    repositories = fx.sources(spark, folder).select("source_id", "owner", "repo")
    runs = ci.read_runs(spark, landed_pages(run_pages(spark, folder), "runs"), repositories)
    jobs = ci.read_jobs(spark, landed_pages(job_pages(spark, folder), "jobs"))
    facts = ci_spans.job_facts(runs, jobs)
    return facts.select("source_id", "run_id", "job_id", "attempt", "name", "is_pending", "is_failed", "start_ms", "end_ms", "duration_ms")


@query("S11_U3_landed_reviews", ["sources"], """
WITH e AS (SELECT event_id, CAST(user_id % 25 AS INTEGER) AS source_id, event_type, value, epoch_us(ts) // 1000 AS time_ms, 'user' || user_id AS login FROM events)
SELECT source_id, CASE event_type WHEN 'signup' THEN 'review' WHEN 'click' THEN 'comment' ELSE 'merged' END AS type,
  CASE WHEN event_type = 'signup' THEN CASE WHEN value > 25 THEN 'APPROVED' ELSE 'COMMENTED' END END AS state, time_ms, login AS "user",
  CASE WHEN event_type = 'purchase' THEN event_id END AS pr_number, CASE WHEN event_type = 'purchase' THEN 'change ' || event_id END AS pr_title
FROM e WHERE event_type IN ('signup', 'click', 'purchase')""")
def landed_reviews(spark, folder):
    where = fx.sources(spark, folder).select("source_id", "owner", "repo")
    events = fx.table(spark, folder, "events").withColumn("source_id", (F.col("user_id") % 25).cast("int")).join(where, "source_id")
    number = F.col("event_id").cast("string")
    api = F.concat(F.lit("https://api.github.com/repos/"), "owner", F.lit("/"), "repo", F.lit("/pulls/"), number)
    web = F.concat(F.lit("https://github.com/"), "owner", F.lit("/"), "repo", F.lit("/pull/"), number)
    user = F.struct(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("login"))
    review = F.struct(F.col("event_id").alias("id"), F.when(F.col("value") > 25, "APPROVED").otherwise("COMMENTED").alias("state"), iso(F.col("ts")).alias("submitted_at"), user.alias("user"), api.alias("pull_request_url"))
    comment = F.struct(F.col("event_id").alias("id"), iso(F.col("ts")).alias("created_at"), user.alias("user"), web.alias("html_url"))
    pull = F.struct(F.col("event_id").alias("number"), F.concat(F.lit("change "), number).alias("title"), iso(F.col("ts")).alias("merged_at"), user.alias("merged_by"), web.alias("html_url"))

    def page(kind, of, name):
        return landed_pages(events.where(F.col("event_type") == kind).select(F.to_json(of).alias("text")), name)

    reviews = ci.read_reviews(spark, page("signup", review, "reviews"), where)
    comments = ci.read_comments(spark, page("click", comment, "comments"), where)
    pulls = ci.read_pulls(spark, page("purchase", pull, "pulls"), where)
    out = ci_spans.review_events(reviews, comments, pulls)
    return out.select("source_id", "type", "state", F.unix_millis("time").alias("time_ms"), "user", "pr_number", "pr_title")


@query("S12_landed_checks", ["runs"], """
SELECT 'check' AS part, l_orderkey * 10 + l_linenumber AS id, md5(CAST(l_orderkey AS VARCHAR)) AS key, l_returnflag AS name FROM lineitem
UNION ALL SELECT 'artifact', l_orderkey * 10 + l_linenumber, CAST(l_orderkey AS VARCHAR), l_returnflag FROM lineitem
UNION ALL SELECT 'commit', count(*), md5(CAST(l_orderkey AS VARCHAR)), '' FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT 'timing', count(*) * 1000, CAST(l_orderkey AS VARCHAR), 'UBUNTU' FROM lineitem GROUP BY l_orderkey""")
def landed_checks(spark, folder):
    item = fx.table(spark, folder, "lineitem")
    one = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("id"), F.col("l_returnflag").alias("name"))
    sha = F.md5(F.col("l_orderkey").cast("string"))
    grouped = item.groupBy("l_orderkey").agg(F.collect_list(one).alias("rows"), F.count(F.lit(1)).alias("n"))
    checks = landed_pages(grouped.select(F.to_json(F.struct(sha.alias("head_sha"), F.col("rows").alias("check_runs"))).alias("text")), "checks")
    files = landed_pages(grouped.select(F.to_json(F.struct(F.col("l_orderkey").alias("run_id"), F.col("rows").alias("artifacts"))).alias("text")), "artifacts")
    commits = landed_pages(grouped.select(F.to_json(F.struct(sha.alias("sha"), F.struct(F.col("n").alias("total")).alias("stats"))).alias("text")), "commits")
    took = F.create_map(F.lit("UBUNTU"), F.struct((F.col("n") * 1000).alias("total_ms")))
    timing = landed_pages(grouped.select(F.to_json(F.struct(F.col("l_orderkey").alias("run_id"), took.alias("billable"))).alias("text")), "timing")
    none = F.lit("")
    return (
        ci.read_check_runs(spark, checks).select(F.lit("check").alias("part"), F.col("check_run_id").alias("id"), F.col("head_sha").alias("key"), "name")
        .unionByName(ci.read_artifacts(spark, files).select(F.lit("artifact").alias("part"), F.col("artifact_id").alias("id"), F.col("run_id").cast("string").alias("key"), "name"))
        .unionByName(ci.read_commits(spark, commits).select(F.lit("commit").alias("part"), F.col("changed_files").cast("bigint").alias("id"), F.col("head_sha").alias("key"), none.alias("name")))
        .unionByName(ci.read_timing(spark, timing).select(F.lit("timing").alias("part"), F.col("total_ms").alias("id"), F.col("run_id").cast("string").alias("key"), F.col("os").alias("name")))
    )


@query("S8_S14_read_traces_auto", ["spans"], want())
def read_traces_auto(spark, folder):
    """Compressed files of one format, told apart by their content markers."""
    files = landed(otlp_docs(fx.generic_spans(spark, folder)), "otlp", compression="gzip")
    return shown(traces.read_traces(spark, files))


@query("S8_S14_mixed_folder", ["spans"], want())
def mixed_folder(spark, folder):
    """One folder of OTLP and stdout lines, plain and compressed, where no name tells which."""

    def packed(make):
        def run(batches):
            for batch in batches:
                lines = [t + b"\n" for t in batch.column("data").to_pylist()]
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([make(b"".join(lines))], pa.binary())], ["data"])

        return run

    out = landing(spark, "mixed")
    spans = fx.generic_spans(spark, folder)
    part = F.pmod("seq", F.lit(4))
    for i, (docs, make) in enumerate([(otlp_docs, None), (otlp_docs, gzip.compress), (stdout_docs, None), (stdout_docs, zstandard.compress)]):
        rows = docs(spans.where(part == i)).select("text")
        if make is not None:
            rows = rows.select(F.col("text").cast("binary").alias("data")).mapInArrow(packed(make), "data binary").select(F.col("data").cast("string").alias("text"))
        rows.write.option("maxRecordsPerFile", 1 if make else 0).mode("append").text(out)
    return shown(traces.read_traces(spark, out))


@query("R2_live_totals", ["spans"], """
SELECT count(*) AS spans, count(CASE WHEN event_type = 'error' OR (event_type = 'view' AND http_status >= 400 AND end_ns > start_ns) THEN 1 END) AS failures FROM spans""")
def live_totals(spark, folder):
    """Payload files taken in over several triggers; the totals of the last one are those of all spans."""
    files = landed(otlp_docs(fx.generic_spans(spark, folder)).repartition(4), "live")
    spans = ingest.stream_spans(ingest.stream_lines(spark, files, files_per_trigger=1))
    seen = enrich.enrich(spans, enrich.chain(ci=False))
    totals = seen.agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("hints.outcome") == "failure").alias("failures"))
    summary = ingest.live_summary(spans)
    out, parts = landing(spark, "totals"), landing(spark, "summary")

    def keep(path):
        return lambda batch, number: batch.withColumn("trigger", F.lit(number)).write.mode("append").parquet(path)

    for df, path in ((totals, out), (summary, parts)):
        df.writeStream.outputMode("complete").option("checkpointLocation", landing(spark, "progress")).trigger(availableNow=True).foreachBatch(keep(path)).start().awaitTermination()
    last = spark.read.parquet(parts).select(F.max("trigger").alias("trigger"))
    return spark.read.parquet(out).join(last, "trigger").select("spans", "failures")


@query("R1_R4_assembled_traces", ["spans"], """
SELECT s.span_id, p.span_id IS NOT NULL AS parent_known, CASE WHEN p.span_id IS NULL THEN 0 ELSE 1 END AS depth, CAST(count(*) OVER (PARTITION BY s.trace_id) AS INTEGER) AS n_spans
FROM spans s LEFT JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id""")
def assembled_traces(spark, folder):
    """All spans, each delivered twice, as whole traces; a span ten years on moves event time past them."""
    spans = fx.generic_spans(spark, folder)
    far = spans.limit(1).withColumns({"trace_id": F.lit("f" * 32), "start_ns": F.col("start_ns") + 315_360_000 * 1_000_000_000, "end_ns": F.col("end_ns") + 315_360_000 * 1_000_000_000})
    files = landed(otlp_docs(spans.unionByName(spans).unionByName(far)), "assembled")
    out = landing(spark, "whole")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        whole = assemble.assemble_traces(ingest.stream_spans(ingest.stream_lines(spark, files)))
        whole.writeStream.format("parquet").option("path", out).option("checkpointLocation", landing(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.parquet(out).select("span_id", "parent_known", "depth", "n_spans")


@query("R4_repeated_payloads", ["spans"], "SELECT span_id, name FROM spans")
def repeated_payloads(spark, folder):
    """Every payload is delivered twice; each span is taken in once."""
    docs = otlp_docs(fx.generic_spans(spark, folder)).select("text")
    files = landed(docs.unionByName(docs), "twice")
    out = landing(spark, "once")
    once = ingest.once_per_span(ingest.stream_spans(ingest.stream_lines(spark, files)), "3650 days")
    once.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", landing(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("span_id", "name")


@query("R1_streamed_spans", ["spans"], """
SELECT 'span' AS part, span_id AS key, name FROM spans UNION ALL SELECT 'reject', CAST(event_id AS VARCHAR), 'bad ' || event_id FROM events WHERE event_type = 'error'""")
def streamed_spans(spark, folder):
    """Payload files, with lines that are none, taken in by streams that stop when all is read."""
    events = fx.table(spark, folder, "events").where("event_type = 'error'")
    bad = events.select(F.concat(F.lit("bad "), F.col("event_id").cast("string")).alias("text"))
    files = landed(otlp_docs(fx.generic_spans(spark, folder)).select("text").unionByName(bad), "stream")
    out, rejects = landing(spark, "streamed"), landing(spark, "rejects")
    for running in ingest.ingest_spans(ingest.stream_lines(spark, files), out, landing(spark, "progress"), rejects, available_now=True):
        running.awaitTermination()
    taken = spark.read.parquet(out).select(F.lit("span").alias("part"), F.col("span_id").alias("key"), "name")
    lines = spark.read.schema("text string").json(rejects)
    return taken.unionByName(lines.select(F.lit("reject").alias("part"), F.regexp_extract("text", r"(\d+)", 1).alias("key"), F.col("text").alias("name")))


@query("R3_webhook_sources", [], """
SELECT 'o/r' || (user_id % 5) || '/commit/' || md5(CAST(event_id AS VARCHAR)) AS source, event_type AS action FROM events WHERE user_id % 5 > 0""")
def webhook_sources(spark, folder):
    """Every event as a run or job hook; those of one user in five name no repository and are rejected."""
    events = fx.table(spark, folder, "events")
    sha = F.struct(F.md5(F.col("event_id").cast("string")).alias("head_sha"))
    user = F.col("user_id") % 5
    repository = F.struct(F.when(user > 0, F.concat(F.lit("o/r"), user.cast("string"))).alias("full_name"))
    of_run = F.col("event_id") % 2 == 0
    hook = F.struct(F.col("event_type").alias("action"), F.when(of_run, sha).alias("workflow_run"), F.when(~of_run, sha).alias("workflow_job"), repository.alias("repository"))
    return ingest.webhook_sources(events.select(F.to_json(hook).alias("text"))).select("source", "action")


@query("K2_span_json_round_trip", ["spans"], """
SELECT trace_id, span_id, coalesce(parent_span_id, '') AS parent_span_id, name, kind, start_ns, end_ns, status_code FROM spans""")
def span_json_round_trip(spark, folder):
    out = landing(spark, "objects")
    sink.write_span_json(fx.generic_spans(spark, folder), out)
    return shown(traces.read_traces(spark, out, "stdout")).select("trace_id", "span_id", "parent_span_id", "name", "kind", "start_ns", "end_ns", "status_code")


def report_parts(spark, folder) -> dict[str, DataFrame]:
    """Sections of the report; the job facts, which steps and most sections read, are written once."""
    facts = session.landed(facts_of(spark, folder))
    steps = ci_spans.step_facts(facts, fx.steps(spark, folder))
    return metrics.report(fx.runs(spark, folder), facts, steps, fx.sources(spark, folder), fx.review_events(spark, folder), fx.clean_jobs(spark, folder))


@query("K7_written_report", ["facts"], """
WITH s AS (SELECT source_id, count(*) AS jobs FROM facts GROUP BY 1)
SELECT 'run_summary' AS part, source_id, 0 AS n FROM s UNION ALL SELECT 'pending', source_id, count(*) FROM facts WHERE is_pending GROUP BY source_id""")
def written_report(spark, folder):
    """The report's sections written as JSON folders and read back."""
    parts = report_parts(spark, folder)
    out = landing(spark, "report")
    sink.write_report(parts, out)
    runs = spark.read.schema("source_id int").json(f"{out}/run_summary").select(F.lit("run_summary").alias("part"), "source_id", F.lit(0).cast("long").alias("n"))
    names = spark.read.schema("display_name string").json(f"{out}/pending")
    pending = names.select(F.regexp_extract("display_name", r"(\d+)", 1).cast("int").alias("source_id")).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.unionByName(pending.select(F.lit("pending").alias("part"), "source_id", "n"))


@query("K6_trends_document", ["runs"], """
SELECT strftime(make_timestamp(created_ms * 1000), '%Y-%m-%d') AS day, count(*) AS runs,
  round(count(CASE WHEN conclusion = 'success' THEN 1 END) * 100.0 / count(*), 6) AS success_rate FROM runs GROUP BY 1""")
def trends_document(spark, folder):
    """Series of a trend result written as one document of parts and read back."""
    runs = fx.runs(spark, folder)
    parts = {"duration_trend": trends.duration_series(runs), "success_trend": trends.success_series(runs), "summary": trends.trend_summary(runs)}
    out = landing(spark, "trends")
    sink.trends_document(parts).write.json(out)
    back = spark.read.schema("part string, json string").json(out).where("part = 'success_trend'")
    row = back.select(F.from_json("json", "day date, value double, count bigint").alias("r"))
    return row.select(F.date_format("r.day", "yyyy-MM-dd").alias("day"), F.col("r.count").alias("runs"), F.round("r.value", 6).alias("success_rate"))


@query("K2_S16_trace_lookup", ["spans"], "SELECT span_id FROM spans WHERE user_id IN (3, 14)")
def trace_lookup(spark, folder):
    """Two traces out of a table by date, found by the dates on which they have spans."""
    spans = fx.generic_spans(spark, folder)
    table, dates = landing(spark, "table"), landing(spark, "dates")
    sink.write_span_table(spans, table)
    sink.write_trace_dates(spans, dates)
    wanted = spark.range(1).select(F.explode(F.array(F.md5(F.lit("3")), F.md5(F.lit("14")))).alias("trace_id"))
    return traces.of_traces(spark.read.parquet(table), wanted, spark.read.parquet(dates)).select("span_id")


@query("X4_exporters", ["spans"], """
SELECT 'json' AS exporter, span_id FROM spans UNION ALL SELECT 'table', span_id FROM spans UNION ALL SELECT 'own', trace_id || ':' || count(*) FROM spans GROUP BY trace_id""")
def exporters(spark, folder):
    """The same spans through two of the library's exporters and one of the caller's."""
    spans = fx.generic_spans(spark, folder)
    objects, table, own = landing(spark, "objects"), landing(spark, "table"), landing(spark, "own")

    def counts(df):
        df.groupBy("trace_id").count().write.parquet(own)

    sink.export(spans, [lambda df: sink.write_span_json(df, objects), lambda df: sink.write_span_table(df, table), counts])
    read = traces.read_traces(spark, objects, "stdout").select(F.lit("json").alias("exporter"), "span_id")
    read = read.unionByName(spark.read.parquet(table).select(F.lit("table").alias("exporter"), "span_id"))
    return read.unionByName(spark.read.parquet(own).select(F.lit("own").alias("exporter"), F.concat("trace_id", F.lit(":"), F.col("count").cast("string")).alias("span_id")))


@query("X5_own_provider", ["facts"], """
SELECT job_id, name, start_ms, end_ms FROM facts WHERE NOT is_pending""")
def own_provider(spark, folder):
    """Runs and jobs of a caller's own store (Parquet with its own names), given as tables of the provider schema."""
    run_store, job_store = landing(spark, "own-runs"), landing(spark, "own-jobs")
    fx.runs(spark, folder).withColumnRenamed("run_id", "build").write.parquet(run_store)
    fx.jobs(spark, folder).withColumnRenamed("run_id", "build").write.parquet(job_store)
    runs, jobs = (spark.read.parquet(p).withColumnRenamed("build", "run_id") for p in (run_store, job_store))
    facts = ci_spans.job_facts(runs, jobs)
    return facts.where(~F.col("is_pending")).select("job_id", "name", "start_ms", "end_ms")
