"""CI runs, jobs and steps as spans.

Runs, jobs and steps join on ``run_id`` and ``job_id`` only, so one shuffle key
serves each level.  Wide attribute maps are built last, from already joined rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import codes, ids, text
from spanloom.functions.codes import entry
from spanloom.schemas import conform_spans
from spanloom.session import landed

Known = Sequence[str]
DAY_MS = 24 * 3600 * 1000
STEP_COLUMNS = ["number", "name", "status", "conclusion", "started_at", "completed_at"]
RUN_TIMES = ["run_attempt", "status", "created_at", "run_started_at", "updated_at"]
# Names of queue spans and the mark of required jobs.
QUEUED_RUN = "⏳ Workflow Queued"
QUEUED_JOB = "⏳ Queued"
REQUIRED_MARK = " 🔒"


def _ms(column: str) -> Column:
    return F.unix_millis(column)


def _full(value: Column) -> Column:
    """Null when empty, so that the attribute is left out."""
    return F.nullif(value, F.lit(""))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def run_name(name: Column, run_id: Column) -> Column:
    return F.coalesce(_full(name), F.concat(F.lit("Run "), run_id.cast("string")))


def is_required(job: Column, workflow: Column, contexts: Column) -> Column:
    """Required status check: no contexts means every job; else equal to or prefixed by one.

    A context equal to the workflow name is a prefix of ``workflow / job``.
    """
    full = F.concat(F.coalesce(workflow, F.lit("")), F.lit(" / "), job)
    match = F.exists(contexts, lambda c: full.startswith(c) | job.startswith(c))
    return F.when(F.coalesce(F.size(contexts), F.lit(0)) <= 0, F.lit(True)).otherwise(match)


def required_contexts(protection: DataFrame) -> DataFrame:
    """Contexts and check contexts of a source as one array."""
    none = F.array().cast("array<string>")
    return protection.select(
        "source_id",
        F.array_union(F.coalesce("contexts", none), F.coalesce("checks", none)).alias("required_contexts"),
    )


def attempt_of(jobs: DataFrame, runs: DataFrame, *more: Column | str) -> DataFrame:
    """Jobs with ``attempt``; 0 or null means the run's own attempt.  ``more`` columns of the run are added."""
    own = runs.select("run_id", F.greatest(F.coalesce("run_attempt", F.lit(1)), F.lit(1)).alias("_current"), *more)
    known = F.nullif(F.coalesce("run_attempt", F.lit(0)), F.lit(0))
    return (
        jobs.join(own, "run_id")
        .withColumn("attempt", F.coalesce(known, F.col("_current")))
        .withColumn("is_current", F.col("attempt") == F.col("_current"))
        .drop("_current")
    )


def _run_times(run: dict[str, Column], last: Column, done: Column) -> tuple[Column, Column, Column]:
    """Start, end and effective end (ms) of a run from its ``RUN_TIMES`` and the last ends of its (completed) jobs."""
    retried = (run["run_attempt"] > 1) & run["run_started_at"].isNotNull()
    start = F.when(retried, F.unix_millis(run["run_started_at"])).otherwise(F.unix_millis(run["created_at"]))
    end = F.coalesce(F.unix_millis(run["updated_at"]), start + 1)
    latest = F.greatest(end, done)
    too_long = (run["status"] == "completed") & (latest > start + DAY_MS) & (last > start)
    return start, end, F.when(too_long, last).otherwise(latest)


def run_windows(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Start, end and effective end (ms) of every run's current attempt.

    The effective end covers the completed jobs.  A completed run that seems to
    last over a day ends with its last job instead.
    """
    done = jobs.groupBy("run_id").agg(
        F.max(F.when(F.col("status") == "completed", _ms("completed_at"))).alias("_done"),
        F.max(_ms("completed_at")).alias("_last"),
        F.count(F.lit(1)).alias("job_count"),
    )
    named = {c: F.col(c) for c in RUN_TIMES}
    start, end, effective = _run_times(named, F.col("_last"), F.col("_done"))
    return (
        runs.where(F.col("created_at").isNotNull())
        .join(done, "run_id", "left")
        .withColumn("attempt", F.greatest(F.coalesce("run_attempt", F.lit(1)), F.lit(1)))
        .withColumn("start_ms", start)
        .withColumn("end_ms", end)
        .withColumn("effective_end_ms", effective)
        .withColumn("job_count", F.coalesce("job_count", F.lit(0)))
        .drop("_done", "_last")
    )


def previous_attempts(jobs: DataFrame) -> DataFrame:
    """Window and conclusion of earlier attempts, derived from their jobs."""
    rank = F.when(F.col("conclusion") == "failure", 2).when(F.col("conclusion") == "cancelled", 1).otherwise(0)
    return (
        jobs.where(~F.col("is_current"))
        .groupBy("run_id", "attempt")
        .agg(
            F.min(_ms("created_at")).alias("start_ms"),
            F.max(_ms("completed_at")).alias("end_ms"),
            F.element_at(
                F.array(F.lit("success"), F.lit("cancelled"), F.lit("failure")), F.max(rank) + 1
            ).alias("conclusion"),
        )
        .where(F.col("start_ms").isNotNull())
        .withColumn("end_ms", F.coalesce("end_ms", F.col("start_ms") + 1))
    )


def attempted_jobs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs of known runs with their attempt, what its jobs say of its end and what their run says.

    :func:`build_spans` writes these rows and makes every kind of span from them; a caller whose steps come
    from the same jobs can write them first and hand them in as its jobs.
    """
    # a job belongs to the source of its run, so landed jobs need not carry one
    about = ["source_id", F.col("name").alias("workflow"), "owner", "repo", "head_sha"]
    rows = attempt_of(jobs.drop("source_id"), runs, *about, *[F.col(c).alias(f"_run_{c}") for c in RUN_TIMES])
    # What an attempt's jobs say of its end is added to each of them: jobs are read and brought to their run once.
    whole = Window.partitionBy("run_id", "attempt")
    last = F.max(_ms("completed_at")).over(whole)
    done = F.max(F.when(F.col("status") == "completed", _ms("completed_at"))).over(whole)
    return rows.withColumns({"_last": last, "_done": done, "_first": F.min(_ms("created_at")).over(whole)})


def job_facts(runs: DataFrame, jobs: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """One row per started job of any attempt, clamped to its attempt's end.

    ``end_ms`` is at least one millisecond after ``start_ms``.
    """
    return attempt_facts(attempted_jobs(runs, jobs), contexts)


def attempt_facts(rows: DataFrame, contexts: DataFrame | None, *more: str) -> DataFrame:
    """:func:`job_facts` of :func:`attempted_jobs`; ``more`` columns stay.

    Rows may come without workflow, runner or commit, where a caller has no use for them.
    """
    run = {c: F.col(f"_run_{c}") for c in RUN_TIMES}
    current = F.when(run["created_at"].isNotNull(), _run_times(run, F.col("_last"), F.col("_done"))[2])
    earlier = F.when(F.col("_first").isNotNull(), F.coalesce("_last", F.col("_first") + 1))
    rows = rows.withColumn("bound_ms", F.when(F.col("is_current"), current).otherwise(earlier))
    rows = rows.where(F.col("started_at").isNotNull() & F.col("bound_ms").isNotNull())
    if contexts is None:
        required = F.lit(True)
    else:
        rows = rows.join(contexts, "source_id", "left")
        required = is_required(F.col("name"), F.col("workflow"), F.col("required_contexts"))
    start, bound = _ms("started_at"), F.col("bound_ms")
    end = F.least(F.coalesce(_ms("completed_at"), bound), bound)
    url = F.coalesce(
        _full(F.col("html_url")), ids.job_url(F.col("owner"), F.col("repo"), F.col("run_id"), F.col("job_id"))
    )
    ran = ~_text("conclusion").isin("skipped", "cancelled")
    waited = F.when(F.col("created_at").isNotNull(), F.greatest(start - _ms("created_at"), F.lit(0)))
    pending = (_text("status") != "completed") | F.col("completed_at").isNull()
    told = [c for c in ("workflow", "runner_name", "head_sha") if c in rows.columns]
    return rows.select(
        "source_id", "run_id", "job_id", "attempt", "is_current", "name", "status",
        "conclusion", "owner", "repo", *told, "created_at", "html_url",
        url.alias("url"),
        required.alias("is_required"),
        pending.alias("is_pending"),
        (~pending & ((_text("status") != "completed") | (_text("conclusion") != "success"))).alias("is_failed"),
        start.alias("start_ms"),
        F.greatest(start + 1, end).alias("end_ms"),
        F.least(start, bound).alias("span_start_ms"),
        end.alias("span_end_ms"),
        F.coalesce(waited, F.lit(0)).alias("queue_ms"),
        F.when(ran, F.coalesce(waited, F.lit(0))).otherwise(0).alias("ran_queue_ms"),
        *more,
    ).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def step_facts(facts: DataFrame, steps: DataFrame) -> DataFrame:
    """Steps with both times, clamped to their job's end."""
    own = steps.select("job_id", *STEP_COLUMNS)
    return _clamped_steps(own.where(_has_times()).join(facts.select(*_job_columns()), "job_id"))


def nested_step_facts(facts: DataFrame, *more: str) -> DataFrame:
    """:func:`step_facts` of the steps that each job has in its array ``steps``: they need not be brought to it.

    ``more`` columns of the job stay.
    """
    rows = facts.select(*_job_columns(), *more, F.explode("steps").alias("_step"))
    step = F.col("_step")
    return _clamped_steps(rows.select("*", *[step[c].alias(c) for c in STEP_COLUMNS]).drop("_step").where(_has_times()), *more)


def _has_times() -> Column:
    return F.col("started_at").isNotNull() & F.col("completed_at").isNotNull()


def _job_columns() -> list[Column | str]:
    return [
        "job_id", "source_id", "run_id", "attempt", F.col("name").alias("job_name"),
        F.col("end_ms").alias("job_end_ms"), F.col("url").alias("job_url"),
    ]


def _clamped_steps(rows: DataFrame, *more: str) -> DataFrame:
    bound = F.col("job_end_ms")
    start = F.least(_ms("started_at"), bound)
    end = F.least(_ms("completed_at"), bound)
    return rows.select(
        "source_id", "run_id", "job_id", "attempt", "number", "name", "status", "conclusion", "job_name",
        F.concat("job_url", F.lit("#step:"), F.col("number").cast("string"), F.lit(":1")).alias("url"),
        text.step_category(F.col("name")).alias("category"),
        start.alias("start_ms"),
        F.greatest(start + 1, end).alias("end_ms"),
        end.alias("span_end_ms"),
        "job_end_ms", *more,
    ).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


# --- spans ----------------------------------------------------------------------


def _span(
    rows: DataFrame, entries: list[codes.Entry], more: list[Column] | None = None, known: Known = (), **cols: Column
) -> DataFrame:
    """Span rows from entries with fixed keys plus maps whose keys vary by row.

    The values of the ``known`` attributes stand beside the map as well (see :func:`codes.attribute`).
    """
    attrs = codes.attr_map(entries)
    if more:
        attrs = F.map_concat(attrs, *more)
    maps = {"attrs": attrs, "attr_types": codes.type_map(entries)}
    fixed = {key: value for key, value, _ in entries}
    none = F.lit(None).cast("string")
    beside = {
        codes.known_column(key): F.coalesce(*[m[key] for m in reversed(more or [])], fixed.get(key, none)) for key in known
    }
    return conform_spans(rows.withColumns({**maps, **cols, **beside}), *beside)


def _ns(ms: Column) -> Column:
    return ms * 1000000


def _retry_links(run_id: Column, attempt: Column) -> Column:
    """Link to the attempt before this one; its ids need no lookup."""
    before = attempt - 1
    link = F.struct(
        ids.trace_id(run_id, before).alias("trace_id"),
        ids.previous_attempt_span_id(run_id, before).alias("span_id"),
        F.create_map(
            F.lit("link.type"), F.lit("retry"), F.lit("github.previous_attempt"), before.cast("string")
        ).alias("attrs"),
    )
    return F.when(attempt > 1, F.array(link))


def billable_by_run(timing: DataFrame, runs: DataFrame) -> DataFrame:
    """Map of ``billable.<os>_ms`` per completed run from (run_id, os, total_ms) rows; a run that goes on has none yet."""
    key = F.concat(F.lit("billable."), F.lower("os"), F.lit("_ms"))
    done = runs.where(F.col("status") == "completed").select("run_id")
    return (
        timing.where(F.col("total_ms") > 0).join(done, "run_id", "left_semi")
        .groupBy("run_id", key.alias("key")).agg(F.sum("total_ms").cast("string").alias("value"))
        .groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("billable"))
    )


def artifacts_by_run(artifacts: DataFrame) -> DataFrame:
    """Unexpired artifacts of a run: count, names, sizes and per-artifact entries."""
    live = artifacts.where(~F.coalesce("expired", F.lit(False)))
    return live.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("artifact_id", "name", "size_in_bytes"))).alias("artifacts"),
        F.sum("size_in_bytes").alias("artifact_bytes"),
    )


def _artifact_attrs(owner: Column, repo: Column, run_id: Column) -> Column:
    """Totals and one name, size and URL per artifact, numbered from 0."""
    base = F.concat(ids.run_url(owner, repo, run_id), F.lit("/artifacts/"))

    def each(a: Column, i: Column) -> Column:
        key = F.concat(F.lit("cicd.pipeline.artifact."), i.cast("string"))
        return F.array(
            pair(F.concat(key, F.lit(".name")), a["name"]),
            pair(F.concat(key, F.lit(".size")), text.format_bytes(a["size_in_bytes"])),
            pair(F.concat(key, F.lit(".url")), F.concat(base, a["artifact_id"].cast("string"))),
        )

    def pair(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"))

    totals = codes.attr_map([
        entry("cicd.pipeline.artifacts.count", F.size("artifacts")),
        entry("cicd.pipeline.artifacts.names", F.array_join(F.transform("artifacts", lambda a: a["name"]), ", ")),
        entry("cicd.pipeline.artifacts.size", text.format_bytes(F.col("artifact_bytes"))),
        entry("cicd.pipeline.artifacts.size_bytes", F.col("artifact_bytes")),
    ])
    numbered = F.map_from_entries(F.flatten(F.transform("artifacts", each)))
    return F.when(F.size("artifacts") > 0, F.map_concat(numbered, totals))


def workflow_spans(
    runs: DataFrame, jobs: DataFrame, sources: DataFrame | None = None,
    timing: DataFrame | None = None, artifacts: DataFrame | None = None,
) -> DataFrame:
    """The root span of every run's current attempt.

    The span ends at ``updated_at``; jobs are clamped to the effective end, which
    :func:`run_windows` keeps apart.
    """
    windows = run_windows(runs, attempt_of(jobs, runs).where(F.col("is_current")))
    return _window_spans(windows, runs, sources, timing, artifacts)


def _window_spans(
    rows: DataFrame, runs: DataFrame, sources: DataFrame | None, timing: DataFrame | None,
    artifacts: DataFrame | None, known: Known = (),
) -> DataFrame:
    """:func:`workflow_spans` of :func:`run_windows`."""
    changed = ["changed_files", "additions", "deletions"]
    if sources is not None:
        rows = rows.join(sources.select("source_id", *changed), "source_id", "left")
    else:
        rows = rows.withColumns({c: F.lit(0) for c in changed})
    none = F.create_map().cast("map<string,string>")
    more = []
    if timing is not None:
        rows = rows.join(billable_by_run(timing, runs), "run_id", "left")
        more.append(F.coalesce("billable", none))
    if artifacts is not None:
        rows = rows.join(artifacts_by_run(artifacts), "run_id", "left")
        more.append(F.coalesce(_artifact_attrs(F.col("owner"), F.col("repo"), F.col("run_id")), none))
    repo = F.concat("owner", F.lit("/"), "repo")
    name = run_name(F.col("name"), F.col("run_id"))
    retried = F.col("attempt") > 1
    attempt_path = F.concat(F.lit("/attempts/"), F.col("attempt").cast("string"))
    url = F.concat(
        ids.run_url(F.col("owner"), F.col("repo"), F.col("run_id")), F.when(retried, attempt_path).otherwise("")
    )
    some = F.col("changed_files") > 0
    entries = [
        entry("cicd.pipeline.name", name),
        entry("cicd.pipeline.run.id", F.col("run_id")),
        entry("cicd.pipeline.run.url.full", url),
        entry("vcs.repository.url.full", F.concat(F.lit("https://github.com/"), repo)),
        entry("type", "workflow"),
        entry("github.run_id", F.col("run_id"), "INT64"),
        entry("github.status", _text("status")),
        entry("github.conclusion", _text("conclusion")),
        entry("github.repo", repo),
        entry("github.url", url),
        entry("github.url_index", F.col("source_id"), "INT64"),
        entry("cicd.pipeline.definition", _text("path")),
        entry("vcs.revision", _full(F.col("head_sha"))),
        entry("vcs.ref.head.name", _full(F.col("head_branch"))),
        entry("cicd.pipeline.run.result", codes.conclusion_to_result(_text("conclusion"))),
        entry("github.run_attempt", F.when(retried, F.col("attempt")), "INT64"),
        entry("vcs.changes.count", F.when(some, F.col("changed_files"))),
        entry("vcs.changes.additions", F.when(some, F.col("additions"))),
        entry("vcs.changes.deletions", F.when(some, F.col("deletions"))),
    ]
    prefix = F.when(retried, F.concat(F.lit("#"), F.col("attempt").cast("string"), F.lit(" "))).otherwise("")
    status = codes.conclusion_to_status(_text("conclusion"))
    return _span(
        rows, entries, more, known,
        trace_id=ids.trace_id(F.col("run_id"), F.col("attempt")),
        span_id=ids.span_id_int(F.col("run_id")),
        links=_retry_links(F.col("run_id"), F.col("attempt")),
        name=F.concat(prefix, name),
        start_ns=_ns(F.col("start_ms")), end_ns=_ns(F.col("end_ms")),
        status_code=status["code"], status_message=status["message"],
    )


def attempt_spans(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """A root span for every earlier attempt of a retried run."""
    return _earlier_spans(runs, previous_attempts(attempt_of(jobs, runs)))


def _earlier_spans(runs: DataFrame, attempts: DataFrame, known: Known = ()) -> DataFrame:
    """:func:`attempt_spans` of :func:`previous_attempts`."""
    about = runs.select("run_id", "source_id", F.col("name").alias("_run"), "owner", "repo", "path")
    rows = attempts.join(about, "run_id")
    repo = F.concat("owner", F.lit("/"), "repo")
    attempt = F.col("attempt").cast("string")
    url = F.concat(ids.run_url(F.col("owner"), F.col("repo"), F.col("run_id")), F.lit("/attempts/"), attempt)
    name = F.concat(F.lit("#"), attempt, F.lit(" "), run_name(F.col("_run"), F.col("run_id")))
    entries = [
        entry("cicd.pipeline.name", name),
        entry("cicd.pipeline.run.id", F.col("run_id")),
        entry("cicd.pipeline.run.url.full", url),
        entry("vcs.repository.url.full", F.concat(F.lit("https://github.com/"), repo)),
        entry("type", "workflow"),
        entry("github.run_id", F.col("run_id"), "INT64"),
        entry("github.status", "completed"),
        entry("github.conclusion", F.col("conclusion")),
        entry("github.repo", repo),
        entry("github.url", url),
        entry("github.url_index", F.col("source_id"), "INT64"),
        entry("github.run_attempt", F.col("attempt"), "INT64"),
        entry("cicd.pipeline.run.result", codes.conclusion_to_result(F.col("conclusion"))),
        entry("cicd.pipeline.definition", _text("path")),
    ]
    status = codes.conclusion_to_status(F.col("conclusion"))
    return _span(
        rows, entries, known=known,
        trace_id=ids.trace_id(F.col("run_id"), F.col("attempt")),
        span_id=ids.previous_attempt_span_id(F.col("run_id"), F.col("attempt")),
        links=_retry_links(F.col("run_id"), F.col("attempt")),
        name=name, start_ns=_ns(F.col("start_ms")), end_ns=_ns(F.col("end_ms")),
        status_code=status["code"], status_message=status["message"],
    )


def job_annotations(check_runs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Span events per (commit, job name) from the annotations of failed checks."""
    title = F.coalesce(_full(F.col("title")), F.col("message"))
    event = F.struct(
        title.alias("name"),
        F.lit(None).cast("bigint").alias("time_ns"),
        F.create_map(
            F.lit("annotation.path"), F.col("path"),
            F.lit("annotation.line"), F.col("start_line").cast("string"),
            F.lit("annotation.level"), F.col("annotation_level"),
            F.lit("annotation.message"), F.col("message"),
        ).alias("attrs"),
    )
    failed = check_runs.where(F.col("conclusion") == "failure").select("check_run_id", "head_sha", "name")
    # Maps cannot be sorted, so the order key stays outside the event.
    at = F.struct(F.col("check_run_id").alias("c"), F.col("start_line").alias("l"), F.col("message").alias("m"))
    rows = failed.join(annotations, "check_run_id").select(
        "head_sha", "name", at.alias("at"), title.alias("title"), event.alias("event")
    )
    packed = rows.groupBy("head_sha", "name").agg(
        F.collect_list(F.struct("at", F.to_json(F.struct("event")).alias("e"))).alias("list")
    )
    kind = "event struct<name:string,time_ns:bigint,attrs:map<string,string>>"
    return packed.select(
        "head_sha", "name",
        F.transform(F.array_sort("list"), lambda x: F.from_json(x["e"], kind)["event"]).alias("events"),
    )


def job_spans(facts: DataFrame, annotations: DataFrame | None = None, known: Known = ()) -> DataFrame:
    """Spans of :func:`job_facts`; annotations become span events."""
    rows = facts
    if annotations is not None:
        rows = rows.join(annotations, ["head_sha", "name"], "left")
    current = F.col("is_current")
    entries = [
        entry("cicd.pipeline.task.name", F.col("name")),
        entry("cicd.pipeline.task.type", "build"),
        entry("cicd.pipeline.task.run.id", F.col("job_id")),
        entry("cicd.pipeline.task.run.url.full", F.col("url")),
        entry("cicd.pipeline.task.run.result", codes.conclusion_to_result(_text("conclusion"))),
        entry("type", "job"),
        entry("github.job_id", F.col("job_id"), "INT64"),
        entry("github.status", _text("status")),
        entry("github.conclusion", _text("conclusion")),
        entry("github.runner_name", _text("runner_name")),
        entry("github.url", F.col("url")),
        entry("github.is_required", F.col("is_required"), "BOOL"),
        entry("k8s.pod.name", _full(F.col("runner_name"))),
        entry("queue_time_ms", F.when(F.col("queue_ms") > 0, F.col("queue_ms")), "INT64"),
    ]
    parent = F.when(current, ids.span_id_int(F.col("run_id"))).otherwise(
        ids.previous_attempt_span_id(F.col("run_id"), F.col("attempt"))
    )
    status = codes.conclusion_to_status(_text("conclusion"))
    mark = F.when(F.col("is_required"), REQUIRED_MARK).otherwise("")
    return _span(
        rows, entries, known=known,
        trace_id=ids.trace_id(F.col("run_id"), F.col("attempt")),
        span_id=ids.span_id_int(F.col("job_id")), parent_span_id=parent, name=F.concat("name", mark),
        start_ns=_ns(F.col("span_start_ms")), end_ns=_ns(F.col("span_end_ms")),
        status_code=status["code"], status_message=status["message"],
    )


def step_span_id(job_id: Column, name: Column) -> Column:
    return ids.span_id_text(ids.seed(job_id, name))


def step_spans(facts: DataFrame, known: Known = ()) -> DataFrame:
    entries = [
        entry("cicd.pipeline.task.name", F.col("name")),
        entry("cicd.pipeline.task.type", "build"),
        entry("cicd.pipeline.task.run.result", codes.conclusion_to_result(_text("conclusion"))),
        entry("cicd.pipeline.task.run.url.full", F.col("url")),
        entry("type", "step"),
        entry("github.step_number", F.col("number"), "INT64"),
        entry("github.status", _text("status")),
        entry("github.conclusion", _text("conclusion")),
        entry("github.url", F.col("url")),
    ]
    status = codes.conclusion_to_status(_text("conclusion"))
    return _span(
        facts, entries, known=known,
        trace_id=ids.trace_id(F.col("run_id"), F.col("attempt")),
        span_id=step_span_id(F.col("job_id"), F.col("name")),
        parent_span_id=ids.span_id_int(F.col("job_id")),
        start_ns=_ns(F.col("start_ms")), end_ns=_ns(F.col("span_end_ms")),
        status_code=status["code"], status_message=status["message"],
    )


def run_queue_spans(windows: DataFrame, known: Known = ()) -> DataFrame:
    """Time between a run's start and ``run_started_at`` (output of run_windows)."""
    begun = _ms("run_started_at")
    rows = windows.where(begun > F.col("start_ms"))
    entries = [
        entry("type", "workflow_queued"),
        entry("queue_time_ms", begun - F.col("start_ms"), "INT64"),
    ]
    return _span(
        rows, entries, known=known,
        trace_id=ids.trace_id(F.col("run_id"), F.col("attempt")),
        span_id=ids.span_id_text(ids.seed("wf-queued", F.col("run_id"))),
        parent_span_id=ids.span_id_int(F.col("run_id")), name=F.lit(QUEUED_RUN),
        start_ns=_ns(F.col("start_ms")), end_ns=_ns(begun),
    )


def job_queue_spans(facts: DataFrame, known: Known = ()) -> DataFrame:
    """Time between a job's creation and start, for jobs that ran."""
    rows = facts.where(F.col("ran_queue_ms") > 0)
    entries = [
        entry("type", "queued"),
        entry("github.job_name", F.col("name")),
        entry("queue_time_ms", F.col("ran_queue_ms"), "INT64"),
    ]
    return _span(
        rows, entries, known=known,
        trace_id=ids.trace_id(F.col("run_id"), F.col("attempt")),
        span_id=ids.span_id_text(ids.seed("queued", F.col("job_id"))),
        parent_span_id=ids.span_id_int(F.col("job_id")), name=F.lit(QUEUED_JOB),
        start_ns=_ns(F.unix_millis("created_at")), end_ns=_ns(F.col("start_ms")),
    )


def event_time_text(time: Column) -> Column:
    """RFC3339 text of an event time, whole seconds unless a fraction is present."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    millis = F.unix_millis(time) % 1000
    return F.concat(whole, F.when(millis == 0, "Z").otherwise(F.concat(F.lit("."), F.lpad(millis.cast("string"), 3, "0"), F.lit("Z"))))


def marker_spans(reviews: DataFrame, sources: DataFrame | None = None, known: Known = ()) -> DataFrame:
    """Reviews, comments and merges, and commit and push times, as 1 ms spans."""
    kind, state = F.col("type"), _text("state")
    label = (
        F.when(kind == "review", F.concat(F.lit("Review: "), state))
        .when(kind == "comment", F.lit("Comment"))
        .when(
            (kind == "merged") & (F.coalesce("pr_number", F.lit(0)) != 0),
            F.concat(F.lit("Merged PR #"), F.col("pr_number").cast("string"), F.lit(": "), _text("pr_title")),
        )
        .when(kind == "merged", F.lit("Merged"))
        .otherwise(F.lit("Marker"))
    )
    event_type = F.when(kind == "review", F.lower(state)).otherwise(kind)
    when = event_time_text(F.col("time"))
    user, url = _text("user"), _text("url")
    entries = [
        entry("type", "marker"),
        entry("github.event_type", event_type),
        entry("github.user", user),
        entry("github.url", url),
        entry("github.event_id", F.concat_ws("-", kind, when, user, url)),
        entry("github.event_time", when),
        entry("github.url_index", F.col("source_id"), "INT64"),
    ]
    at = F.unix_micros("time") * 1000
    markers = _span(
        reviews.where(F.col("time").isNotNull()), entries, known=known,
        span_id=ids.span_id_text(F.concat_ws("-", F.lit("marker"), kind, when, user)),
        name=label, start_ns=at, end_ns=at + 1000000,
    )
    if sources is None:
        return markers
    parts = [markers]
    for column, kind_name, title, prefix in (
        ("commit_time", "commit", "Commit Created", "commit"),
        ("pushed_at", "push", "Commit Pushed", "push"),
    ):
        at = _ms(column)
        parts.append(_span(
            sources.where(F.col(column).isNotNull()),
            [
                entry("type", "marker"), entry("github.event_type", kind_name),
                entry("github.url_index", F.col("source_id"), "INT64"),
            ],
            known=known, span_id=ids.span_id_text(ids.seed(prefix, at)), name=F.lit(title),
            start_ns=_ns(at), end_ns=_ns(at) + 1000000,
        ))
    return reduce(DataFrame.unionByName, parts)


def source_events(reviews: DataFrame, sources: DataFrame) -> DataFrame:
    """Reviews, comments, merges, commit and push as span events, one row each.

    Every workflow span of a source carries the same events.  They stay rows
    keyed by ``source_id``: copying a busy source's events into each of its runs
    would multiply the two.
    """
    kind = F.col("type")
    reviewed = reviews.where(F.col("time").isNotNull() & kind.isin("review", "comment", "merged")).select(
        "source_id",
        F.when(kind == "review", "github.review").when(kind == "comment", "github.comment")
        .otherwise("github.merge").alias("name"),
        (F.unix_micros("time") * 1000).alias("time_ns"),
        codes.attr_map([
            entry("github.review.state", F.when(kind == "review", _text("state"))),
            entry("github.user", _text("user")),
            entry("github.url", _text("url")),
            entry("github.pr_number", F.nullif(F.col("pr_number"), F.lit(0)), "INT64"),
            entry("github.pr_title", F.when(F.coalesce("pr_number", F.lit(0)) != 0, F.col("pr_title"))),
        ]).alias("attrs"),
    )
    parts = [reviewed]
    for column, name in (("commit_time", "github.commit"), ("pushed_at", "github.push")):
        parts.append(sources.where(F.col(column).isNotNull()).select(
            "source_id", F.lit(name).alias("name"), _ns(_ms(column)).alias("time_ns"),
            F.create_map(F.lit("vcs.revision"), F.col("head_sha")).alias("attrs"),
        ))
    return reduce(DataFrame.unionByName, parts)


def attach_events(workflows: DataFrame, events: DataFrame) -> DataFrame:
    """Workflow spans of chosen sources with their source's events as an array."""
    packed = events.groupBy("source_id").agg(
        F.collect_list(F.struct("name", "time_ns", "attrs")).alias("_events")
    )
    joined = workflows.join(packed, "source_id", "left")
    return joined.withColumn("events", F.coalesce("_events", "events")).drop("_events")


def union_spans(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def build_spans(
    runs: DataFrame, jobs: DataFrame, steps: DataFrame | None = None, reviews: DataFrame | None = None,
    sources: DataFrame | None = None, contexts: DataFrame | None = None,
    timing: DataFrame | None = None, artifacts: DataFrame | None = None,
    annotations: DataFrame | None = None, known: Known = (),
) -> DataFrame:
    """Every span of a CI data set; ``jobs`` may be :func:`attempted_jobs` already.

    Without ``steps`` each job has its own in an array ``steps`` of structs, with times, not texts of them.
    The attributes in ``known`` can be looked up and filtered without their maps (see :func:`codes.attribute`).
    """
    rows = jobs if "_last" in jobs.columns else landed(attempted_jobs(runs, jobs))
    facts = attempt_facts(rows, contexts, *(["steps"] if steps is None else []))
    windows = run_windows(runs, rows.where(F.col("is_current")))
    parts = [
        _window_spans(windows, runs, sources, timing, artifacts, known),
        _earlier_spans(runs, previous_attempts(rows), known),
        job_spans(facts, annotations, known),
        step_spans(nested_step_facts(facts) if steps is None else step_facts(facts, steps), known),
        run_queue_spans(windows, known),
        job_queue_spans(facts, known),
    ]
    if reviews is not None:
        parts.append(marker_spans(reviews, sources, known))
    return union_spans(*parts)


def with_commit_context(commits: DataFrame, associated: DataFrame, repositories: DataFrame) -> DataFrame:
    """Commit sources with their first associated pull request, else the default branch.

    ``associated`` rows carry ``position``, the list order of the pull requests.
    """
    first = associated.groupBy("source_id").agg(
        F.min_by(
            F.struct("pr_number", "base_ref", "merged_at", "html_url"), F.struct("position", "pr_number")
        ).alias("pr")
    )
    branch = F.coalesce(_full(F.col("pr.base_ref")), _full(F.col("default_branch")), F.lit("unknown"))
    return (
        commits.join(first, "source_id", "left")
        .join(repositories.select("owner", "repo", "default_branch"), ["owner", "repo"], "left")
        .select(
            *[c for c in commits.columns if c not in ("branch", "merged_at")], branch.alias("branch"),
            F.col("pr.pr_number").alias("pr_number"), F.col("pr.merged_at").alias("merged_at"),
        )
    )


def commit_times(commits: DataFrame, runs: DataFrame) -> DataFrame:
    """Commit time (committer, else author date) and push time (first run of the commit)."""
    pushed = runs.groupBy("source_id").agg(F.min("created_at").alias("pushed_at"))
    when = F.coalesce("committer_date", "author_date")
    return (
        commits.withColumn("commit_time", when).drop("pushed_at").join(pushed, "source_id", "left")
    )


def review_events(reviews: DataFrame, comments: DataFrame, merges: DataFrame) -> DataFrame:
    """Three shapes to one: reviews, comments and merged pull requests."""
    return (
        reviews.select(
            "source_id", F.lit("review").alias("type"), "state", F.col("submitted_at").alias("time"),
            "user", "url",
        )
        .unionByName(
            comments.select(
                "source_id", F.lit("comment").alias("type"), F.col("submitted_at").alias("time"), "user", "url"
            ),
            allowMissingColumns=True,
        )
        .unionByName(
            merges.where(F.col("merged_at").isNotNull()).select(
                "source_id", F.lit("merged").alias("type"), F.col("merged_at").alias("time"), "user", "url",
                "pr_number", "pr_title",
            ),
            allowMissingColumns=True,
        )
    )


def adopt_orphans(artifact_spans: DataFrame, workflows: DataFrame) -> DataFrame:
    """Artifact spans whose parent is not in the same artifact go under their run's span.

    ``artifact_spans`` carry ``run_id``, ``artifact_id``, ``artifact_name`` and ``download_url``;
    ``workflows`` are (run_id, workflow_trace_id, workflow_span_id, source_id).
    """
    known = artifact_spans.select(
        "artifact_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_known")
    ).distinct()
    extra = F.map_from_arrays(
        F.array(F.lit("github.url_index"), F.lit("github.artifact_name"), F.lit("github.artifact.download_url")),
        F.array(F.col("_source").cast("string"), F.col("artifact_name"), F.col("download_url")),
    )
    roots = workflows.select("run_id", "workflow_span_id", F.col("source_id").alias("_source"))
    kept = F.map_filter(
        "attrs",
        lambda k, _: ~k.isin("github.url_index", "github.artifact_name", "github.artifact.download_url"),
    )
    return (
        artifact_spans.join(known, ["artifact_id", "parent_span_id"], "left")
        .join(roots, "run_id")
        .withColumn(
            "parent_span_id", F.when(F.col("_known"), F.col("parent_span_id")).otherwise(F.col("workflow_span_id"))
        )
        .withColumn("attrs", F.map_concat(kept, extra))
        .withColumn("source_id", F.col("_source"))
        .drop("_known", "_source", "workflow_span_id")
    )
