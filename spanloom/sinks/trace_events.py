"""Chrome-style trace events of a CI data set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import codes
from spanloom.operators import ci_spans, metrics
from spanloom.operators.ordered import global_rank
from spanloom.session import landed

# Process and threads of counters and review events, thread numbering.
METRICS_PROCESS, COUNTER_THREAD, REVIEW_THREAD = 999, 1, 2
WORKFLOW_THREAD, FIRST_JOB_THREAD = 1, 10
FIRST_PROCESS = 1000
# Colours of sources in turn, names of the fixed tracks with their places.
COLORS = ["#4285f4", "#ea4335", "#fbbc04", "#34a853", "#ff6d01", "#46bdc6", "#7b1fa2", "#d81b60"]
OVERVIEW = "📋 Workflow Overview"
FIXED_PROCESS = "GitHub Events"
FIXED_THREADS = [(COUNTER_THREAD, "Job Concurrency", 0), (REVIEW_THREAD, "GitHub PR Events", 1)]

COLUMNS = ["source_id", "name", "ph", "ts", "dur", "pid", "tid", "cat", "s", "args"]


def _args(*pairs: tuple[str, Column]) -> Column:
    return codes.present([(k, v.cast("string")) for k, v in pairs])


def _mark(name: str, thread: int, *args: tuple[str, Column]) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(thread).cast("bigint").alias("tid"), _args(*args).alias("args"))


def _thread_marks(thread: int, name: str, place: int) -> list[Column]:
    return [_mark("thread_name", thread, ("name", F.lit(name))), _mark("thread_sort_index", thread, ("sort_index", F.lit(place)))]


def _naming(rows: DataFrame, pid: Column, marks: list[Column]) -> DataFrame:
    """M rows that name a process, its threads and their places."""
    named = rows.withColumn("_mark", F.explode(F.array(*marks)))
    return _event(named, name=F.col("_mark.name"), ph=F.lit("M"), ts=F.lit(0).cast("bigint"), pid=pid, tid=F.col("_mark.tid"), args=F.col("_mark.args"))


def _event(rows: DataFrame, **cols: Column) -> DataFrame:
    given = {"dur": F.lit(0).cast("bigint"), "cat": F.lit(""), "s": F.lit(""), **cols}
    return rows.select("source_id", *[given[c].alias(c) for c in COLUMNS if c != "source_id"])


def numbered_runs(runs: DataFrame) -> DataFrame:
    """``pid`` of every run: its place among the runs of all sources, by source and time.

    Numbers begin above the fixed processes and never meet, however many runs a source has.
    """
    ranked = global_rank(runs.select("source_id", "created_at", "run_id"), [], ["source_id", "created_at", "run_id"])
    return ranked.select("run_id", (F.col("rn") + FIRST_PROCESS).cast("bigint").alias("pid"))


def numbered_jobs(facts: DataFrame) -> DataFrame:
    """Facts with ``tid``, the job's place in its run and attempt; facts lie together by run already."""
    place = F.row_number().over(Window.partitionBy("run_id", "attempt").orderBy("job_id"))
    return facts.withColumn("tid", (place - 1 + FIRST_JOB_THREAD).cast("bigint"))


def _placed(rows: DataFrame, sources: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows with their source's earliest time and what it is called."""
    zero = bounds.select("source_id", F.col("earliest_ms").alias("_zero"))
    return rows.join(zero, "source_id").join(sources.select("source_id", "display_url", "type", "identifier"), "source_id")


def _number() -> Column:
    return F.concat(F.lit(" ["), (F.col("source_id") + 1).cast("string"), F.lit("]"))


def _label() -> Column:
    return F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("Run "), F.col("run_id").cast("string")))


def _origin() -> tuple[tuple[str, Column], ...]:
    return ("source_url", F.col("display_url")), ("source_type", F.col("type")), ("source_identifier", F.col("identifier"))


def process_names(windows: DataFrame, sources: DataFrame, bounds: DataFrame) -> DataFrame:
    """The M rows that name the processes of runs, the fixed ones and their threads."""
    return _process_names(_placed(windows.join(numbered_runs(windows), "run_id"), sources, landed(bounds)))


def _process_names(runs: DataFrame) -> DataFrame:
    title = F.concat(F.lit("["), (F.col("source_id") + 1).cast("string"), F.lit("] "), _label(), F.lit(" ("), F.col("status"), F.lit(")"))
    color = F.element_at(F.array(*[F.lit(c) for c in COLORS]), (F.col("source_id") % len(COLORS) + 1).cast("int"))
    naming = _naming(runs, F.col("pid"), [
        _mark("process_name", 0, ("name", title), *_origin()),
        _mark("process_color", 0, ("color", color), ("color_name", F.concat(F.lit("url_"), (F.col("source_id") + 1).cast("string"), F.lit("_color")))),
        *_thread_marks(WORKFLOW_THREAD, OVERVIEW, 0),
    ])
    fixed = _naming(
        runs.sparkSession.range(1).select(F.lit(None).cast("int").alias("source_id")), F.lit(METRICS_PROCESS).cast("bigint"),
        [_mark("process_name", 0, ("name", F.lit(FIXED_PROCESS))), *[m for t in FIXED_THREADS for m in _thread_marks(*t)]],
    )
    return naming.unionByName(fixed)


def trace_events(
    windows: DataFrame, facts: DataFrame, steps: DataFrame | Column, sources: DataFrame, reviews: DataFrame, bounds: DataFrame
) -> DataFrame:
    """X, M, C and i rows; times are microseconds since the source's earliest.

    ``steps`` may be an array of structs of the facts' columns, each job's own: they need not be brought to it then.
    """
    # a row for each source, written: small enough to come to the others instead of bringing them together by source
    bounds = landed(bounds)
    pids = numbered_runs(windows)
    # brought to their run first: jobs that lie together by run are numbered where they are
    jobs = numbered_jobs(facts.join(pids, "run_id"))
    number, index, origin = _number(), ("url_index", F.col("source_id") + 1), _origin()

    def at(ms: Column) -> Column:
        return (ms - F.col("_zero")) * 1000

    runs = _placed(windows.join(pids, "run_id"), sources, bounds)
    label = _label()
    workflow = _event(
        runs, name=F.concat(F.lit("Workflow: "), label, number), ph=F.lit("X"), ts=at(F.col("start_ms")),
        dur=(F.col("effective_end_ms") - F.col("start_ms")) * 1000, pid=F.col("pid"), tid=F.lit(WORKFLOW_THREAD).cast("bigint"),
        cat=F.lit("workflow"),
        args=_args(("status", F.col("status")), ("conclusion", F.col("conclusion")), ("run_id", F.col("run_id")),
                   ("duration_ms", F.col("effective_end_ms") - F.col("start_ms")), ("job_count", F.col("job_count")), index, *origin),
    )
    begun = F.unix_millis("run_started_at")
    queued_runs = _event(
        runs.where(begun > F.col("start_ms")), name=F.concat(F.lit("⏳ Workflow Queued"), number), ph=F.lit("X"), ts=at(F.col("start_ms")),
        dur=(begun - F.col("start_ms")) * 1000, pid=F.col("pid"), tid=F.lit(WORKFLOW_THREAD).cast("bigint"), cat=F.lit("queued"),
        args=_args(("type", F.lit("workflow_queued")), ("queue_time_ms", begun - F.col("start_ms"))),
    )
    placed = _placed(jobs, sources, bounds)
    mark = F.when(F.col("is_required"), " 🔒").otherwise("")
    job = _event(
        placed, name=F.concat(F.lit("Job: "), "name", mark, number), ph=F.lit("X"), ts=at(F.col("start_ms")), dur=F.col("duration_ms") * 1000,
        pid=F.col("pid"), tid=F.col("tid"), cat=F.lit("job"),
        args=_args(("status", F.col("status")), ("conclusion", F.col("conclusion")), ("duration_ms", F.col("duration_ms")),
                   ("runner_name", F.coalesce(F.nullif(F.col("runner_name"), F.lit("")), F.lit("unknown"))), ("url", F.col("url")),
                   ("job_id", F.col("job_id")), ("is_required", F.col("is_required")), index, *origin),
    )
    threads = _event(
        placed, name=F.lit("thread_name"), ph=F.lit("M"), ts=F.lit(0).cast("bigint"), pid=F.col("pid"), tid=F.col("tid"),
        args=_args(("name", F.concat("name", mark))),
    )
    queued_jobs = _event(
        placed.where(F.col("ran_queue_ms") > 0), name=F.concat(F.lit("⏳ Queued"), number), ph=F.lit("X"),
        ts=at(F.col("start_ms") - F.col("ran_queue_ms")), dur=F.col("ran_queue_ms") * 1000, pid=F.col("pid"), tid=F.col("tid"), cat=F.lit("queued"),
        args=_args(("type", F.lit("queued")), ("github.job_name", F.col("name")), ("queue_time_ms", F.col("ran_queue_ms"))),
    )
    if isinstance(steps, Column):
        steps = ci_spans.nested_step_facts(jobs.withColumn("steps", steps), "pid", "tid")
    else:
        steps = steps.join(pids, "run_id").join(jobs.select("job_id", "tid"), "job_id")
    step = _event(
        _placed(steps, sources, bounds),
        name=F.concat("name", number), ph=F.lit("X"), ts=at(F.col("start_ms")), dur=F.col("duration_ms") * 1000, pid=F.col("pid"), tid=F.col("tid"),
        cat=F.col("category"),
        args=_args(("status", F.col("status")), ("conclusion", F.col("conclusion")), ("duration_ms", F.col("duration_ms")),
                   ("job_name", F.col("job_name")), ("url", F.col("url")), ("step_number", F.col("number")), index, *origin),
    )
    # One counter over all sources, relative to the earliest of them.
    low = bounds.agg(F.min("earliest_ms")).first()[0] or 0
    series = metrics.concurrency_series(facts.withColumn("_all", F.lit(0)), ["_all"]).withColumn("source_id", F.lit(None).cast("int"))
    counter = _event(
        series, name=F.lit("Concurrent Jobs"), ph=F.lit("C"), ts=(F.col("ts") - low) * 1000, pid=F.lit(METRICS_PROCESS).cast("bigint"),
        tid=F.lit(COUNTER_THREAD).cast("bigint"), args=_args(("Concurrent Jobs", F.col("running"))),
    )
    noted = _placed(reviews.withColumnRenamed("type", "_kind"), sources, bounds)
    merged = F.col("_kind") == "merged"
    address = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("display_url"))
    who = F.nullif(F.col("user"), F.lit(""))
    label = F.concat(F.when(merged, "◆ merged").otherwise("▲ approved"), F.coalesce(F.concat(F.lit(" by "), who), F.lit("")))
    review = _event(
        noted, name=F.when(merged, "Merged").otherwise("Approved"), ph=F.lit("i"), s=F.lit("p"), ts=at(F.unix_millis("time")),
        pid=F.lit(METRICS_PROCESS).cast("bigint"), tid=F.lit(REVIEW_THREAD).cast("bigint"),
        args=_args(index, ("source_url", address), ("github_url", address), ("url", address), ("source_type", F.col("type")),
                   ("source_identifier", F.col("identifier")), ("user", F.col("user")),
                   ("user_url", F.coalesce(F.concat(F.lit("https://github.com/"), who), F.lit(""))), ("label", label),
                   ("original_event_time_ms", F.unix_millis("time")), ("clamped", F.lit("false"))),
    )
    return reduce(DataFrame.unionByName, [workflow, _process_names(runs), queued_runs, job, threads, queued_jobs, step, counter, review])


def write_trace_events(events: DataFrame, path: str, mode: str = "error") -> None:
    events.write.mode(mode).json(path)


def to_global_time(events: DataFrame, sources: DataFrame, bounds: DataFrame) -> DataFrame:
    """Shift events from their source's earliest time to the global one.

    An event finds its source by ``url_index``, else by ``source_url``.  Events
    without an index stay; negative times become 0.
    """
    known = sources.join(bounds.select("source_id", "earliest_ms"), "source_id")
    by_index = known.select((F.col("source_id") + 1).cast("string").alias("_index"), F.col("earliest_ms").alias("_a"))
    by_url = known.select(F.col("display_url").alias("_url"), F.col("earliest_ms").alias("_b"))
    low = bounds.agg(F.min("earliest_ms")).first()[0] or 0
    rows = events.withColumns({"_index": F.col("args")["url_index"], "_url": F.col("args")["source_url"]})
    rows = rows.join(by_index, "_index", "left").join(by_url, "_url", "left")
    origin = F.coalesce("_a", "_b")
    millis = F.call_function("div", F.col("ts"), F.lit(1000))
    moved = F.col("_index").isNotNull() & origin.isNotNull() & (F.col("ts") != 0)
    shifted = F.when(moved, (millis + origin - low) * 1000).otherwise(F.col("ts"))
    return rows.withColumn("ts", F.greatest(shifted, F.lit(0))).select(*events.columns)
