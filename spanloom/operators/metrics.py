"""Run, job, step and queue metrics, concurrency and bottlenecks.

Per-source numbers are plain grouped aggregates: partial sums combine inside
each task, so a source with a third of the rows costs one row per task in the
shuffle.  Anything that needs order works on time slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.functions.codes import attribute
from spanloom.functions.ids import ns_to_ms
from spanloom.session import cut

MIN_BOTTLENECK_MS = 1000
BOTTLENECK_SHARE = 0.1
SERIES_CHUNK = 4096


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.when(whole > 0, part / whole * 100), F.lit(0.0))


def run_counters(runs: DataFrame) -> DataFrame:
    good = (F.col("status") == "completed") & (F.col("conclusion") == "success")
    won = F.count_if(F.coalesce(good, F.lit(False)))
    return runs.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total_runs"),
        won.alias("successful_runs"),
        (F.count(F.lit(1)) - won).alias("failed_runs"),
        F.count_if(F.col("run_attempt") > 1).alias("retried_runs"),
    )


def job_counters(facts: DataFrame) -> DataFrame:
    """Counts, durations, queue times and extremes of jobs per source."""
    queued = F.col("ran_queue_ms") > 0
    return facts.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if("is_failed").alias("failed_jobs"),
        F.count_if("is_pending").alias("pending_jobs"),
        F.sum("duration_ms").alias("job_ms"),
        F.avg("duration_ms").alias("avg_job_duration"),
        F.max_by("name", F.struct(F.col("duration_ms"), -F.col("job_id"))).alias("longest_job"),
        F.max("duration_ms").alias("longest_ms"),
        F.min_by("name", F.struct("duration_ms", "job_id")).alias("shortest_job"),
        F.min("duration_ms").alias("shortest_ms"),
        F.count_if(queued).alias("queue_count"),
        F.coalesce(F.avg(F.when(queued, F.col("ran_queue_ms"))), F.lit(0.0)).alias("avg_queue_ms"),
        F.coalesce(F.max(F.when(queued, F.col("ran_queue_ms"))), F.lit(0)).alias("max_queue_ms"),
    )


def step_counters(steps: DataFrame) -> DataFrame:
    return steps.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.count_if(F.col("conclusion") == "failure").alias("failed_steps"),
        F.avg("duration_ms").alias("avg_step_duration"),
    )


def source_metrics(runs: DataFrame, facts: DataFrame, steps: DataFrame) -> DataFrame:
    """Counters and final metrics per source."""
    rows = (
        run_counters(runs)
        .join(job_counters(facts), "source_id", "left")
        .join(step_counters(steps), "source_id", "left")
    )
    counts = [
        "total_jobs", "failed_jobs", "pending_jobs", "job_ms", "longest_ms", "shortest_ms", "queue_count",
        "max_queue_ms", "total_steps", "failed_steps",
    ]
    means = ["avg_job_duration", "avg_step_duration", "avg_queue_ms"]
    rows = rows.fillna(0, counts).fillna(0.0, means)
    return rows.withColumns(
        {
            "success_rate": _ratio(F.col("successful_runs"), F.col("total_runs")),
            "job_success_rate": _ratio(F.col("total_jobs") - F.col("failed_jobs"), F.col("total_jobs")),
            "retry_rate": _ratio(F.col("retried_runs"), F.col("total_runs")),
        }
    )


def combined_metrics(per_source: DataFrame) -> DataFrame:
    """Totals over sources with exact ratios of sums."""
    return per_source.agg(
        F.count(F.lit(1)).alias("sources"),
        F.sum("total_runs").alias("total_runs"),
        F.sum("total_jobs").alias("total_jobs"),
        F.sum("total_steps").alias("total_steps"),
        _ratio(F.sum("successful_runs"), F.sum("total_runs")).alias("success_rate"),
        _ratio(F.sum("total_jobs") - F.sum("failed_jobs"), F.sum("total_jobs")).alias("job_success_rate"),
    )


def runner_distribution(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    by = ["source_id"] if keys is None else keys
    named = facts.where(F.coalesce("runner_name", F.lit("")) != "")
    return named.groupBy(*by, "runner_name").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("duration_ms").alias("duration_ms")
    )


def billable(timing: DataFrame, runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Billable milliseconds per OS over completed runs."""
    by = ["source_id"] if keys is None else keys
    done = runs.where(F.col("status") == "completed").select("run_id", "source_id")
    return (
        timing.where(F.col("total_ms") > 0).join(done, "run_id")
        .groupBy(*by, "os").agg(F.sum("total_ms").alias("total_ms"))
    )


def enrichment_totals(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """Queue times and retry share over all sources, one row."""
    queued = F.col("ran_queue_ms") > 0
    queue = facts.agg(
        F.coalesce(F.avg(F.when(queued, F.col("ran_queue_ms"))), F.lit(0.0)).alias("avg_queue_ms"),
        F.coalesce(F.max("ran_queue_ms"), F.lit(0)).alias("max_queue_ms"),
        F.count_if(queued).alias("queue_count"),
        F.countDistinct(F.nullif("runner_name", F.lit(""))).alias("runners"),
        F.lit(1).alias("_one"),
    )
    retries = runs.agg(
        F.count_if(F.col("run_attempt") > 1).alias("retried_runs"),
        F.count(F.lit(1)).alias("total_runs"),
        F.lit(1).alias("_one"),
    )
    return queue.join(retries, "_one").drop("_one").withColumn(
        "retry_rate", _ratio(F.col("retried_runs"), F.col("total_runs"))
    )


def source_bounds(
    runs: DataFrame, sources: DataFrame, reviews: DataFrame, facts: DataFrame | None = None
) -> DataFrame:
    """Earliest and latest activity per source in ms."""
    points = [
        runs.select("source_id", F.unix_millis("created_at").alias("lo"),
                    F.unix_millis(F.coalesce("updated_at", "created_at")).alias("hi")),
        reviews.select("source_id", F.unix_millis("time").alias("lo"), F.unix_millis("time").alias("hi")),
    ]
    for column in ("commit_time", "pushed_at"):
        at = F.unix_millis(column)
        points.append(sources.select("source_id", at.alias("lo"), F.lit(None).cast("bigint").alias("hi")))
    if facts is not None:
        points.append(facts.select("source_id", F.lit(None).cast("bigint").alias("lo"), F.col("end_ms").alias("hi")))
    every = points[0]
    for more in points[1:]:
        every = every.unionByName(more)
    return every.groupBy("source_id").agg(F.min("lo").alias("earliest_ms"), F.max("hi").alias("latest_ms"))


def global_bounds(bounds: DataFrame) -> DataFrame:
    return bounds.agg(F.min("earliest_ms").alias("earliest_ms"), F.max("latest_ms").alias("latest_ms"))


def span_bounds(spans: DataFrame) -> DataFrame:
    return spans.agg(
        ns_to_ms(F.min("start_ns")).alias("earliest_ms"),
        ns_to_ms(F.max("end_ns")).alias("latest_ms"),
    )


def wall_and_compute(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    by = ["source_id"] if keys is None else keys
    return facts.groupBy(*by).agg(
        F.greatest(F.max("end_ms") - F.min("start_ms"), F.lit(0)).alias("wall_ms"),
        F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("compute_ms"),
    )


def commit_compute(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Run count and latest-attempt job time of completed runs per source."""
    attempt = F.greatest(F.coalesce("run_attempt", F.lit(1)), F.lit(1))
    done = runs.where(F.col("status") == "completed").select("run_id", "source_id", attempt.alias("_attempt"))
    own = F.coalesce("run_attempt", F.lit(0))
    took = F.unix_millis("completed_at") - F.unix_millis("started_at")
    spent = (
        jobs.drop("source_id").join(done, "run_id")
        .where((own == 0) | (own == F.col("_attempt")))
        .groupBy("source_id").agg(F.sum(F.when(took > 0, took)).alias("compute_ms"))
    )
    counts = runs.groupBy("source_id").agg(F.count(F.lit(1)).alias("run_count"))
    return counts.join(spent, "source_id", "left").fillna(0, ["compute_ms"])


def pending_jobs(facts: DataFrame, sources: DataFrame) -> DataFrame:
    named = sources.select("source_id", "display_name", "display_url")
    return (
        facts.where("is_pending").join(named, "source_id")
        .select("name", "status", "url", "is_required", "display_name", "display_url", "job_id")
        .orderBy("name", "job_id")
    )


def job_groups(facts: DataFrame) -> DataFrame:
    """Jobs by the text before the first `` / ``, per source, ordered by start."""
    return (
        facts.groupBy("source_id", text.job_group(F.col("name")).alias("job_group"))
        .agg(
            F.count(F.lit(1)).alias("jobs"),
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
        )
        .withColumn("wall_ms", F.col("end_ms") - F.col("start_ms"))
        .orderBy("source_id", "start_ms", "job_group")
    )


def source_outcomes(facts: DataFrame) -> DataFrame:
    """Blocking failure > optional failure > pending > skipped > ok."""
    failed = F.coalesce(F.col("conclusion") == "failure", F.lit(False))
    return facts.groupBy("source_id").agg(
        F.when(F.bool_or(failed & F.col("is_required")), "blocking_failure")
        .when(F.bool_or(failed & ~F.col("is_required")), "optional_failure")
        .when(F.bool_or("is_pending"), "pending")
        .when(F.bool_or(F.coalesce(F.col("conclusion").isin("skipped", "cancelled"), F.lit(False))), "skipped")
        .otherwise("ok")
        .alias("outcome")
    )


def group_outcome(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Failure if any span failed, else success if any succeeded, else empty."""
    return spans.groupBy(*keys).agg(
        F.when(F.bool_or(F.col("hints.outcome") == "failure"), "failure")
        .when(F.bool_or(F.col("hints.outcome") == "success"), "success")
        .otherwise("").alias("outcome")
    )


def workflow_files(spans: DataFrame) -> DataFrame:
    """Distinct workflow files in first-seen order."""
    path = F.col("attrs")["cicd.pipeline.definition"]
    return (
        spans.where(F.coalesce(path, F.lit("")) != "")
        .groupBy(path.alias("path"))
        .agg(F.min(F.struct("start_ns", "span_id")).alias("first"))
        .orderBy("first", "path")
        .select("path", F.col("first.start_ns").alias("first_ns"))
    )


def review_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("source_id").agg(
        F.count_if(F.col("type") == "merged").alias("merged"),
        F.count_if((F.col("type") == "review") & (F.col("state") == "APPROVED")).alias("approvals"),
        F.count_if(F.col("type") == "comment").alias("comments"),
    )


def artifact_totals(roots: DataFrame) -> DataFrame:
    """Artifact count, bytes and names over root spans."""
    attrs = F.col("attrs")
    count = attrs["cicd.pipeline.artifacts.count"].try_cast("bigint")
    rows = roots.where(count > 0)
    return rows.agg(
        F.coalesce(F.sum(count), F.lit(0)).alias("artifacts"),
        F.coalesce(F.sum(attrs["cicd.pipeline.artifacts.size_bytes"].try_cast("bigint")), F.lit(0)).alias("bytes"),
    )


def artifact_names(roots: DataFrame) -> DataFrame:
    """Artifact names of the roots, one row per name and root, in root order."""
    names = F.split(F.col("attrs")["cicd.pipeline.artifacts.names"], ", ")
    return roots.where(names.isNotNull()).select(
        "trace_id", "span_id", "start_ns", F.posexplode(names).alias("position", "artifact_name")
    )


def vcs_changes(roots: DataFrame) -> DataFrame:
    """Changed files, additions and deletions per source (shared by its roots)."""
    attrs = F.col("attrs")
    count = attrs["vcs.changes.count"].try_cast("bigint")
    return roots.where(count > 0).groupBy("source_id").agg(
        F.max(count).alias("files"),
        F.max(attrs["vcs.changes.additions"].try_cast("bigint")).alias("additions"),
        F.max(attrs["vcs.changes.deletions"].try_cast("bigint")).alias("deletions"),
    )


# --- summaries of enriched spans --------------------------------------------------


def _job_level(hints: Column | dict[str, Column] | None = None) -> Column:
    h = F.col("hints") if hints is None else hints
    return (h["category"] != "") & ~h["is_root"] & ~h["is_marker"] & ~h["is_leaf"]


def summarize(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs, jobs, failures, queue times and retries of enriched spans in one pass."""
    used = ["category", "outcome", "is_root", "is_marker", "is_leaf"]
    rows = spans.select(
        *(keys or []), *[F.col("hints")[c].alias(f"_{c}") for c in used], (F.col("end_ns") - F.col("start_ns")).alias("_took"),
        F.coalesce(attribute(spans, "queue_time_ms").try_cast("bigint"), F.lit(0)).alias("_queue"),
        F.coalesce(attribute(spans, "github.run_attempt").try_cast("bigint"), F.lit(0)).alias("_attempt"),
    )
    h = {c: F.col(f"_{c}") for c in used}
    root = (h["category"] != "") & h["is_root"]
    job = _job_level(h)
    queue = F.col("_queue")
    queued = job & (queue > 0)
    return rows.groupBy(*(keys or [])).agg(
        F.count_if(root).alias("total_runs"),
        F.count_if(root & (h["outcome"] == "success")).alias("successful_runs"),
        F.count_if(job).alias("total_jobs"),
        F.count_if(job & (h["outcome"] == "failure")).alias("failed_jobs"),
        F.count_if(queued).alias("queue_count"),
        F.coalesce(F.sum(F.when(queued, queue)) / F.count_if(queued), F.lit(0.0)).alias("avg_queue_ms"),
        F.coalesce(F.max(F.when(queued, queue)), F.lit(0)).alias("max_queue_ms"),
        F.count_if(root & (F.col("_attempt") > 1)).alias("retried_runs"),
        F.coalesce(
            F.sum(F.when(
                h["category"].isin("job", "task") & ~h["is_marker"] & (F.col("_took") > 0), ns_to_ms(F.col("_took"))
            )), F.lit(0),
        ).alias("compute_ms"),
        F.count_if((h["category"] != "") & ~h["is_marker"] & h["is_leaf"]).alias("leaf_count"),
    )


def billable_of_spans(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Billable milliseconds per OS from the attributes of root spans."""
    kept = F.map_filter("attrs", lambda k, _: k.startswith("billable.") & k.endswith("_ms"))
    rows = spans.where(F.col("hints.is_root")).select(*(keys or []), F.explode(kept).alias("k", "v"))
    return rows.groupBy(*(keys or []), F.regexp_extract("k", r"^billable\.(.*)_ms$", 1).alias("os")).agg(
        F.sum(F.col("v").try_cast("bigint")).alias("total_ms")
    )


def marker_partition(spans: DataFrame) -> DataFrame:
    """Bounds and counts of markers and of the rest, per source."""
    marker = (F.col("hints.group_key") == "activity") | F.col("hints.is_marker")
    return spans.groupBy("source_id", marker.alias("is_marker")).agg(
        F.count(F.lit(1)).alias("spans"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns")
    )


def artifact_groups(artifacts: DataFrame, spans: DataFrame) -> DataFrame:
    """Artifacts with the bounds of the trace spans they brought, per run.

    Spans naming an artifact that is not listed keep their own row.
    """
    name = F.coalesce(F.nullif(F.col("attrs")["github.artifact_name"], F.lit("")), F.lit("_unknown"))
    grouped = spans.groupBy("run_id", name.alias("name")).agg(
        F.count(F.lit(1)).alias("spans"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns")
    )
    live = artifacts.where(~F.coalesce("expired", F.lit(False))).select(
        "run_id", "name", "artifact_id", "size_in_bytes"
    )
    return live.join(grouped, ["run_id", "name"], "full").fillna(0, ["spans"])


# --- concurrency ------------------------------------------------------------------


def _moments(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Starts and ends per (key, moment); equal moments combine before the shuffle."""
    points = intervals.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(start).alias("ts"), F.lit(1).alias("s"), F.lit(0).alias("e")),
                F.struct(F.col(end).alias("ts"), F.lit(0).alias("s"), F.lit(1).alias("e")),
            )
        ).alias("p"),
    )
    return points.groupBy(*keys, "p.ts").agg(F.sum("p.s").alias("starts"), F.sum("p.e").alias("ends"))


def _prefix(keys: list[str]):
    """Add ``_local``, the net rise of a key's earlier moments in the partition, for rows sorted by key and moment.

    The pass streams: it holds the last key and its running sum, however many rows a partition has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, bool)
            for key in keys:
                column = batch.column(key)
                if n > 1:
                    same = pc.equal(column.slice(1), column.slice(0, n - 1)).fill_null(False)
                    both = pc.and_(pc.is_null(column.slice(1)), pc.is_null(column.slice(0, n - 1)))
                    change[1:] |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
            if [batch.column(k)[0].as_py() for k in keys] != last:
                carry = 0
            net = batch.column("starts").to_numpy() - batch.column("ends").to_numpy()
            total = np.cumsum(net)
            begin = np.maximum.accumulate(np.where(change, np.arange(n), 0))
            base = np.where(begin > 0, total[begin - 1], -carry)
            local = total - net - base
            last, carry = [batch.column(k)[n - 1].as_py() for k in keys], int(local[-1] + net[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(np.full(n, part, np.int64))], [*batch.schema.names, "_local", "_part"])

    return run


def _swept(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Moments in order, range-partitioned by rows: a slice holds so many moments however close they lie."""
    moments = _moments(intervals, keys, start, end)
    by = [*keys, "ts"]
    ranged = moments.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in moments.schema] + ["_local bigint", "_part bigint"])
    return ranged.mapInArrow(_prefix(keys), schema)


def _carried(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_carry``, the net rise of a key's earlier slices; ``parts`` has one row for each key and slice."""
    chain = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_carry", F.coalesce(F.sum("_net").over(chain), F.lit(0)))


def _running(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Moments with ``before``, the number of open intervals just before them."""
    swept = cut(_swept(intervals, keys, start, end))
    parts = swept.groupBy(*keys, "_part").agg(F.sum(F.col("starts") - F.col("ends")).alias("_net"))
    rows = swept.join(_carried(parts, keys).drop("_net"), [*keys, "_part"])
    return rows.select(*keys, "ts", "starts", "ends", (F.col("_carry") + F.col("_local")).alias("before"))


def max_concurrency(
    intervals: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms",
    ends_first: bool = False,
) -> DataFrame:
    """Largest number of open intervals per key.

    At equal times starts count first for job events, ends first for spans.  Each slice is reduced to its net
    change and its greatest prefix; slices combine in order to the key's peak.
    """
    keyed = keys or ["_all"]
    if not keys:
        intervals = intervals.withColumn("_all", F.lit(0))
    peak = F.col("_local") + F.col("starts")
    if ends_first:
        peak = peak - F.col("ends")
    parts = _swept(intervals, keyed, start, end).groupBy(*keyed, "_part").agg(
        F.sum(F.col("starts") - F.col("ends")).alias("_net"), F.max(peak).alias("_peak")
    )
    out = _carried(parts, keyed).groupBy(*keyed).agg(
        F.greatest(F.max(F.col("_carry") + F.col("_peak")), F.lit(0)).alias("max_concurrency")
    )
    return out.drop("_all")


def span_concurrency(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Concurrency of job-level spans, ends before starts at equal times."""
    return max_concurrency(
        spans.where(_job_level()), keys, "start_ns", "end_ns", ends_first=True
    )


def concurrency_series(intervals: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """The running count after every start and end, with time since the key's first."""
    first = intervals.groupBy(*keys).agg(F.min(start).alias("_first"))
    run = _running(intervals, keys, start, end).join(first, keys)
    # Chunked, so that many events at one moment never form one long array.
    total = F.col("starts") + F.col("ends")
    chunks = run.withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((total - 1) / SERIES_CHUNK).cast("int"))))
    low = F.col("_c") * SERIES_CHUNK
    steps = chunks.withColumn("step", F.explode(F.sequence(low + 1, F.least(low + SERIES_CHUNK, total))))
    rise = F.least(F.col("step"), F.col("starts"))
    fall = F.greatest(F.col("step") - F.col("starts"), F.lit(0))
    return steps.select(
        *keys, "ts", (F.col("ts") - F.col("_first")).alias("since_ms"), "step",
        (F.col("before") + rise - fall).alias("running"),
    )


# --- top-k and bottlenecks ----------------------------------------------------------


def slowest(rows: DataFrame, limit: int = 5, tie: str = "job_id") -> DataFrame:
    """The longest jobs or steps overall (a top-k report)."""
    return rows.orderBy(F.col("duration_ms").desc(), "name", tie).limit(limit)


def slowest_per_source(facts: DataFrame, limit: int = 5) -> DataFrame:
    """The longest jobs of every source; the rank limit also runs before the shuffle."""
    order = Window.partitionBy("source_id").orderBy(F.col("duration_ms").desc(), "name", "job_id")
    return facts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def bottlenecks(facts: DataFrame) -> DataFrame:
    """Jobs over a second and over a tenth of their source's span; else its two longest."""
    limits = facts.groupBy("source_id").agg(
        ((F.max("end_ms") - F.min("start_ms")) * BOTTLENECK_SHARE).alias("threshold"),
        F.max("duration_ms").alias("_longest"),
    )
    limits = limits.select("source_id", "threshold", (F.col("_longest") > F.col("threshold")).alias("_any"))
    significant = facts.where(F.col("duration_ms") > MIN_BOTTLENECK_MS)
    rows = significant.join(limits, "source_id")
    big = rows.where(F.col("duration_ms") > F.col("threshold")).drop("threshold", "_any")
    two = slowest_per_source(rows.where(~F.col("_any")).drop("threshold", "_any"), 2).drop("rank")
    return big.unionByName(two)


def sources_by_earliest(sources: DataFrame, bounds: DataFrame) -> DataFrame:
    return sources.join(bounds, "source_id").orderBy("earliest_ms", "source_id")


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Combined timeline rows carry their source's name and URL."""
    return rows.join(sources.select("source_id", "display_name", "display_url"), "source_id")


def with_bottleneck_flag(rows: DataFrame, found: DataFrame) -> DataFrame:
    flags = found.select("job_id", F.lit(True).alias("is_bottleneck"))
    return rows.join(flags, "job_id", "left").fillna(False, ["is_bottleneck"])


def report(runs: DataFrame, facts: DataFrame, steps: DataFrame, sources: DataFrame, reviews: DataFrame,
           jobs: DataFrame) -> dict[str, DataFrame]:
    """The report's sections as tables.  Most read the job facts: pass a written table (:func:`spanloom.session.landed`)."""
    per_source = source_metrics(runs, facts, steps)
    peak = max_concurrency(facts, []).withColumn("_one", F.lit(1))
    summary = combined_metrics(per_source).withColumn("_one", F.lit(1)).join(peak, "_one").drop("_one")
    slow = with_source(with_bottleneck_flag(slowest_per_source(facts), bottlenecks(facts)), sources)
    names = sources.select("source_id", "display_name", "display_url", "type")
    run_summary = (
        names.join(run_counters(runs), "source_id")
        .join(wall_and_compute(facts), "source_id", "left")
        .join(review_counts(reviews), "source_id", "left")
        .fillna(0, ["wall_ms", "compute_ms", "merged", "approvals", "comments"])
    )
    return {
        "summary": summary,
        "pending": pending_jobs(facts, sources),
        "urls": sources_by_earliest(names, source_bounds(runs, sources, reviews)),
        "run_summary": run_summary,
        "slowest_jobs": slow.orderBy("source_id", "rank"),
        "commit_runs": commit_compute(runs, jobs).join(names.where(F.col("type") == "commit"), "source_id"),
    }
