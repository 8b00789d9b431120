"""Historical trends over tables of runs and jobs.

``keys`` is the grouping a caller wants on top of the reference's own (one
repository): an empty list treats the whole table as one repository.  All sums
are whole milliseconds, so results do not depend on summation order.
"""

from __future__ import annotations

import datetime as dt
import heapq
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import ids, text
from spanloom.operators.ordered import (
    global_rank, order_stats, range_slices, rank_sliced, sliced_window,
)
from spanloom.session import cut, landed

DIRECTION_PERCENT = 5.0
CHANGE_PERCENT = 10.0
FLAKY_PERCENT = 10.0
FLAKY_MIN_RUNS = 5
RECENT_RUNS = 10
RECENT_URLS = 5
TOP_CHANGES = 10
MIN_SIDE = 3
MIN_RUNS_FOR_CHANGES = 4
SAMPLE_FLOOR = 80
SAMPLE_BUCKETS = 10
# Z scores by lowest confidence they serve.
Z_SCORES = [(0.99, 2.576), (0.98, 2.326), (0.95, 1.96), (0.90, 1.645)]


def run_durations(runs: DataFrame) -> DataFrame:
    """Runs with ``duration_ms`` (updated - created, 0 if either is absent)."""
    span = F.unix_millis("updated_at") - F.unix_millis("created_at")
    return runs.withColumn("duration_ms", F.coalesce(span, F.lit(0)))


def run_jobs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs of each run at its latest attempt, with run time and durations."""
    run = runs.select(
        "run_id",
        F.col("run_attempt").alias("_attempt"),
        F.col("created_at").alias("run_created_at"),
        "head_sha",
        "owner",
        "repo",
    )
    took = F.unix_millis("completed_at") - F.unix_millis("started_at")
    queued = F.unix_millis("started_at") - F.unix_millis("created_at")
    attempt = F.coalesce(F.col("run_attempt"), F.lit(0))
    return (
        jobs.join(run, "run_id")
        .where((attempt == 0) | (attempt == F.col("_attempt")))
        .select(
            "run_id", "job_id", "name", "status", "conclusion", "html_url", "started_at",
            "completed_at", "run_created_at", "head_sha", "owner", "repo",
            F.coalesce(took, F.lit(0)).alias("duration_ms"),
            F.coalesce(queued, F.lit(0)).alias("queue_ms"),
        )
    )


def _seconds(total: Column, count: Column) -> Column:
    return F.coalesce(total / count / F.lit(1000.0), F.lit(0.0))


def _percent_change(first: Column, second: Column) -> Column:
    return F.when(first > 0, (second - first) / first * 100)


def _direction(change: Column) -> Column:
    return (
        F.when(change < -DIRECTION_PERCENT, F.lit("improving"))
        .when(change > DIRECTION_PERCENT, F.lit("degrading"))
        .otherwise(F.lit("stable"))
    )


def half_means(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Means of the first floor(n/2) rows and of the rest, per key, in seconds."""
    ranked = global_rank(df.select(*keys, *order, value), keys, order)
    early = F.col("rn") <= F.floor(F.col("n") / 2)
    return (
        ranked.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("observations"),
            (F.sum(F.when(early, F.col(value))) / F.count_if(early) / 1000.0).alias("first_avg"),
            (F.sum(F.when(~early, F.col(value))) / F.count_if(~early) / 1000.0).alias("second_avg"),
        )
    )


def _attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join per-key summaries; without keys both sides are a single row."""
    if keys:
        return left.join(right, keys, "left")
    one = left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one", "left")
    return one.drop("_one")


def trend_summary(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts, mean, median, P95, success rate and direction of run durations."""
    keys = keys or []
    # Counts, percentiles and halves read the durations: they are computed once.
    runs = cut(run_durations(runs).select(*keys, "created_at", "run_id", "duration_ms", "conclusion"))
    valid = runs.where(F.col("duration_ms") > 0)
    base = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_runs"),
        _seconds(
            F.sum(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))),
            F.count_if(F.col("duration_ms") > 0),
        ).alias("avg_duration"),
        (F.count_if(F.col("conclusion") == "success") / F.count(F.lit(1)) * 100).alias(
            "avg_success_rate"
        ),
    )
    ranks = order_stats(valid, keys, "duration_ms", {"p95": 95}, "median")
    halves = half_means(valid, keys, ["created_at", "run_id"], "duration_ms")
    out = _attach(_attach(base, ranks, keys), halves, keys)
    enough = F.col("observations") >= 4
    change = F.coalesce(
        F.when(enough, _percent_change(F.col("first_avg"), F.col("second_avg"))), F.lit(0.0)
    )
    out = out.select(
        *keys, "total_runs", "avg_duration",
        F.coalesce(F.col("median") / 1000.0, F.lit(0.0)).alias("median_duration"),
        F.coalesce(F.col("p95") / 1000.0, F.lit(0.0)).alias("p95_duration"),
        "avg_success_rate",
        change.alias("percent_change"),
    ).withColumn("trend_direction", _direction(F.col("percent_change")))
    return out.withColumn("trend_description", _describe(out["percent_change"], F.col("trend_direction")))


# The texts that describe a trend; %.1f is the change in percent.
_IMPROVING = (
    "Workflow durations decreased by %.1f%% over this period. Runs are completing faster in the more recent half of the "
    "analysis window."
)
_DEGRADING = (
    "Workflow durations increased by %.1f%% over this period. Runs are taking longer in the more recent half of the "
    "analysis window. Investigate recent changes for added overhead, cache issues, or resource contention."
)
_STABLE = "Workflow durations are stable (within 5% variation) over this period."


def _describe(change: Column, direction: Column) -> Column:
    size = F.abs(change)
    return (
        F.when(direction == "improving", F.format_string(_IMPROVING, size))
        .when(direction == "degrading", F.format_string(_DEGRADING, size))
        .otherwise(F.lit(_STABLE))
    )


def duration_series(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean duration in seconds per UTC day over runs that took time."""
    keys = keys or []
    valid = run_durations(runs).where(F.col("duration_ms") > 0)
    return valid.groupBy(*keys, F.to_date("created_at").alias("day")).agg(
        _seconds(F.sum("duration_ms"), F.count(F.lit(1))).alias("value"),
        F.count(F.lit(1)).alias("count"),
    )


def success_series(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Success percentage per UTC day over all runs."""
    keys = keys or []
    return runs.groupBy(*keys, F.to_date("created_at").alias("day")).agg(
        (F.count_if(F.col("conclusion") == "success") / F.count(F.lit(1)) * 100).alias("value"),
        F.count(F.lit(1)).alias("count"),
    )


def recent_urls(jobs: DataFrame, keys: list[str], order: list[str], limit: int = RECENT_URLS) -> DataFrame:
    """Up to ``limit`` newest non-empty URLs per key, newest first.

    The rank filter is pushed below the shuffle, so each task sends at most
    ``limit`` rows per key.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    top = (
        jobs.where(F.coalesce(F.col("html_url"), F.lit("")) != "")
        .select(*keys, *order, "html_url")
        .withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") <= limit)
    )
    return top.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "html_url"))), lambda s: s["html_url"]).alias("urls")
    )


JOB_ORDER = ["run_created_at", "run_id", "job_id"]


def job_trends(jobs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per job name: mean, median, success rate, count, direction, newest URLs.

    Takes the output of :func:`run_jobs`.
    """
    by = [*(keys or []), "name"]
    # Counts, percentiles, halves and addresses read the jobs: they are computed once.
    jobs = cut(jobs.select(*by, *JOB_ORDER, "duration_ms", "conclusion", "html_url"))
    valid = jobs.where(F.col("duration_ms") > 0)
    base = jobs.groupBy(*by).agg(
        _seconds(
            F.sum(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))),
            F.count_if(F.col("duration_ms") > 0),
        ).alias("avg_duration"),
        (F.count_if(F.col("conclusion") == "success") / F.count(F.lit(1)) * 100).alias("success_rate"),
        F.count(F.lit(1)).alias("total_runs"),
    )
    out = (
        base.join(order_stats(valid, by, "duration_ms", {}, "median"), by, "left")
        .join(half_means(valid, by, JOB_ORDER, "duration_ms"), by, "left")
        .join(recent_urls(jobs, by, JOB_ORDER), by, "left")
    )
    change = F.when(
        F.col("observations") >= 4, _percent_change(F.col("first_avg"), F.col("second_avg"))
    )
    return out.select(
        *by, "avg_duration",
        F.coalesce(F.col("median") / 1000.0, F.lit(0.0)).alias("median_duration"),
        "success_rate", "total_runs",
        _direction(change).alias("trend_direction"),
        F.coalesce("urls", F.array().cast("array<string>")).alias("urls"),
    )


def flaky_jobs(jobs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Job names with at least five runs of which more than a tenth failed."""
    by = [*(keys or []), "name"]
    failed = F.col("conclusion") == "failure"
    base = (
        jobs.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.count_if(F.col("conclusion") == "success").alias("success_count"),
            F.count_if(failed).alias("failure_count"),
            F.max(F.when(failed, F.col("completed_at"))).alias("last_failure"),
        )
        .withColumn("flake_rate", F.col("failure_count") / F.col("total_runs") * 100)
        .where((F.col("total_runs") >= FLAKY_MIN_RUNS) & (F.col("flake_rate") > FLAKY_PERCENT))
    )
    newest = Window.partitionBy(*by).orderBy(
        F.col("completed_at").desc_nulls_last(), F.col("job_id").desc()
    )
    recent = (
        jobs.select(*by, "completed_at", "job_id", "conclusion")
        .withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") <= RECENT_RUNS)
        .groupBy(*by)
        .agg(F.count_if(failed).alias("recent_failures"))
    )
    urls = recent_urls(jobs.where(failed & F.col("completed_at").isNotNull()), by, ["completed_at", "job_id"])
    return (
        base.join(recent, by)
        .join(urls, by, "left")
        .withColumn("urls", F.coalesce("urls", F.array().cast("array<string>")))
    )


def job_observations(jobs: DataFrame, by: list[str]) -> DataFrame:
    """Timed jobs in run order with rank ``rn`` and count ``n``; written in slices of that order, packed."""
    valid = jobs.where(F.col("duration_ms") > 0).select(
        *by, *JOB_ORDER, "duration_ms", "head_sha", "html_url", "owner", "repo"
    )
    return rank_sliced(range_slices(valid, by, JOB_ORDER, landed), by, few=True)


def _changepoints(obs: DataFrame, by: list[str]) -> DataFrame:
    """Half means and the best split of every key, in one grouped pass.

    The split with the least squared error is the one with the greatest
    between-group sum of squares, which needs running sums only: ranks and durations
    travel, and what is told of a split is looked up where it was found.
    """
    totals = landed(obs.groupBy(*by).agg(F.sum("duration_ms").alias("total_ms")))
    narrow = obs.select(*by, "_slice", "_ord", "rn", "n", "duration_ms").join(totals, by)
    rows = sliced_window(narrow, by, "_slice", ["_ord"], sums={"upto": F.col("duration_ms")}, write_input=False)
    at = F.col("rn") - 1
    before = F.col("upto") - F.col("duration_ms")
    gap = before - at * (F.col("total_ms") / F.col("n"))
    gain = gap * gap / (at * (F.col("n") - at))
    allowed = (at >= MIN_SIDE) & (at <= F.col("n") - MIN_SIDE)
    half = F.floor(F.col("n") / 2)
    split = F.max_by(
        F.struct(
            at.alias("index"),
            (before / at / 1000.0).alias("before_avg"),
            ((F.col("total_ms") - before) / (F.col("n") - at) / 1000.0).alias("after_avg"),
        ),
        F.when(allowed, F.struct(gain.alias("gain"), (-at).alias("first"))),
    )
    found = landed(rows.groupBy(*by).agg(
        F.first("n").alias("observations"),
        F.first("total_ms").alias("total_ms"),
        F.max(F.when(F.col("rn") == half, F.col("upto"))).alias("first_ms"),
        split.alias("split"),
    ))
    # the first observation after the split and the one before it
    sides = found.where(F.col("split").isNotNull()).select(
        *by, F.explode(F.array(F.col("split.index"), F.col("split.index") + 1)).alias("rn"), F.col("split.index").alias("_index")
    )
    told = F.struct("run_created_at", "head_sha", "html_url", "owner", "repo")
    about = obs.join(sides, [*by, "rn"]).groupBy(*by).agg(
        F.max(F.when(F.col("rn") == F.col("_index"), told)).alias("_b"), F.max(F.when(F.col("rn") > F.col("_index"), told)).alias("_a")
    )
    b, a, s = F.col("_b"), F.col("_a"), F.col("split")
    changepoint = F.struct(
        s["index"].alias("index"), a["run_created_at"].alias("date"),
        b["head_sha"].alias("before_sha"), a["head_sha"].alias("after_sha"),
        b["html_url"].alias("before_run_url"), a["html_url"].alias("after_run_url"),
        s["before_avg"].alias("before_avg"), s["after_avg"].alias("after_avg"),
        ids.compare_url(a["owner"], a["repo"], b["head_sha"], a["head_sha"]).alias("diff_url"),
    )
    return found.join(about, by, "left").select(
        *by, "observations", "total_ms", "first_ms", F.when(s.isNotNull(), changepoint).alias("changepoint")
    )


def changepoints(jobs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Best split point per job name with at least three observations a side."""
    by = [*(keys or []), "name"]
    found = _changepoints(job_observations(jobs, by), by)
    return found.where(F.col("changepoint").isNotNull()).select(
        *by, F.col("observations").alias("total_points"), "changepoint.*"
    )


def job_changes(jobs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Jobs whose mean moved by at least 10 % between the two halves."""
    by = [*(keys or []), "name"]
    obs = job_observations(jobs, by)
    half = F.floor(F.col("observations") / 2)
    found = (
        _changepoints(obs, by)
        .where(half >= 2)
        .withColumn("old_avg", F.col("first_ms") / half / 1000.0)
        .withColumn(
            "new_avg",
            (F.col("total_ms") - F.col("first_ms")) / (F.col("observations") - half) / 1000.0,
        )
        .withColumn("absolute_change", F.abs(F.col("new_avg") - F.col("old_avg")))
        .withColumn("percent_change", (F.col("new_avg") - F.col("old_avg")) / F.col("old_avg") * 100)
        .where(F.abs("percent_change") >= CHANGE_PERCENT)
    )
    late = obs.where(F.col("rn") > F.floor(F.col("n") / 2))
    urls = recent_urls(late, by, ["rn"])
    return found.join(urls, by, "left").select(
        *by,
        F.when(F.col("percent_change") > 0, F.lit("regression")).otherwise(F.lit("improvement")).alias("kind"),
        "old_avg", "new_avg", F.abs("percent_change").alias("percent"), "absolute_change",
        F.coalesce("urls", F.array().cast("array<string>")).alias("urls"),
        "changepoint",
    )


def top_changes(changes: DataFrame, kind: str, limit: int = TOP_CHANGES) -> DataFrame:
    """The largest regressions or improvements (a top-k report)."""
    return changes.where(F.col("kind") == kind).orderBy(F.col("percent").desc(), "name").limit(limit)


def queue_stats(jobs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Queue and run time statistics; all zero when nothing ever queued."""
    keys = keys or []
    waited, ran = F.col("queue_ms") > 0, F.col("duration_ms") > 0
    base = jobs.groupBy(*keys).agg(
        F.count_if(waited).alias("_queued"),
        _seconds(F.sum(F.when(waited, F.col("queue_ms"))), F.count_if(waited)).alias("_queue"),
        _seconds(F.sum(F.when(ran, F.col("duration_ms"))), F.count_if(ran)).alias("_run"),
    )
    queue = order_stats(jobs.where(waited), keys, "queue_ms", {"q95": 95}, "qmed")
    run = order_stats(jobs.where(ran), keys, "duration_ms", {}, "rmed")
    out = _attach(_attach(base, queue, keys), run, keys)
    some = F.col("_queued") > 0
    total = F.col("_queue") + F.col("_run")

    def known(value: Column) -> Column:
        return F.when(some, F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))

    return out.select(
        *keys,
        known(F.col("_queue")).alias("avg_queue_time"),
        known(F.col("qmed") / 1000.0).alias("median_queue_time"),
        known(F.col("q95") / 1000.0).alias("p95_queue_time"),
        known(F.col("_run")).alias("avg_run_time"),
        known(F.col("rmed") / 1000.0).alias("median_run_time"),
        known(F.when(total > 0, F.col("_queue") / total * 100)).alias("queue_time_ratio"),
    )


# --- sampling -----------------------------------------------------------------


def sample_size(total: int, confidence: float = 0.95, margin: float = 0.10) -> int:
    """Finite-population sample size at maximum variance."""
    if total <= 0:
        return 0
    z = next((score for floor, score in Z_SCORES if confidence >= floor), 1.96)
    unlimited = z * z * 0.25 / (margin * margin)
    return min(total, math.ceil(unlimited / (1 + (unlimited - 1) / total)))


# Why a sample was taken or not.
_SAMPLED = "{total:,} runs analyzed. {size} sampled for job details ({confidence:.0f}% confidence, ±{margin:.0f}% margin)."
_FULL = "{total:,} runs analyzed. Full job details fetched for all runs."


def sampling_plan(total: int, sample: bool = True, confidence: float = 0.95, margin: float = 0.10) -> dict:
    """Whether sampling pays off, the size, and why."""
    size = max(sample_size(total, confidence, margin), min(SAMPLE_FLOOR, total))
    enabled = sample and size < total * 3 // 4
    size = size if enabled else total
    why = (_SAMPLED if enabled else _FULL).format(total=total, size=size, confidence=confidence * 100, margin=margin * 100)
    return {
        "enabled": enabled, "sample_size": size, "total_runs": total,
        "confidence": confidence, "margin_of_error": margin, "rationale": why,
    }


def sampling_info(runs: DataFrame, sample: bool = True, confidence: float = 0.95, margin: float = 0.10) -> DataFrame:
    plan = sampling_plan(runs.count(), sample, confidence, margin)
    schema = (
        "enabled boolean, sample_size bigint, total_runs bigint, confidence double, "
        "margin_of_error double, rationale string"
    )
    return runs.sparkSession.createDataFrame([tuple(plan.values())], schema)


def _quotas(sizes: list[int], size: int) -> list[int]:
    """Whole shares of ``size`` in proportion to ``sizes`` that add up to it; ``size`` is below the sum of ``sizes``.

    What rounding leaves over goes to the places first in order of room, a bucket with room r having the places
    r, r - 1, ..., 1; what it gives too much is taken from the largest shares in the same way.
    """
    total = sum(sizes)
    share = [(2 * n * size + total) // (2 * total) for n in sizes]
    rest = size - sum(share)
    room = [n - q if rest > 0 else q for n, q in zip(sizes, share)]
    places = ((r - k, -i) for i, r in enumerate(room) for k in range(min(r, abs(rest))))
    moved = Counter(-i for _, i in heapq.nlargest(abs(rest), places))
    return [q + (moved[i] if rest > 0 else -moved[i]) for i, q in enumerate(share)]


def with_time_bucket(runs: DataFrame, low_ms: int, high_ms: int, buckets: int) -> DataFrame:
    """Equal-width creation-time bucket of every run."""
    if high_ms <= low_ms:
        return runs.withColumn("_bucket", F.lit(0))
    place = (F.unix_millis("created_at") - low_ms) / F.lit(float(high_ms - low_ms)) * buckets
    return runs.withColumn("_bucket", F.least(F.floor(place), F.lit(buckets - 1)).cast("int"))


def stratified_sample(runs: DataFrame, size: int) -> DataFrame:
    """Exactly ``size`` runs, spread over creation time, the same on every call.

    Only bucket counts (at most ten numbers) reach the driver.  Rows are picked
    by the order of md5(run_id), ranked in slices, so quotas of any size and the
    few buckets do not put many rows into a task.
    """
    bounds = runs.agg(
        F.count(F.lit(1)), F.min(F.unix_millis("created_at")), F.max(F.unix_millis("created_at"))
    ).first()
    total, low, high = bounds
    if size >= total:
        return runs
    if size <= 0:
        return runs.limit(0)
    buckets = max(1, min(SAMPLE_BUCKETS, size))
    placed = with_time_bucket(runs, low, high, buckets)
    counts = {r["_bucket"]: r["n"] for r in placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = _quotas([counts.get(b, 0) for b in range(buckets)], size)
    limit = F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("_bucket") + 1)
    keys = placed.select("_bucket", F.md5(F.col("run_id").cast("string")).alias("_h"), "run_id")
    ranked = global_rank(keys, ["_bucket"], ["_h", "run_id"])
    return runs.join(ranked.where(F.col("rn") <= limit).select("run_id"), "run_id", "left_semi").select(*runs.columns)


# --- the whole analysis ---------------------------------------------------------


def recent_runs(
    runs: DataFrame, as_of: dt.date, days: int = 30, branch: str | None = None, workflow: str | None = None
) -> DataFrame:
    """Runs created in the last ``days`` days, optionally of a branch and workflow file."""
    out = runs.where(F.col("created_at") >= F.lit(as_of - dt.timedelta(days=days)).cast("timestamp"))
    if branch:
        out = out.where(F.col("head_branch") == branch)
    if workflow:
        out = out.where(F.col("path").endswith(workflow))
    return out


def analyze_trends(
    runs: DataFrame, jobs: DataFrame, as_of: dt.date, days: int = 30, branch: str | None = None,
    workflow: str | None = None, sample: bool = False, confidence: float = 0.95, margin: float = 0.10,
) -> dict[str, DataFrame]:
    """Every part of the trend report, one DataFrame each.

    All parts use all runs; with ``sample`` the job parts use a stratified sample of
    them, as one would where job details are fetched one by one.
    """
    chosen = recent_runs(runs, as_of, days, branch, workflow)
    plan = sampling_plan(chosen.count(), sample, confidence, margin)
    if plan["total_runs"] == 0:
        raise ValueError(f"no workflow runs found in the last {days} days")
    detail_runs = stratified_sample(chosen, plan["sample_size"]) if plan["enabled"] else chosen
    detail = run_jobs(detail_runs, jobs)
    if plan["total_runs"] < MIN_RUNS_FOR_CHANGES:
        changes = job_changes(detail.where(F.lit(False)))
    else:
        changes = job_changes(detail)
    flaky = flaky_jobs(detail)
    summary = _attach(trend_summary(chosen), flaky.agg(F.count(F.lit(1)).alias("flaky_jobs_count")), [])
    schema = (
        "enabled boolean, sample_size bigint, total_runs bigint, confidence double, "
        "margin_of_error double, rationale string"
    )
    return {
        "summary": summary,
        "sampling": runs.sparkSession.createDataFrame([tuple(plan.values())], schema),
        "duration_trend": duration_series(chosen).orderBy("day"),
        "success_trend": success_series(chosen).orderBy("day"),
        "job_trends": job_trends(detail).orderBy(F.col("avg_duration").desc(), "name"),
        "flaky_jobs": flaky.orderBy(F.col("flake_rate").desc(), "name"),
        "regressions": top_changes(changes, "regression"),
        "improvements": top_changes(changes, "improvement"),
        "queue": queue_stats(detail),
    }
