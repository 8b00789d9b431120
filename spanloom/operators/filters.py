"""Filters over spans, runs, jobs and events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import glob

# Filter keys that are real columns, so that they reach the scan.
COLUMNS = {"otel.span_name": "name", "otel.status_code": "status_code"}


def condition(key: str, pattern: str = "*", negate: bool = False) -> Column:
    """One filter condition.  Resource attributes win over span attributes.

    A positive condition needs the key to exist; a negated one passes when it
    does not.
    """
    if key in COLUMNS:
        value = F.col(COLUMNS[key])
    else:
        value = F.coalesce(F.col("resource")[key], F.col("attrs")[key])
    matched = glob(value, pattern)
    return ~F.coalesce(matched, F.lit(False)) if negate else matched


def filter_spans(spans: DataFrame, conditions: list[tuple[str, str, bool]]) -> DataFrame:
    """Spans that meet all of ``(key, glob, negate)``."""
    for key, pattern, negate in conditions:
        spans = spans.where(condition(key, pattern, negate))
    return spans


def errors_only(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("status_code") == "ERROR")


def _run_time() -> Column:
    return F.coalesce(F.unix_millis("updated_at"), F.unix_millis("created_at"), F.lit(0))


def window_starts(sources: DataFrame, runs: DataFrame, reviews: DataFrame, window: dt.timedelta) -> DataFrame:
    """Start of the activity window per source: before merge, else before the last activity."""
    activity = (
        runs.select("source_id", _run_time().alias("at"))
        .unionByName(reviews.select("source_id", F.unix_millis("time").alias("at")))
        .groupBy("source_id")
        .agg(F.max("at").alias("latest"))
    )
    anchor = F.coalesce(F.unix_millis("merged_at"), F.col("latest"), F.lit(0))
    return sources.join(activity, "source_id", "left").select(
        "source_id", (anchor - int(window.total_seconds() * 1000)).alias("window_start_ms")
    )


def within_window(
    sources: DataFrame, runs: DataFrame, reviews: DataFrame, window: dt.timedelta
) -> dict[str, DataFrame]:
    """Sources, runs and reviews cut to the activity window of their source."""
    starts = window_starts(sources, runs, reviews, window)
    begin = F.col("window_start_ms")

    def kept(column: str) -> Column:
        return F.when(F.unix_millis(column) >= begin, F.col(column)).alias(column)

    return {
        "runs": runs.join(starts, "source_id").where(_run_time() >= begin).drop("window_start_ms"),
        "review_events": reviews.join(starts, "source_id")
        .where(F.unix_millis("time") >= begin).drop("window_start_ms"),
        "sources": sources.join(starts, "source_id")
        .withColumn("commit_time", kept("commit_time"))
        .withColumn("pushed_at", kept("pushed_at")).drop("window_start_ms"),
    }


def not_before_commit(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Runs created at or after their source's commit time, if it has one."""
    times = sources.select("source_id", F.col("commit_time").alias("_commit"))
    ok = F.col("_commit").isNull() | (F.unix_millis("created_at") >= F.unix_millis("_commit"))
    return runs.join(times, "source_id").where(ok).drop("_commit")


def preferred_runs(runs: DataFrame, event: str = "push", branch: Column | None = None) -> DataFrame:
    """Runs of the event (and branch); a source without any keeps all its runs.

    The per-source flag is one aggregated row, so a huge source stays spread out.
    """
    wanted = F.col("event") == event
    if branch is not None:
        wanted = wanted & (F.col("head_branch") == branch)
    wanted = F.coalesce(wanted, F.lit(False))
    has = runs.groupBy("source_id").agg(F.bool_or(wanted).alias("_has"))
    return runs.join(has, "source_id").where(wanted | ~F.col("_has")).drop("_has")


def scan_filters(
    runs: DataFrame, head_sha: str | None = None, branch: str | None = None, event: str | None = None,
    created_from: dt.date | None = None,
) -> DataFrame:
    """Plain column predicates that Parquet can push down."""
    for column, value in (("head_sha", head_sha), ("head_branch", branch), ("event", event)):
        if value is not None:
            runs = runs.where(F.col(column) == value)
    if created_from is not None:
        runs = runs.where(F.col("created_at") >= F.lit(created_from).cast("timestamp"))
    return runs


def of_workflow(runs: DataFrame, workflow: str) -> DataFrame:
    return runs.where(F.col("path").endswith(workflow))


def latest_attempt(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs of their run's current attempt; attempt 0 or null means unknown and passes."""
    attempts = runs.select("run_id", F.greatest(F.coalesce("run_attempt", F.lit(1)), F.lit(1)).alias("_attempt"))
    own = F.coalesce(F.col("run_attempt"), F.lit(0))
    return jobs.join(attempts, "run_id").where((own == 0) | (own == F.col("_attempt"))).drop("_attempt")


def overlapping(spans: DataFrame, earliest_ns: int | None, latest_ns: int | None) -> DataFrame:
    if earliest_ns is not None:
        spans = spans.where(F.col("end_ns") >= earliest_ns)
    if latest_ns is not None:
        spans = spans.where(F.col("start_ns") <= latest_ns)
    return spans


def classified(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("hints.category") != "")


def timed_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("started_at").isNotNull())


def timed_steps(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("started_at").isNotNull() & F.col("completed_at").isNotNull())


def trace_artifacts(artifacts: DataFrame) -> DataFrame:
    """Unexpired artifacts that hold traces."""
    return artifacts.where(~F.coalesce("expired", F.lit(False)) & F.col("name").startswith("gha-trace"))


def search_attributes(spans: DataFrame, query: str) -> DataFrame:
    """(span, key, value) where key or value contains the text, any case."""
    low = query.lower()
    hit = F.filter(
        F.map_entries("attrs"),
        lambda e: F.lower(e["key"]).contains(low) | F.lower(e["value"]).contains(low),
    )
    return spans.select("source_id", "trace_id", "span_id", F.inline(hit).alias("key", "value"))


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each key in ``order``; rows with an empty key all pass.

    The rank-one filter runs before the shuffle too, so copies of a hot key
    collapse inside each task.
    """
    keyed = F.coalesce(F.col(key), F.lit("")) != ""
    pick = Window.partitionBy(key).orderBy(*order)
    firsts = rows.where(keyed).withColumn("_rn", F.row_number().over(pick)).where(F.col("_rn") == 1)
    return firsts.drop("_rn").unionByName(rows.where(~keyed))
