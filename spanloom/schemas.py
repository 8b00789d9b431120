"""Table schemas and the JSON schemas of the supported payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import ids

SPANS = (
    "source_id int, trace_id string, span_id string, parent_span_id string, name string, kind string, "
    "start_ns bigint, end_ns bigint, start_time timestamp, end_time timestamp, "
    "attrs map<string,string>, attr_types map<string,string>, resource map<string,string>, "
    "scope_name string, scope_version string, status_code string, status_message string, "
    "events array<struct<name:string,time_ns:bigint,attrs:map<string,string>>>, "
    "links array<struct<trace_id:string,span_id:string,attrs:map<string,string>>>, seq bigint"
)
RUNS = (
    "source_id int, run_id bigint, run_attempt bigint, name string, path string, status string, "
    "conclusion string, created_at timestamp, run_started_at timestamp, updated_at timestamp, "
    "head_sha string, head_branch string, event string, owner string, repo string"
)
JOBS = (
    "source_id int, run_id bigint, job_id bigint, run_attempt bigint, name string, status string, "
    "conclusion string, created_at timestamp, started_at timestamp, completed_at timestamp, "
    "runner_name string, html_url string"
)
STEPS = (
    "source_id int, run_id bigint, job_id bigint, run_attempt bigint, number int, name string, "
    "status string, conclusion string, started_at timestamp, completed_at timestamp, html_url string"
)
REVIEW_EVENTS = (
    "source_id int, type string, state string, time timestamp, user string, url string, "
    "pr_number bigint, pr_title string"
)
SOURCES = (
    "source_id int, owner string, repo string, type string, identifier string, head_sha string, "
    "branch string, display_name string, display_url string, merged_at timestamp, "
    "commit_time timestamp, pushed_at timestamp, changed_files int, additions int, deletions int"
)
LOG_LINES = "job_id bigint, line_num int, ts_100ns bigint, ts timestamp, content string"

_EMPTY = {
    "kind": "UNSPECIFIED",
    "status_code": "UNSET",
    "status_message": "",
    "scope_name": "",
    "scope_version": "",
}


def columns(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a DDL schema; commas inside types are kept."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append((name, kind))
            start = i + 1
    return out


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Select the schema's columns, filling missing ones with typed nulls."""
    return df.select(*_typed(df, ddl))


def _typed(df: DataFrame, ddl: str) -> list[Column]:
    have = set(df.columns)
    return [(F.col(name) if name in have else F.lit(None)).cast(kind).alias(name) for name, kind in columns(ddl)]


def conform_spans(df: DataFrame, *more: str) -> DataFrame:
    """Span rows with every column present and times derived from nanoseconds; ``more`` columns stay."""
    have = set(df.columns)
    out = df.withColumns({k: F.lit(v) for k, v in _EMPTY.items() if k not in have})
    out = out.withColumns(
        {
            "start_time": ids.ns_to_time(F.col("start_ns")),
            "end_time": ids.ns_to_time(F.col("end_ns")),
        }
    )
    empty_map = F.create_map().cast("map<string,string>")
    for name in ("attrs", "attr_types", "resource"):
        if name not in have:
            out = out.withColumn(name, empty_map)
    return out.select(*_typed(out, SPANS), *[F.col(f"`{c}`") for c in more])
