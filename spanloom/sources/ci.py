"""Landed CI API pages and job logs to tables.

Runs, jobs, reviews and pulls get the ``source_id`` of their repository: ``sources``
holds (source_id, owner, repo), one row for each repository (and, for reviews and
pulls, optionally ``pr_number``).  Without it everything belongs to source 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.ids import parse_time
from spanloom.operators.ordered import sliced_window
from spanloom.session import configure

_RUN = (
    "struct<id:bigint,run_attempt:bigint,name:string,path:string,status:string,conclusion:string,created_at:string,"
    "run_started_at:string,updated_at:string,head_sha:string,head_branch:string,event:string,"
    "repository:struct<owner:struct<login:string>,name:string>>"
)
_STEP = "struct<name:string,status:string,conclusion:string,number:int,started_at:string,completed_at:string>"
_JOB = (
    "struct<id:bigint,run_id:bigint,run_attempt:bigint,name:string,status:string,conclusion:string,created_at:string,"
    f"started_at:string,completed_at:string,runner_name:string,html_url:string,steps:array<{_STEP}>>"
)
_USER = "struct<login:string,name:string>"
_REVIEW = f"id bigint, state string, submitted_at string, created_at string, user {_USER}, body string, html_url string, pull_request_url string"
_PULL = (
    "number bigint, title string, head struct<ref:string,sha:string>, base struct<ref:string,sha:string>, merged_at string, "
    f"merged_by {_USER}, changed_files int, additions int, deletions int, html_url string"
)
_COMMIT = (
    "sha string, commit struct<committer:struct<date:string>,author:struct<date:string>>, "
    "stats struct<total:int,additions:int,deletions:int>"
)


def _pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return configure(spark).read.schema(schema).json(path)


def _repository(url: Column) -> list[Column]:
    """Owner and repository of an API or web address."""
    pattern = r"^https?://[^/]+/(?:repos/)?([^/]+)/([^/]+)"
    return [F.regexp_extract(url, pattern, i).alias(n) for i, n in ((1, "owner"), (2, "repo"))]


def _pull_number(*urls: Column) -> Column:
    found = [F.nullif(F.regexp_extract(u, r"/pulls?/(\d+)", 1), F.lit("")).cast("bigint") for u in urls]
    return F.coalesce(*found)


def with_source_id(rows: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Tag rows by owner and repository; rows of no listed repository drop out."""
    if sources is None:
        return rows.withColumn("source_id", F.lit(0))
    by = ["owner", "repo", *(["pr_number"] if {"pr_number"} <= set(sources.columns) & set(rows.columns) else [])]
    return rows.join(sources.select(*by, "source_id").dropDuplicates(by), by)


def _times(col: Column, *names: str) -> list[Column]:
    return [parse_time(col[n]).alias(n) for n in names]


def runs_of(pages: DataFrame) -> DataFrame:
    r = F.col("r")
    return pages.select(F.explode("workflow_runs").alias("r")).select(
        r["id"].alias("run_id"), r["run_attempt"].alias("run_attempt"), r["name"].alias("name"), r["path"].alias("path"),
        r["status"].alias("status"), r["conclusion"].alias("conclusion"),
        *_times(r, "created_at", "run_started_at", "updated_at"),
        r["head_sha"].alias("head_sha"), r["head_branch"].alias("head_branch"), r["event"].alias("event"),
        r["repository"]["owner"]["login"].alias("owner"), r["repository"]["name"].alias("repo"),
    )


RUN_PAGE = f"total_count bigint, workflow_runs array<{_RUN}>"
JOB_PAGE = f"jobs array<{_JOB}>"


def read_runs(spark: SparkSession, path: str, sources: DataFrame | None = None) -> DataFrame:
    return with_source_id(runs_of(_pages(spark, path, RUN_PAGE)), sources)


def jobs_of(pages: DataFrame) -> DataFrame:
    j = F.col("j")
    return pages.select(F.explode("jobs").alias("j")).select(
        j["run_id"].alias("run_id"), j["id"].alias("job_id"), j["run_attempt"].alias("run_attempt"), j["name"].alias("name"),
        j["status"].alias("status"), j["conclusion"].alias("conclusion"),
        *_times(j, "created_at", "started_at", "completed_at"),
        j["runner_name"].alias("runner_name"), j["html_url"].alias("html_url"), j["steps"].alias("steps"),
    )


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs with their nested steps; they belong to the source of their run."""
    return jobs_of(_pages(spark, path, JOB_PAGE))


def steps_of(jobs: DataFrame) -> DataFrame:
    """Nested steps of jobs as rows."""
    s = F.col("s")
    return jobs.select("run_id", "job_id", "run_attempt", "html_url", F.explode("steps").alias("s")).select(
        "run_id", "job_id", "run_attempt", "html_url", s["number"].alias("number"), s["name"].alias("name"),
        s["status"].alias("status"), s["conclusion"].alias("conclusion"), *_times(s, "started_at", "completed_at"),
    )


def _user(user: Column) -> Column:
    return F.coalesce(F.nullif(user["login"], F.lit("")), user["name"])


def read_reviews(spark: SparkSession, path: str, sources: DataFrame | None = None) -> DataFrame:
    """Reviews or comments: both have one shape, comments carry ``created_at``."""
    url = F.coalesce("pull_request_url", "html_url")
    return with_source_id(_pages(spark, path, _REVIEW).select(
        *_repository(url), _pull_number(F.col("pull_request_url"), F.col("html_url")).alias("pr_number"),
        F.col("id").alias("review_id"), "state", parse_time(F.coalesce("submitted_at", "created_at")).alias("submitted_at"),
        _user(F.col("user")).alias("user"), "body", F.coalesce("html_url", "pull_request_url").alias("url"),
    ), sources).drop("owner", "repo")


read_comments = read_reviews


def read_pulls(spark: SparkSession, path: str, sources: DataFrame | None = None) -> DataFrame:
    return with_source_id(_pages(spark, path, _PULL).select(
        *_repository(F.col("html_url")),
        F.col("number").alias("pr_number"), F.col("title").alias("pr_title"), F.col("head.sha").alias("head_sha"),
        F.col("head.ref").alias("branch"), F.col("base.ref").alias("base_ref"), parse_time(F.col("merged_at")).alias("merged_at"),
        _user(F.col("merged_by")).alias("user"), "changed_files", "additions", "deletions", F.col("html_url").alias("url"),
    ), sources).drop("owner", "repo")


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    return _pages(spark, path, _COMMIT).select(
        F.col("sha").alias("head_sha"), parse_time(F.col("commit.committer.date")).alias("committer_date"),
        parse_time(F.col("commit.author.date")).alias("author_date"), F.col("stats.total").alias("changed_files"),
        F.col("stats.additions").alias("additions"), F.col("stats.deletions").alias("deletions"),
    )


def read_check_runs(spark: SparkSession, path: str) -> DataFrame:
    schema = "head_sha string, check_runs array<struct<id:bigint,name:string,status:string,conclusion:string,head_sha:string>>"
    return _pages(spark, path, schema).select("head_sha", F.explode("check_runs").alias("c")).select(
        F.col("c.id").alias("check_run_id"), F.coalesce("c.head_sha", "head_sha").alias("head_sha"), "c.name", "c.status", "c.conclusion"
    )


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return _pages(spark, path, (
        "check_run_id bigint, path string, start_line int, end_line int, annotation_level string, message string, title string"
    ))


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "run_id bigint, artifacts array<struct<id:bigint,name:string,size_in_bytes:bigint,archive_download_url:string,"
        "expired:boolean,workflow_run:struct<id:bigint>>>"
    )
    return _pages(spark, path, schema).select("run_id", F.explode("artifacts").alias("a")).select(
        F.coalesce("run_id", "a.workflow_run.id").alias("run_id"), F.col("a.id").alias("artifact_id"), "a.name",
        "a.size_in_bytes", "a.archive_download_url", "a.expired",
    )


def read_timing(spark: SparkSession, path: str) -> DataFrame:
    schema = "run_id bigint, billable map<string,struct<total_ms:bigint>>"
    return _pages(spark, path, schema).select("run_id", F.explode("billable").alias("os", "b")).select(
        "run_id", "os", F.col("b.total_ms").alias("total_ms")
    )


def read_protection(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "source_id int, required_status_checks struct<contexts:array<string>,checks:array<struct<context:string>>>"
    )
    checks = F.col("required_status_checks")
    return _pages(spark, path, schema).select(
        "source_id", checks["contexts"].alias("contexts"), F.transform(checks["checks"], lambda c: c["context"]).alias("checks")
    )


def read_job_logs(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of log files named after their job: (job_id, pos, line).

    Files are split like any text.  File order comes from the block a line lies
    in and its place in that block, so a huge log is read by many tasks.
    """
    meta = F.col("_metadata")
    rows = configure(spark).read.text(path).select(
        F.regexp_extract(meta["file_name"], r"(\d+)", 1).cast("bigint").alias("job_id"),
        meta["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"),
    )
    numbered = sliced_window(rows, ["job_id"], "_block", ["_at"], sums={"pos": F.lit(1)})
    return numbered.select("job_id", "pos", "line")
