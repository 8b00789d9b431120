"""Registered trend queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from spanloom.operators import trends
from spanloom.plans import fixtures as fx
from spanloom.plans.registry import query

DIGITS = 6


def r(name: str, digits: int = DIGITS):
    return F.round(F.col(name), digits).alias(name)


def joined(name: str):
    return F.array_join(name, " ").alias(name)


def jobs_of(spark, folder):
    return trends.run_jobs(fx.runs(spark, folder), fx.clean_jobs(spark, folder))


RANKED_RUNS = """
WITH v AS (SELECT *, row_number() OVER (ORDER BY created_ms, run_id) AS rn, count(*) OVER () AS n
           FROM runs WHERE duration_ms > 0),
h AS (SELECT sum(CASE WHEN rn <= n // 2 THEN duration_ms END) / count(CASE WHEN rn <= n // 2 THEN 1 END) / 1000.0 AS a,
             sum(CASE WHEN rn > n // 2 THEN duration_ms END) / count(CASE WHEN rn > n // 2 THEN 1 END) / 1000.0 AS b FROM v)
"""


@query("T1_T3_W4_trend_summary", ["runs"], RANKED_RUNS + """
SELECT CAST((SELECT count(*) FROM runs) AS BIGINT) AS total_runs,
  round((SELECT sum(duration_ms) / count(*) / 1000.0 FROM v), 6) AS avg_duration,
  round((SELECT median(duration_ms) / 1000.0 FROM v), 6) AS median_duration,
  round((SELECT quantile_disc(duration_ms, 0.95) / 1000.0 FROM v), 6) AS p95_duration,
  round((SELECT count(CASE WHEN conclusion = 'success' THEN 1 END) * 100.0 / count(*) FROM runs), 6) AS avg_success_rate,
  round((b - a) / a * 100, 6) AS percent_change,
  CASE WHEN (b - a) / a * 100 < -5 THEN 'improving' WHEN (b - a) / a * 100 > 5 THEN 'degrading' ELSE 'stable' END AS trend_direction
FROM h""")
def trend_summary(spark, folder):
    out = trends.trend_summary(fx.runs(spark, folder))
    return out.select(
        "total_runs", r("avg_duration"), r("median_duration"), r("p95_duration"),
        r("avg_success_rate"), r("percent_change"), "trend_direction",
    )


@query("T1_trend_summary_by_branch", ["runs"], """
WITH v AS (SELECT *, row_number() OVER (PARTITION BY head_branch ORDER BY created_ms, run_id) AS rn,
             count(*) OVER (PARTITION BY head_branch) AS n FROM runs WHERE duration_ms > 0),
g AS (SELECT head_branch, sum(duration_ms) / count(*) / 1000.0 AS avg_duration, median(duration_ms) / 1000.0 AS median_duration,
        quantile_disc(duration_ms, 0.95) / 1000.0 AS p95_duration,
        sum(CASE WHEN rn <= n // 2 THEN duration_ms END) / count(CASE WHEN rn <= n // 2 THEN 1 END) / 1000.0 AS a,
        sum(CASE WHEN rn > n // 2 THEN duration_ms END) / count(CASE WHEN rn > n // 2 THEN 1 END) / 1000.0 AS b
      FROM v GROUP BY 1),
t AS (SELECT head_branch, count(*) AS total_runs FROM runs GROUP BY 1)
SELECT head_branch, total_runs, round(avg_duration, 6) AS avg_duration, round(median_duration, 6) AS median_duration,
  round(p95_duration, 6) AS p95_duration, round((b - a) / a * 100, 6) AS percent_change,
  CASE WHEN (b - a) / a * 100 < -5 THEN 'improving' WHEN (b - a) / a * 100 > 5 THEN 'degrading' ELSE 'stable' END AS trend_direction
FROM g JOIN t USING (head_branch)""")
def trend_summary_by_branch(spark, folder):
    out = trends.trend_summary(fx.runs(spark, folder), ["head_branch"])
    return out.select(
        "head_branch", "total_runs", r("avg_duration"), r("median_duration"), r("p95_duration"),
        r("percent_change"), "trend_direction",
    )


@query("T2_daily_series", ["runs"], """
SELECT strftime(make_timestamp(created_ms * 1000), '%Y-%m-%d') AS day,
  round(sum(CASE WHEN duration_ms > 0 THEN duration_ms END) / count(CASE WHEN duration_ms > 0 THEN 1 END) / 1000.0, 6) AS duration,
  CAST(count(CASE WHEN duration_ms > 0 THEN 1 END) AS BIGINT) AS timed_runs,
  round(count(CASE WHEN conclusion = 'success' THEN 1 END) * 100.0 / count(*), 6) AS success_rate, count(*) AS runs
FROM runs GROUP BY 1""")
def daily_series(spark, folder):
    runs = fx.runs(spark, folder)
    took = trends.duration_series(runs).withColumnsRenamed({"value": "duration", "count": "timed_runs"})
    won = trends.success_series(runs).withColumnsRenamed({"value": "success_rate", "count": "runs"})
    return won.join(took, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), r("duration"), "timed_runs", r("success_rate"), "runs"
    )


JOB_HALVES = """
v AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY run_created_ms, run_id, job_id) AS rn,
        count(*) OVER (PARTITION BY name) AS n FROM run_jobs WHERE duration_ms > 0),
g AS (SELECT name, count(*) AS n, sum(duration_ms) / count(*) / 1000.0 AS avg_duration, median(duration_ms) / 1000.0 AS median_duration,
        sum(CASE WHEN rn <= n // 2 THEN duration_ms END) / count(CASE WHEN rn <= n // 2 THEN 1 END) / 1000.0 AS a,
        sum(CASE WHEN rn > n // 2 THEN duration_ms END) / count(CASE WHEN rn > n // 2 THEN 1 END) / 1000.0 AS b
      FROM v GROUP BY 1)
"""


@query("T4_L8_W6_job_trends", ["run_jobs"], "WITH " + JOB_HALVES + """,
t AS (SELECT name, count(*) AS total_runs, count(CASE WHEN conclusion = 'success' THEN 1 END) * 100.0 / count(*) AS success_rate
      FROM run_jobs GROUP BY 1),
u AS (SELECT name, string_agg(html_url, ' ' ORDER BY k) AS urls FROM (
        SELECT name, html_url, row_number() OVER (PARTITION BY name ORDER BY run_created_ms DESC, run_id DESC, job_id DESC) AS k
        FROM run_jobs WHERE html_url <> '') WHERE k <= 5 GROUP BY 1)
SELECT t.name, round(avg_duration, 6) AS avg_duration, round(median_duration, 6) AS median_duration,
  round(success_rate, 6) AS success_rate, total_runs,
  CASE WHEN n < 4 THEN 'stable' WHEN (b - a) / a * 100 < -5 THEN 'improving' WHEN (b - a) / a * 100 > 5 THEN 'degrading'
    ELSE 'stable' END AS trend_direction, urls
FROM t JOIN g USING (name) JOIN u USING (name) ORDER BY avg_duration DESC, name""")
def job_trends(spark, folder):
    out = trends.job_trends(jobs_of(spark, folder)).orderBy(F.col("avg_duration").desc(), "name")
    return out.select(
        "name", r("avg_duration"), r("median_duration"), r("success_rate"), "total_runs",
        "trend_direction", joined("urls"),
    )


@query("T5_W5_flaky_jobs", ["run_jobs"], """
WITH t AS (SELECT name, count(*) AS total_runs, count(CASE WHEN conclusion = 'success' THEN 1 END) AS success_count,
    count(CASE WHEN conclusion = 'failure' THEN 1 END) AS failure_count,
    max(CASE WHEN conclusion = 'failure' THEN completed_ms END) AS last_failure_ms FROM run_jobs GROUP BY 1),
k AS (SELECT name, count(CASE WHEN conclusion = 'failure' THEN 1 END) AS recent_failures FROM (
    SELECT name, conclusion, row_number() OVER (PARTITION BY name ORDER BY completed_ms DESC NULLS LAST, job_id DESC) AS k
    FROM run_jobs) WHERE k <= 10 GROUP BY 1),
u AS (SELECT name, string_agg(html_url, ' ' ORDER BY k) AS urls FROM (
    SELECT name, html_url, row_number() OVER (PARTITION BY name ORDER BY completed_ms DESC, job_id DESC) AS k
    FROM run_jobs WHERE html_url <> '' AND conclusion = 'failure') WHERE k <= 5 GROUP BY 1)
SELECT name, total_runs, success_count, failure_count, round(failure_count * 100.0 / total_runs, 6) AS flake_rate,
  recent_failures, last_failure_ms, urls
FROM t JOIN k USING (name) JOIN u USING (name) WHERE total_runs >= 5 AND failure_count * 100.0 / total_runs > 10""")
def flaky_jobs(spark, folder):
    out = trends.flaky_jobs(jobs_of(spark, folder))
    return out.select(
        "name", "total_runs", "success_count", "failure_count", r("flake_rate"), "recent_failures",
        F.unix_millis("last_failure").alias("last_failure_ms"), joined("urls"),
    )


CHANGES = "WITH " + JOB_HALVES + """,
c AS (SELECT g.*, (b - a) / a * 100 AS pct FROM g WHERE n // 2 >= 2),
u AS (SELECT name, string_agg(html_url, ' ' ORDER BY k) AS urls FROM (
    SELECT name, html_url, row_number() OVER (PARTITION BY name ORDER BY rn DESC) AS k
    FROM v WHERE html_url <> '' AND rn > n // 2) WHERE k <= 5 GROUP BY 1)
"""


@query("T6_job_changes", ["run_jobs"], CHANGES + """
SELECT name, CASE WHEN pct > 0 THEN 'regression' ELSE 'improvement' END AS kind, round(a, 6) AS old_avg, round(b, 6) AS new_avg,
  round(abs(pct), 6) AS percent, round(abs(b - a), 6) AS absolute_change, urls
FROM c JOIN u USING (name) WHERE abs(pct) >= 10""")
def job_changes(spark, folder):
    out = trends.job_changes(jobs_of(spark, folder))
    return out.select(
        "name", "kind", r("old_avg"), r("new_avg"), r("percent"), r("absolute_change"), joined("urls")
    )


@query("L4_top_changes", ["run_jobs"], CHANGES + """
SELECT * FROM (SELECT name, 'regression' AS kind, round(pct, 6) AS percent FROM c WHERE pct >= 10 ORDER BY pct DESC, name LIMIT 10)
UNION ALL
SELECT * FROM (SELECT name, 'improvement' AS kind, round(-pct, 6) AS percent FROM c WHERE pct <= -10 ORDER BY pct, name LIMIT 10)""")
def top_changes(spark, folder):
    found = trends.job_changes(jobs_of(spark, folder))
    both = trends.top_changes(found, "regression").unionByName(trends.top_changes(found, "improvement"))
    return both.select("name", "kind", r("percent"))


@query("T7_P27_changepoints", ["run_jobs"], "WITH " + JOB_HALVES + """,
p AS (SELECT *, sum(duration_ms) OVER w AS upto, sum(duration_ms) OVER (PARTITION BY name) AS total,
    lag(head_sha) OVER w AS prev_sha FROM v WINDOW w AS (PARTITION BY name ORDER BY rn)),
s AS (SELECT *, rn - 1 AS i, CAST(upto - duration_ms AS DOUBLE) AS before FROM p),
q AS (SELECT *, (before - i * (CAST(total AS DOUBLE) / n)) * (before - i * (CAST(total AS DOUBLE) / n)) / (i * (n - i)) AS gain
    FROM s WHERE i >= 3 AND i <= n - 3),
b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY gain DESC, i) AS k FROM q)
SELECT name, n AS total_points, CAST(i AS BIGINT) AS index, run_created_ms AS date_ms, prev_sha AS before_sha, head_sha AS after_sha,
  round(before / i / 1000.0, 6) AS before_avg, round((total - before) / (n - i) / 1000.0, 6) AS after_avg,
  'https://github.com/' || owner || '/' || repo || '/compare/' || prev_sha || '...' || head_sha AS diff_url
FROM b WHERE k = 1""")
def changepoints(spark, folder):
    out = trends.changepoints(jobs_of(spark, folder))
    return out.select(
        "name", "total_points", "index", F.unix_millis("date").alias("date_ms"), "before_sha",
        "after_sha", r("before_avg"), r("after_avg"), "diff_url",
    )


@query("T10_queue_stats", ["run_jobs"], """
SELECT round(avg_q, 6) AS avg_queue_time, round(med_q, 6) AS median_queue_time, round(p95_q, 6) AS p95_queue_time,
  round(avg_r, 6) AS avg_run_time, round(med_r, 6) AS median_run_time, round(avg_q / (avg_q + avg_r) * 100, 6) AS queue_time_ratio
FROM (SELECT sum(queue_ms) / count(*) / 1000.0 AS avg_q, median(queue_ms) / 1000.0 AS med_q,
        quantile_disc(queue_ms, 0.95) / 1000.0 AS p95_q FROM run_jobs WHERE queue_ms > 0),
     (SELECT sum(duration_ms) / count(*) / 1000.0 AS avg_r, median(duration_ms) / 1000.0 AS med_r FROM run_jobs WHERE duration_ms > 0)""")
def queue_stats(spark, folder):
    out = trends.queue_stats(jobs_of(spark, folder))
    return out.select(*[r(c) for c in out.columns])


@query("T8_T11_sampling_info", ["runs"], """
WITH c AS (SELECT count(*) AS n FROM runs),
z AS (SELECT n, CAST(least(n, greatest(least(80, n), ceil((1.96 * 1.96 * 0.25 / 0.01) / (1 + (1.96 * 1.96 * 0.25 / 0.01 - 1) / n)))) AS BIGINT) AS size FROM c)
SELECT size < n * 3 // 4 AS enabled, CASE WHEN size < n * 3 // 4 THEN size ELSE n END AS sample_size, n AS total_runs,
  CAST(0.95 AS DOUBLE) AS confidence, CAST(0.1 AS DOUBLE) AS margin_of_error FROM z""")
def sampling_info(spark, folder):
    return trends.sampling_info(fx.runs(spark, folder)).drop("rationale")


@query("T9_stratified_sample", ["runs"], """
WITH b AS (SELECT run_id, least(CAST(floor((created_ms - min(created_ms) OVER ()) / CAST(max(created_ms) OVER () - min(created_ms) OVER () AS DOUBLE) * 10) AS INTEGER), 9) AS bucket FROM runs),
k AS (SELECT run_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5(CAST(run_id AS VARCHAR)), run_id) AS rn FROM b),
q AS (SELECT bucket, count(*) AS n, CAST(floor(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM runs) * 600 + 0.5) AS BIGINT) AS quota FROM b GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n - quota DESC, bucket) AS up, row_number() OVER (ORDER BY quota DESC, bucket) AS down,
   (SELECT 600 - sum(quota) FROM q) AS rest FROM q),
f AS (SELECT bucket, quota + CASE WHEN rest > 0 AND up <= rest THEN 1 WHEN rest < 0 AND down <= -rest THEN -1 ELSE 0 END AS quota FROM o)
SELECT run_id, CAST(k.bucket AS INTEGER) AS bucket FROM k JOIN f USING (bucket) WHERE rn <= quota""")
def stratified_sample(spark, folder):
    runs = fx.runs(spark, folder)
    low, high = runs.agg(F.min(F.unix_millis("created_at")), F.max(F.unix_millis("created_at"))).first()
    picked = trends.stratified_sample(runs, 600)
    return trends.with_time_bucket(picked, low, high, 10).select("run_id", F.col("_bucket").alias("bucket"))


@query("T12_analyze_trends", ["run_jobs"], "WITH " + """
chosen AS (SELECT * FROM runs WHERE created_ms >= epoch_ms(TIMESTAMP '2000-01-01') AND head_branch = 'BUILDING' AND path LIKE '%2-high.yml'),
j AS (SELECT rj.* FROM run_jobs rj JOIN chosen c ON rj.run_id = c.run_id),
t AS (SELECT name, count(*) AS n, count(CASE WHEN conclusion = 'failure' THEN 1 END) AS f FROM j GROUP BY 1)
SELECT 'runs' AS part, CAST(count(*) AS BIGINT) AS "rows" FROM chosen
UNION ALL SELECT 'job_trends', count(DISTINCT name) FROM j
UNION ALL SELECT 'flaky_jobs', count(*) FROM t WHERE n >= 5 AND f * 100.0 / n > 10
UNION ALL SELECT 'duration_trend', count(DISTINCT created_ms) FROM chosen WHERE duration_ms > 0
UNION ALL SELECT 'success_trend', count(DISTINCT created_ms) FROM chosen""")
def analyze(spark, folder):
    parts = trends.analyze_trends(
        fx.runs(spark, folder), fx.clean_jobs(spark, folder), dt.date(2002, 12, 31), days=1095,
        branch="BUILDING", workflow="2-high.yml", sample=False,
    )
    out = parts["summary"].select(F.lit("runs").alias("part"), F.col("total_runs").alias("rows"))
    for name in ("job_trends", "flaky_jobs", "duration_trend", "success_trend"):
        count = parts[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = out.unionByName(count)
    return out
