import datetime as dt

import pytest
from pyspark.sql import functions as F

from spanloom.operators import trends
from spanloom.schemas import JOBS, RUNS, columns, conform

DAY = dt.datetime(2024, 1, 1)


def runs_of(spark, seconds, conclusions=None):
    rows = []
    for i, s in enumerate(seconds):
        at = DAY + dt.timedelta(hours=i)
        rows.append((i + 1, at, at + dt.timedelta(seconds=s), (conclusions or ["success"] * len(seconds))[i]))
    df = spark.createDataFrame(rows, "run_id bigint, created_at timestamp, updated_at timestamp, conclusion string")
    return conform(df.withColumns({"run_attempt": F.lit(1), "status": F.lit("completed"), "head_sha": F.concat(F.lit("sha"), "run_id"),
                                   "owner": F.lit("o"), "repo": F.lit("r"), "source_id": F.lit(0)}), RUNS)


def jobs_of(spark, runs, seconds, conclusions=None, name="test"):
    rows = []
    for i, s in enumerate(seconds):
        at = DAY + dt.timedelta(hours=i)
        end = at + dt.timedelta(seconds=s + 1)
        rows.append((i + 1, 100 + i, at, at + dt.timedelta(seconds=1), end, (conclusions or ["success"] * len(seconds))[i], f"u{i}"))
    df = spark.createDataFrame(rows, "run_id bigint, job_id bigint, created_at timestamp, started_at timestamp, completed_at timestamp, conclusion string, html_url string")
    return trends.run_jobs(runs, conform(df.withColumns({"name": F.lit(name), "status": F.lit("completed"), "run_attempt": F.lit(0)}), JOBS))


def test_schema_columns_keep_nested_commas():
    assert columns("a int, b map<string,int>, c struct<x:int,y:decimal(3,2)>")[1:] == [("b", "map<string,int>"), ("c", "struct<x:int,y:decimal(3,2)>")]


@pytest.mark.parametrize("seconds,direction", [([100, 100, 50, 50], "improving"), ([50, 50, 100, 100], "degrading"), ([60], "stable")])
def test_direction(spark, seconds, direction):
    row = trends.trend_summary(runs_of(spark, seconds)).first()
    assert row["trend_direction"] == direction
    assert row["avg_duration"] == pytest.approx(sum(seconds) / len(seconds))
    assert row["avg_success_rate"] == 100


def test_odd_row_goes_to_the_second_half(spark):
    row = trends.half_means(trends.run_durations(runs_of(spark, [10, 20, 30, 40, 60])), [], ["created_at", "run_id"], "duration_ms").first()
    assert (row["first_avg"], row["second_avg"]) == (15, pytest.approx(130 / 3))


@pytest.mark.parametrize("seconds,index,before,after", [([10] * 5 + [20] * 5, 5, 10, 20), ([10] * 3 + [20] * 7, 3, 10, 20)])
def test_changepoint(spark, seconds, index, before, after):
    runs = runs_of(spark, seconds)
    row = trends.changepoints(jobs_of(spark, runs, seconds)).first()
    assert (row["index"], row["total_points"], row["before_avg"], row["after_avg"]) == (index, 10, before, after)
    assert row["before_sha"] == f"sha{index}" and row["after_sha"] == f"sha{index + 1}"
    assert row["diff_url"] == f"https://github.com/o/r/compare/sha{index}...sha{index + 1}"


def test_changepoint_needs_six(spark):
    runs = runs_of(spark, [10] * 5)
    assert trends.changepoints(jobs_of(spark, runs, [10] * 5)).count() == 0


def test_changes_and_urls(spark):
    seconds = [10, 10, 10, 20, 20, 20]
    runs = runs_of(spark, seconds)
    row = trends.job_changes(jobs_of(spark, runs, seconds)).first()
    assert (row["kind"], row["percent"], row["urls"]) == ("regression", 100, ["u5", "u4", "u3"])


def test_flaky_threshold_is_strict(spark):
    for failures, kept in ((1, 0), (2, 1)):
        ends = ["failure"] * failures + ["success"] * (10 - failures)
        runs = runs_of(spark, [10] * 10)
        rows = trends.flaky_jobs(jobs_of(spark, runs, [10] * 10, ends)).collect()
        assert len(rows) == kept
    assert (rows[0]["recent_failures"], rows[0]["failure_count"], rows[0]["urls"]) == (2, 2, ["u1", "u0"])


def test_flaky_needs_five(spark):
    runs = runs_of(spark, [10] * 4)
    assert trends.flaky_jobs(jobs_of(spark, runs, [10] * 4, ["failure"] * 4)).count() == 0


def test_old_attempts_are_left_out(spark):
    runs = runs_of(spark, [10]).withColumn("run_attempt", F.lit(2).cast("bigint"))
    jobs = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 0)], "run_id bigint, job_id bigint, run_attempt bigint")
    assert sorted(r["job_id"] for r in trends.run_jobs(runs, conform(jobs, JOBS)).collect()) == [2, 3]


def test_queue_stats_are_zero_without_queue(spark):
    runs = runs_of(spark, [10])
    jobs = jobs_of(spark, runs, [10]).withColumn("queue_ms", F.lit(0).cast("bigint"))
    assert set(trends.queue_stats(jobs).first()) == {0.0}


def test_sample_sizes():
    assert trends.sample_size(0) == 0
    assert trends.sample_size(10) == 10
    assert trends.sample_size(1000) == 88
    assert trends.sample_size(1000, 0.99, 0.05) == 400
    assert trends.sampling_plan(100)["enabled"] is False
    plan = trends.sampling_plan(12345)
    assert plan["enabled"] and plan["rationale"].startswith("12,345 runs analyzed. 96 sampled")


def test_sample_is_exact_and_repeatable(spark):
    runs = runs_of(spark, [10] * 200)
    first = sorted(r["run_id"] for r in trends.stratified_sample(runs, 37).collect())
    again = sorted(r["run_id"] for r in trends.stratified_sample(runs.repartition(3), 37).collect())
    assert first == again and len(first) == len(set(first)) == 37
    same = runs.withColumn("created_at", F.lit(DAY))
    assert trends.stratified_sample(same, 11).count() == 11


def test_analyze_trends_parts(spark):
    seconds = [10] * 5 + [20] * 5
    runs = runs_of(spark, seconds)
    jobs = spark.createDataFrame(
        [(i + 1, 100 + i, DAY, DAY, DAY + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)],
        "run_id bigint, job_id bigint, created_at timestamp, started_at timestamp, completed_at timestamp",
    )
    jobs = conform(jobs.withColumn("name", F.lit("j")), JOBS)
    parts = trends.analyze_trends(runs, jobs, dt.date(2024, 1, 3))
    assert parts["summary"].first()["total_runs"] == 10
    assert parts["regressions"].first()["name"] == "j" and parts["improvements"].count() == 0
    with pytest.raises(ValueError):
        trends.analyze_trends(runs, jobs, dt.date(2030, 1, 1))


def test_changepoints_are_told_from_where_they_were_found(spark):
    # two names, one of them with another commit and address in every run; the jump is after the sixth run
    rows = [
        (name, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, i, 1000 + 9000 * (i > 6), f"{name}{i}", f"u{name}{i}", "o", "r")
        for name in "ab" for i in range(1, 13)
    ] + [("c", dt.datetime(2024, 1, 1), 1, 1, 1000, "c1", None, "o", "r")]
    jobs = spark.createDataFrame(
        rows, "name string, run_created_at timestamp, run_id long, job_id long, duration_ms long, head_sha string, html_url string, owner string, repo string"
    ).repartition(3)
    obs = trends.job_observations(jobs, ["name"])
    # wide rows are read where they were written: only ranks and durations travel
    assert "LogicalRDD" not in obs._jdf.queryExecution().optimizedPlan().toString() and "prev_sha" not in obs.columns
    out = {r["name"]: r for r in trends.changepoints(jobs).collect()}
    assert sorted(out) == ["a", "b"]
    for name, r in out.items():
        assert (r["total_points"], r["index"], r["before_sha"], r["after_sha"]) == (12, 6, f"{name}6", f"{name}7")
        assert (r["before_run_url"], r["after_run_url"], r["before_avg"], r["after_avg"]) == (f"u{name}6", f"u{name}7", 1.0, 10.0)
        assert r["date"] == dt.datetime(2024, 1, 1, 7) and r["diff_url"].endswith(f"/compare/{name}6...{name}7")
