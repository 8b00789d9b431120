"""Queries over steps and trace events read the jobs once; what runs alone say reads no jobs."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from spanloom.operators import ci_spans
from spanloom.plans import fixtures as fx
from spanloom.plans.q_ci import written_jobs
from spanloom.plans.q_export import bounds_of, windows_of
from spanloom.sinks import trace_events as chrome

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_naming_rows_read_no_jobs(spark):
    out = entry.queries()["K3_naming_rows"](spark, FOLDER)
    assert "l_orderkey" not in plan_of(out)[0]
    assert {r["name"] for r in out.collect()} == {"process_color", "thread_sort_index"}


def test_steps_stay_with_their_jobs(spark):
    out = entry.queries()["P20_step_spans"](spark, FOLDER)
    assert "Exchange" not in plan_of(out)[1]
    jobs = fx.jobs(spark, FOLDER)
    assert out.count() == fx.steps(spark, FOLDER).where("started_at is not null and completed_at is not null").count() > 3 * jobs.count() - jobs.count()


def test_trace_events_take_nested_steps(spark):
    jobs, repeated = written_jobs(spark, FOLDER, "workflow", "head_sha")
    assert repeated is None
    facts = ci_spans.attempt_facts(jobs, None, "started_at", "_seconds")
    more = fx.sources(spark, FOLDER), fx.review_events(spark, FOLDER), bounds_of(spark, FOLDER)
    windows = windows_of(spark, FOLDER, jobs)
    nested = chrome.trace_events(windows, facts, fx.step_array(), *more)
    apart = chrome.trace_events(windows, facts, ci_spans.step_facts(facts, fx.steps_of(jobs)), *more)
    assert "l_orderkey" not in plan_of(nested)[0]

    def total(df):
        rows = df.withColumn("args", F.to_json(F.map_entries("args")))
        return rows.select(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()

    assert total(nested) == total(apart)
    named = chrome.process_names(windows, fx.sources(spark, FOLDER), bounds_of(spark, FOLDER))
    kept = nested.where("ph = 'M' and tid < 10 and name like 'process%' or name = 'thread_sort_index'")
    assert named.where("name like 'process%' or name = 'thread_sort_index'").count() == kept.count()
