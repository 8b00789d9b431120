"""Landed API pages are compressed, and spelled only when the rows of a page are together."""

import glob

from spanloom.plans import fixtures as fx
from spanloom.plans import q_landed

SF = "/root/testdata/sf0.001"


def test_job_pages(spark, monkeypatch):
    folders = []
    landing = q_landed.landing
    monkeypatch.setattr(q_landed, "landing", lambda s, name: folders.append(landing(s, name)) or folders[-1])
    facts = q_landed.landed_ci_pages(spark, SF)
    assert facts.count() == fx.jobs(spark, SF).count()
    files = [f for folder in folders for f in glob.glob(f"{folder.removeprefix('file:')}/part-*")]
    assert len(folders) == 2 and files and all(f.endswith(".lz4") for f in files)


def test_times_are_spelled_after_the_shuffle(spark):
    pages = q_landed.job_pages(spark, SF)
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" not in plan[plan.index("Aggregate"):]
    times = {x[:4] + x[19:20] + x[23:] for r in pages.limit(50).collect() for x in r["text"].split('"') if x.endswith("Z") and x[4:5] == "-" and len(x) == 24}
    assert times and all(t.endswith(".Z") for t in times)
