"""What the pipeline's stages ask of the driver: plans, jobs and broadcasts stay few."""

import pytest

from spanloom.llm import decontaminate, jaccard, mixing

from .conftest import table


def counted(monkeypatch, module):
    """Names of the tables that ``module`` writes from now on."""
    names, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or write(df, name))
    return names


@pytest.mark.parametrize(("edges", "rounds"), [([], 0), ([(2, 1), (3, 1), (5, 4), (4, 4)], 0), ([(2, 1), (3, 2), (4, 3)], 1), ([(3, 1), (3, 2)], 1)])
def test_stars_take_no_round(spark, monkeypatch, edges, rounds):
    names = counted(monkeypatch, jaccard)
    found = dict(map(tuple, jaccard.components(table(spark, edges, "a long, b long")).collect()))
    assert (len(names) - 1 >= rounds) if rounds else len(names) == 1
    assert found == {n: (4 if n == 5 else 1) for n in {x for e in edges for x in e} if n not in (1, 4) or (n == 4 and rounds)}


def test_steps_are_planned_once(spark, monkeypatch):
    """What several steps read is written, so that no plan holds it more than once."""
    text = " ".join(f"word{i}" for i in range(30))
    docs = table(spark, [(1, text, "a"), (2, "some other text of seven words here", "b")], "doc_id long, text string, source string")
    names = counted(monkeypatch, decontaminate)
    assert [r["doc_id"] for r in decontaminate.clean(docs, table(spark, [(7, text)], "item_id long, text string")).collect()] == [2]
    assert names == ["items", "windows"]
    names = counted(monkeypatch, mixing)
    assert {r["source"] for r in mixing.mix(docs).collect()} == {"a", "b"}
    assert "targets" in names
