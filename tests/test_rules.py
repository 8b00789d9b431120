"""The rule index against the CASE form and row by row."""

import random

from pyspark.sql import functions as F

from spanloom.operators import enrich, rules


def meets(value, pattern):
    if value is None:
        return False
    if pattern == "*":
        return True
    if pattern.startswith("*") and pattern.endswith("*"):
        return pattern[1:-1] in value
    if pattern.startswith("*"):
        return value.endswith(pattern[1:])
    if pattern.endswith("*"):
        return value.startswith(pattern[:-1])
    return value == pattern


def first(name, attrs, many):
    for i, rule in enumerate(many):
        own = rules.conditions(rule)
        if own and all(meets(name if k == rules.NAME else attrs.get(k), p) for k, p in own):
            return i
    return None


def some_rules(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abc", k=r.randint(1, 3)))
    pattern = lambda: r.choice(["{}", "{}*", "*{}", "*{}*", "*", "**", ""]).format(word())
    out = []
    for i in range(n):
        match = {"attributes": {f"k{r.randrange(3)}": pattern() for _ in range(r.randrange(3))}}
        if r.random() < 0.5:
            match["span_name"] = pattern()
        out.append({"match": match, "hints": {"category": r.choice(["", f"c{i}"]), "is_leaf": i % 2 == 0}})
    return out + [{}, {"match": None, "hints": None}]


def some_spans(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abc", k=r.randint(0, 6)))
    return [(i, r.choice([None, word()]), {f"k{j}": r.choice([None, word()]) for j in range(3) if r.random() < 0.7}) for i in range(n)]


def test_index_equals_rows():
    many, spans = some_rules(300, 1), some_spans(500, 2)
    index = rules.RuleIndex(many)
    for _, name, attrs in spans:
        assert index.first(name, list(attrs.items())) == first(name, attrs, many)


def spans_of(spark, rows):
    df = spark.createDataFrame(rows, "seq long, name string, attrs map<string,string>")
    none = F.create_map().cast("map<string,string>")
    return df.withColumns({"start_ns": F.lit(1), "end_ns": F.lit(2), "status_code": F.lit("UNSET"), "kind": F.lit("INTERNAL"), "resource": none})


def test_index_gives_what_the_case_gives(spark, monkeypatch):
    many = some_rules(30, 3)
    df = spans_of(spark, some_spans(300, 4))
    got = []
    for inline in (0, 100):
        monkeypatch.setattr(enrich, "RULES_INLINE", inline)
        out = enrich.enrich(df, enrich.chain(ci=False, rules=many))
        got.append(sorted(map(repr, out.select("seq", "hints").collect())))
    assert got[0] == got[1]


def test_ten_thousand_rules_keep_the_plan_small(spark):
    many = [{"match": {"attributes": {"k0": f"v{i}"}}, "hints": {"category": f"c{i}"}} for i in range(10_000)]
    df = spans_of(spark, [(i, "n", {"k0": f"v{i * 7}"}) for i in range(2_000)])
    few = enrich.enrich(df, [enrich.rule_enricher(many[:100])])
    out = enrich.enrich(df, [enrich.rule_enricher(many)])
    size = lambda x: len(x._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(out) - size(few)) < 1_000
    assert {r["seq"]: r["category"] for r in out.select("seq", "hints.category").collect()} == {i: f"c{i * 7}" if i * 7 < 10_000 else "" for i in range(2_000)}
