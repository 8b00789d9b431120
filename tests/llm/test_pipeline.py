"""The pipeline and the queries against plain versions on the smallest tables."""

import hashlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from spanloom.llm import fingerprints, language, queries
from spanloom.llm.common import documents

from . import brute

SF = "/root/testdata/sf0.001"


def rows(spark):
    return [(r["doc_id"], r["text"]) for r in documents(spark, SF).select("doc_id", "text").collect()]


def test_stages(spark):
    docs = documents(spark, SF)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard", "decontamination", "mixing", "sharding"]
    stage = dict(corpus_pipeline.STAGES)
    after = stage["language_id"](spark, docs, SF)
    assert after.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in after.collect()]
    assert {d for d, _ in rows(spark)} - {d for d, _ in kept} == {d for d, t in rows(spark) if not any(c.isalpha() for c in t or "")}
    first = [(d, t) for (d, t), (_, group, _) in zip(kept, brute.near(kept), strict=True) if d == group]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute.leaks(first, items)}
    clean = {d for d, _ in first if d not in bad}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} <= clean
    copies = Counter(r["doc_id"] for r in out)
    assert max(copies.values()) <= 2
    words = {d: len(brute.WORD.findall(t)) for d, t in first if d in clean}
    total = sum(words.values())
    assert abs(sum(words[r["doc_id"]] for r in out) - 1.5 * total) < 0.1 * total
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.get(i, 0) for i in range(8)) <= 1


def test_fingerprint_query(spark):
    known = sorted(rows(spark), reverse=True)
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_fingerprints"](spark, SF).collect()}
    for (doc, text), (_, after) in zip(known, [*known[1:], known[0]], strict=True):
        changed = fingerprints.edited(text, after)
        a, b, c = (fingerprints.sketches([t])[0] for t in (text, changed, after))
        want = (doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.spelled(a), fingerprints.spelled(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c))
        assert tuple(got[doc]) == want


def test_pair_queries(spark):
    known = rows(spark)
    got = queries.QUERIES["op6_ngram_jaccard"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(brute.near(known))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op1_decontamination"](spark, SF).collect()}
    assert found == brute.leaks(known, items)


def test_byte_query(spark):
    got = queries.QUERIES["op9_suffix_dedup"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(brute.repeated_bytes(rows(spark)))


def test_shard_query(spark):
    out = queries.QUERIES["op2_sharding"](spark, SF).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) == 8
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}


def test_long_texts_are_learned(spark):
    """Languages whose texts are all long are learned from them, and the pipeline keeps documents if nothing was learned."""
    texts = {"en": "the cat sat on the mat and the dog ran over the hill ", "de": "der hund lief durch den wald und die katze sah zu "}
    rows = [(i, lang, t * (400 + i)) for i in range(6) for lang, t in texts.items()]
    docs = spark.createDataFrame([(2 * i + (lang == "de"), t, lang, "s", len(t)) for i, lang, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    trees = language.train(docs)
    assert trees.languages == ["de", "en"]
    out = language.identify(docs, trees)
    assert out.where("lang = lang_pred").count() == len(rows)
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unknown, SF).count() == len(rows)


def test_pipeline_of_awkward_tables(spark, edge, empty, tmp_path):
    """Nulls, repeated ids, empty texts and extra columns pass all stages; an empty table gives no rows."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, docs in (("edge", edge), ("empty", empty)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert bool(out) == (name == "edge")
        assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
