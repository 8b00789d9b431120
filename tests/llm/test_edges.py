"""Every operator on a table of awkward rows and on an empty one."""

from pyspark.sql import functions as F

from spanloom.llm import chat, decontaminate, fingerprints, jaccard, language, mixing, sharding, substrings, suffixes, toxicity

from . import brute
from .conftest import edge_rows, table

ROWS = [(r[0], r[1]) for r in edge_rows()]


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_substrings(edge, empty):
    out = substrings.deduplicate(edge, digest=True)
    assert got(out, "doc_id", "n_words", "n_removed", "kept") == sorted(brute.repeated_words(ROWS), key=repr)
    assert substrings.deduplicate(empty).count() == 0


def test_suffixes(edge, empty):
    out = suffixes.deduplicate(edge, digest=True).withColumn("kept", F.col("kept").cast("string"))
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(brute.repeated_bytes(ROWS), key=repr)
    assert suffixes.deduplicate(empty).count() == 0


def test_jaccard(edge, empty):
    assert got(jaccard.join(edge), "doc_id", "class_id", "n_links") == sorted(brute.near(ROWS), key=repr)
    assert jaccard.join(empty).count() == 0
    kept = jaccard.deduplicate(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {1, 2, 6, 7} & set(ids) == set() and {0, 3, 5, None} <= set(ids)


def test_decontaminate(edge, empty, spark):
    items = [(1, ROWS[4][1]), (2, "too short"), (3, None), (4, ""), (5, ROWS[11][1]), (6, " ".join(ROWS[3][1].split()[60:105]))]
    bench = table(spark, items, "item_id long, text string")
    out = decontaminate.matches(edge, bench)
    assert {tuple(r) for r in out.select("doc_id", "item_id").collect()} == brute.leaks(ROWS, items)
    left = decontaminate.clean(edge, bench)
    assert left.columns == edge.columns
    bad = {d for d, _ in brute.leaks(ROWS, items)}
    assert got(left, "doc_id") == sorted([(d,) for d, _ in ROWS if d not in bad], key=repr)
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.matches(edge, bench.limit(0)).count() == 0


def test_language(edge, empty):
    trees = language.train(edge)
    out = language.identify(edge, trees)
    assert out.count() == len(ROWS)
    for r in out.select("doc_id", "text", "lang_pred", "score").collect():
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert language.identify(empty, trees).count() == 0
    none = language.train(empty)
    assert {r["lang_pred"] for r in language.identify(edge, none).collect()} == {"und"}


def test_toxicity(edge, empty, spark):
    labels = table(spark, [(0, 1), (0, 0), (3, 0), (6, 1), (99, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    index = toxicity.train(edge, labels)
    out = toxicity.score(edge, index).select("score", "predicted").collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert toxicity.score(empty, index).count() == 0
    bare = toxicity.train(edge, labels.limit(0))
    assert {r["score"] for r in toxicity.score(edge, bare).collect()} == {0.0}


def test_mixing(edge, empty):
    out = mixing.mix(edge).collect()
    assert len(out) == len(ROWS)
    assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in out)
    again = mixing.mixed(edge)
    assert again.columns == edge.columns
    assert again.count() == sum(r["copies"] for r in out)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_sharding(edge, empty):
    out = sharding.shard(edge, 8)
    assert out.columns == [*(c for c in edge.columns if c not in ("shard", "slot")), "shard", "slot"]
    rows = out.select("shard", "slot").collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(i, [])) for i in range(8)]
    assert sum(sizes) == len(ROWS) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(empty, 8).count() == 0


def test_next_documents(edge, empty):
    def pairs(ids, texts, after):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(after, pa.string())], ["doc_id", "text", "after"])

    schema = "doc_id long, text string, after string"
    out = fingerprints.with_next(edge, pairs, schema).collect()
    # rows of equal id and text change places freely, as nothing tells them apart
    known = [(d, t or "") for d, t in ROWS if d is not None]
    places = sorted(known, key=lambda r: -r[0])
    single = [d for d, _ in places if [x for x, _ in places].count(d) == 1]
    for r in out:
        if r["doc_id"] in single and r["doc_id"] > 0:
            assert r["after"] == next(t for d, t in places if d == r["doc_id"] - 1)
    assert sorted((r["doc_id"], r["text"]) for r in out if r["doc_id"] is not None) == sorted(known)
    assert fingerprints.with_next(empty, pairs, schema).count() == 0
    lone = fingerprints.with_next(edge.where("doc_id = 8"), pairs, schema).collect()
    assert [tuple(r) for r in lone] == [(8, "one two", "one two")]


def test_chat(spark):
    turns = [(1, 0, "user", None), (1, None, None, "x\\[<|"), (1, 1, "tool", "[/INST] </s>"), (None, 0, "system", ""), (1, 0, "user", "b"), (2, 200, "assistant", "a " * 50_000), (2, 3, "a|> b", " <|end|> ")]
    log = chat.log_of(table(spark, turns, "conv_id long, turn long, role string, text string"))
    out = {}
    for r in chat.format_logs(log).orderBy("conv_id", "block").collect():
        out.setdefault(r["conv_id"], []).extend(chat.parse(r["formatted"]))
    assert out == {
        1: [("", "x\\[<|"), ("user", ""), ("user", "b"), ("tool", "[/INST] </s>")], None: [("system", "")],
        2: [("a|> b", " <|end|> "), ("assistant", "a " * 50_000)],
    }
    assert chat.format_logs(log.limit(0)).count() == 0
