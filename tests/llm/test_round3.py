"""Exact top-k, token alignment and the Merkle manifest against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import align, merkle, mtree, queries

from . import brute
from .conftest import edge_rows, prose, table

FILES = [f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model"]


def plain_tokens():
    a, b = align.byte_level(FILES[0]), align.pieces_of(FILES[1])
    return [lambda t, k=k: [(i, k.entries[i]) for i in k.encode([t])[0]] for k in (a, b)]


def check_alignment(df, rows, **sizes):
    got = [tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()]
    assert sorted(got, key=repr) == sorted(brute.aligned(rows, *plain_tokens()), key=repr)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_merge_path_pieces(size):
    r = random.Random(size)
    for n in range(30):
        a = np.array(sorted(r.sample(range(1, 40), min(n, 25)) + [40]))
        b = np.array(sorted(r.sample(range(1, 40), 12) + [40]))
        links_a, links_b, close_a, close_b = align.merge(a, b, size)
        spans = [[(s, e) for s, e in zip([0, *x[:-1]], x, strict=True)] for x in (a.tolist(), b.tolist())]
        want = {(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e}
        assert set(zip(links_a.tolist(), links_b.tolist(), strict=True)) == want and len(links_a) == len(want)
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[close_a].tolist() == b[close_b].tolist() == both


def test_merge_of_nothing():
    none = np.empty(0, np.int64)
    assert all(len(x) == 0 for x in align.merge(none, none))


def test_alignment(spark, edge, empty):
    odd = [(20, "a ▁ b"), (21, "<s> </s> <|endoftext|> <unk> <0x41>"), (22, "①ﬁ é \x00 \x01 \t\r\n  x"), (23, "日本語 " * 5 + "👩‍👩‍👧"), (24, " "), (25, "x" * 3000)]
    rows = [(r[0], r[1]) for r in edge_rows() if r[0] != 10] + odd
    df = table(spark, rows).repartition(3)
    check_alignment(align.align(df, *FILES), rows)
    check_alignment(align.align(df.withColumn("pair", F.lit("x")).withColumn("chunk", F.lit(None)), *FILES, chunk_bytes=300), rows)
    assert align.align(empty, *FILES).count() == 0
    long = table(spark, [(1, prose(10, 30_000))])
    out = align.align(long, *FILES).first()
    assert out["n_links"] == out["n_a"] + out["n_b"] - out["n_groups"] and out["groups"].count(";") == out["n_groups"] - 1
    assert align.align(edge, *FILES, groups=False).count() == len(edge_rows())


def test_alignment_query(spark):
    out = queries.op12_token_alignment(spark, "/root/testdata/sf0.001").drop("groups_sha256").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = sorted(rows, key=lambda r: len(r[1] or ""))
    a, b = plain_tokens()
    assert len(out) == len(rows)
    small = {r[0] for r in rows[:150]}
    tokens = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) for r in out}
    for d, na, nb, g, links, *_ in brute.aligned([r for r in rows if r[0] in small], a, b):
        assert tokens[d] == (na, nb, g, links)


def vectors(n, dims, seed=0, spread=50):
    r = random.Random(seed)
    return [[r.randint(-spread, spread) for _ in range(dims)] for _ in range(n)]


def check_search(spark, rows, modulus=5, k=5, **sizes):
    df = table(spark, rows, "vec_id long, v array<long>").repartition(3)
    got = mtree.top_k(df, F.col("vec_id") % modulus == 0, k, **sizes)
    assert sorted(map(tuple, got.collect())) == sorted(brute.nearest([r for r in rows if r[0] is not None and r[1] is not None], lambda i: i % modulus == 0, k))


def test_search(spark):
    check_search(spark, list(enumerate(vectors(400, 6))), cells=8, subtree=40, page=7)
    check_search(spark, list(enumerate(vectors(300, 2, 1, 3))), cells=4, subtree=50, page=5)  # ties everywhere


def test_search_of_clusters_and_copies(spark):
    r = random.Random(3)
    centres = vectors(5, 8, 4, 300)
    rows = [(i, [x + r.randint(-2, 2) for x in r.choice(centres)]) for i in range(300)]
    rows += [(i, centres[0]) for i in range(300, 420)]  # a hot vector
    rows += [(5, centres[1]), (5, centres[1]), (10, centres[0])]  # repeated ids
    check_search(spark, rows, cells=6, subtree=50, page=8)


def test_search_of_awkward_rows(spark):
    rows = [(0, [1, 2, 3]), (5, [3]), (10, []), (1, None), (None, [1, 1, 1]), (2, [-4, 0, 1, 9]), (3, [0, 0])]
    check_search(spark, rows)
    check_search(spark, [(0, [1, 2])])
    check_search(spark, [(i, [(1 << 29) + i, -(1 << 24) * i]) for i in range(20)] + [(20, [1, 2])], cells=2, subtree=6, page=4)
    none = table(spark, [], "vec_id long, v array<long>, score string")
    assert mtree.top_k(none, F.col("vec_id") % 5 == 0).count() == 0
    floats = table(spark, [(0, [0.5, -0.001]), (1, [None, 1.0]), (2, [float("nan")]), (3, [float("inf")]), (4, None), (5, [1.0, 2.0])], "vec_id long, e array<float>")
    kept = floats.where(mtree.usable(F.col("e"))).select("vec_id", mtree.scaled(F.col("e")).alias("v"))
    assert sorted(map(tuple, kept.collect())) == [(0, [128, -1]), (5, [256, 512])]


def test_bounds_avoid_work():
    """In clustered data stored distances rule out most inner products, and nothing is lost."""
    r = np.random.default_rng(1)
    centres = r.integers(-1000, 1000, (40, 16))
    v = centres[r.integers(0, 40, 4000)] + r.integers(-5, 5, (4000, 16))
    shape = mtree.Shape(16, int((v * v).sum(1).max()), int(v.min()), int(v.max()))
    ids = np.arange(4000)
    tree = mtree.subtree_of(shape, shape.lifted(v[:1])[0], ids, ids, v, 64)
    q = v[:200]
    best = mtree.Best(np.full(200, -np.inf), np.full(200, mtree._NO_ID), 5, True)
    computed = mtree.search_block(shape, tree, q, np.full(200, -1), best)
    assert computed < 0.2 * 200 * 4000
    scores = q @ v.T
    for i in range(200):
        assert [x for _, x in best.found[i]] == np.lexsort((ids, -scores[i]))[:5].tolist()


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest(spark, edge, empty, bits):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in edge_rows()]
    rows += [(100 + i, "s", "zz", i, f"text {i}") for i in range(37)] + [(i, None, f"l{i}", None, "") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("tree", F.lit(1)).withColumn("node", F.lit(2)).repartition(3)
    bad = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    out = merkle.manifest(df, {"n_chars": F.col("n_chars") + 1}, bad, bits=bits)
    got = sorted(tuple(r) for r in out.select("leaf", "subroot", "root", "proof", "folded_root").collect())

    def altered(row):
        bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
        return (*row[:3], row[3] + 1, row[4]) if bad else row

    assert got == sorted(brute.merkle(rows, altered).values())
    assert all(r["verified"] == (r["root"] == r["folded_root"]) for r in out.collect())
    assert merkle.manifest(empty.withColumn("x", F.lit(1)), bits=bits).count() == 0


def test_versions_share_nodes():
    leaves = [brute.sha(str(i)).encode() for i in range(11)]
    base = merkle.PersistentTree(leaves, 4)
    before, root = list(base.digests), base.root
    copies = base.version(6, brute.sha("x").encode())
    assert base.digests[: len(before)] == before and len(copies) == 5  # the leaf and four ancestors are new

    def reach(node):
        return {node}.union(*map(reach, base.children[node])) if base.children[node] else {node}

    assert reach(copies[-1]) - reach(root) == set(copies)
    leaves[6] = brute.sha("x").encode()
    fresh = merkle.PersistentTree(leaves, 4)
    assert fresh.digests[fresh.root] == base.digests[copies[-1]]


def test_manifest_of_whole_versions(spark):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(21)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    one = {r["id"]: r for r in merkle.manifest(df, {"n_chars": F.lit(7)}, F.col("doc_id") == 13, bits=2).collect()}
    there = df.withColumn("n_chars", F.when(F.col("doc_id") == 13, 7).otherwise(F.col("n_chars")))
    assert one[13]["folded_root"] == merkle.manifest(there, bits=2).first()["root"] == one[13]["copies"][-1]
    assert len(one[13]["copies"]) == 6 and one[12]["copies"] is None and not one[13]["verified"] and one[12]["verified"]
