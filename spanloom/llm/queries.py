"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import align, chat, decontaminate, fingerprints, jaccard, language, merkle, mixing, mtree, sharding, substrings, suffixes, toxicity
from spanloom.llm.common import documents, partitions, remainder

#: Where the public tokenizers' files lie, on every node.
TOKENIZERS = "/opt/tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    trees = language.train(docs, usable=remainder(F.col("doc_id"), 3) != 1)
    out = language.identify(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    def handle(ids: list, texts: list[str], after: list[str]) -> pa.RecordBatch:
        changed = [fingerprints.edited(t, x) for t, x in zip(texts, after, strict=True)]
        # a row's next text is mostly the following row's own
        n = len(texts)
        extra = [i for i in range(n) if i + 1 == n or after[i] is not texts[i + 1]]
        own = fingerprints.sketches(texts + [after[i] for i in extra])
        nexts = [None] * n
        for k, i in enumerate(extra):
            nexts[i] = own[n + k]
        nexts = [own[i + 1] if x is None else x for i, x in enumerate(nexts)]
        new = fingerprints.sketches(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array([fingerprints.spelled(x) for x in own[:n]]),
                pa.array([fingerprints.spelled(x) for x in new]),
                pa.array([fingerprints.likeness(a, b) for a, b in zip(own[:n], new, strict=True)]),
                pa.array([fingerprints.likeness(a, b) for a, b in zip(own[:n], nexts, strict=True)]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return fingerprints.with_next(docs, handle, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    index = toxicity.train(docs, labels, usable=remainder(F.col("doc_id"), 4) != 2)
    held_out = (remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return toxicity.score(docs, index).select("doc_id", held_out, "score", "predicted", "evidence")


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.xxhash64("text").alias("text"),  # order of rows with equal ids
    )
    out = sharding.shard(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), ds AS (
  SELECT doc_id, len(w) AS nd, i - 1 AS i, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)
), b AS (
  SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), bs AS (
  SELECT item_id, len(w) AS n, j - 1 AS j, array_to_string(w[j:j + 4], ' ') AS sh FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS j FROM b WHERE len(w) > 4)
), al AS (
  SELECT DISTINCT doc_id, item_id, n, greatest(i - j, 0) AS a, least(i - j + n, nd) AS e FROM ds JOIN bs USING (sh)
), dc AS (
  SELECT al.doc_id, item_id, n, a, e, sh, count(*) AS c FROM al JOIN ds ON ds.doc_id = al.doc_id AND i BETWEEN a AND e - 5 GROUP BY ALL
), bc AS (
  SELECT item_id, sh, count(*) AS c FROM bs GROUP BY ALL
), m AS (
  SELECT doc_id, item_id, n, a, e, sum(least(dc.c, bc.c)) AS k FROM dc JOIN bc USING (item_id, sh) GROUP BY ALL
), r AS (
  SELECT doc_id, item_id, a, e, CAST(k AS DOUBLE) / CAST((e - a - 4) + (n - 4) - k AS DOUBLE) AS similarity FROM m
)
SELECT doc_id, item_id, similarity, CAST(a AS BIGINT) AS start, CAST(e - a AS BIGINT) AS n_words FROM r WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, a, e) = 1
"""


@query("op1_decontamination", _OP1_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = decontaminate.matches(documents(spark, sf_dir).select("doc_id", "text"), items)
    return out.select("doc_id", "item_id", "similarity", F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP6_SQL = f"""
SELECT * FROM (
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k)
  UNION ALL SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON len(x.w) = 0 AND len(y.w) = 0 AND x.doc_id <> y.doc_id
), r AS (
  SELECT doc_id, doc_id AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id
)
SELECT r.doc_id, min(root) AS class_id, any_value(coalesce(c.n, 0)) AS n_links
FROM r LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) c ON c.a = r.doc_id GROUP BY 1)
"""


@query("op6_ngram_jaccard", _OP6_SQL)
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir).select("doc_id", "text"))


_OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM starts
), word AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d
), marked AS (
  SELECT word.doc_id, word.i, word, max(CASE WHEN k > 1 THEN word.i END) OVER (PARTITION BY word.doc_id ORDER BY word.i) AS last
  FROM word LEFT JOIN ranked ON ranked.doc_id = word.doc_id AND ranked.i = word.i
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (last > i - 20) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (last IS NULL OR last <= i - 20) AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op4_substring_dedup", _OP4_SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicate(documents(spark, sf_dir).select("doc_id", "text"), digest=True)
    return out.withColumnRenamed("kept", "kept_sha256")


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.deduplicate(documents(spark, sf_dir).select("doc_id", "text"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


_OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, length(text) + (length(text) - length(regexp_replace(text, '[\\\[<|]', '', 'g'))) AS inner_chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(inner_chars + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 ELSE 6 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


@query("op5_chat_format", _OP5_SQL)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    blocks = chat.format_logs(chat.log_of(turns.unionByName(probe)))

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come in order; digests go on from block to block, so no conversation is held."""
        held = None
        for batch in batches:
            done = []
            for conv, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                if held is None or held[0] != conv:
                    if held is not None:
                        done.append(held)
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in chat.parse(formatted):
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    text = chat.unescape(formatted[span["start"] : span["end"]])
                    held[3] += len(text)
                    held[4].update(text.encode("utf-8", "surrogatepass"))
                held[5] += len(formatted)
            if done:
                yield table(done)
        if held is not None:
            yield table([held])

    def table(done: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = zip(*[[x.hexdigest() if hasattr(x, "hexdigest") else x for x in row] for row in done], strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    by_conversation = blocks.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "block")
    return by_conversation.mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_OP13_SQL = r"""
SELECT * FROM (
WITH RECURSIVE e AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail, CAST(doc_id AS VARCHAR) AS digits
  FROM documents
), c AS (
  SELECT *, coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS chars, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(digits) + 1), lambda i: ascii(digits[i])::BIGINT)),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) AS crc
  FROM e
), l AS (
  SELECT doc_id, lang, sha256(head || chars || tail) AS leaf, sha256(head || CASE WHEN crc % 7 = 0 THEN more ELSE chars END || tail) AS held,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || chars || tail)) - 1 AS pos
  FROM c
), nodes AS (
  SELECT lang, 0 AS lvl, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS width FROM l
  UNION ALL
  SELECT lang, lvl, pos, node, count(*) OVER (PARTITION BY lang) AS width
  FROM (SELECT lang, lvl + 1 AS lvl, pos // 2 AS pos, sha256(string_agg(node, '' ORDER BY nodes.pos)) AS node FROM nodes WHERE width > 1 GROUP BY lang, lvl, pos // 2)
), subs AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE width = 1
), tops AS (
  SELECT 0 AS lvl, pos, subroot AS node, count(*) OVER () AS width FROM subs
  UNION ALL
  SELECT lvl, pos, node, count(*) OVER () AS width
  FROM (SELECT lvl + 1 AS lvl, pos // 2 AS pos, sha256(string_agg(node, '' ORDER BY tops.pos)) AS node FROM tops WHERE width > 1 GROUP BY lvl, pos // 2)
), inner_steps AS (
  SELECT l.lang, l.pos, s.lvl AS step, CASE WHEN o.node IS NULL THEN '-' WHEN s.pos % 2 = 1 THEN 'L' || o.node ELSE 'R' || o.node END AS how
  FROM l JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.pos = l.pos >> s.lvl AND s.width > 1
  LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM s.lang AND o.lvl = s.lvl AND o.pos = xor(s.pos, 1)
), outer_steps AS (
  SELECT b.lang, 1000 + s.lvl AS step, CASE WHEN o.node IS NULL THEN '-' WHEN s.pos % 2 = 1 THEN 'L' || o.node ELSE 'R' || o.node END AS how
  FROM subs b JOIN tops s ON s.pos = b.pos >> s.lvl AND s.width > 1 LEFT JOIN tops o ON o.lvl = s.lvl AND o.pos = xor(s.pos, 1)
), steps AS (
  SELECT * FROM inner_steps UNION ALL SELECT l.lang, l.pos, step, how FROM l JOIN outer_steps o ON o.lang IS NOT DISTINCT FROM l.lang
), way AS (
  SELECT lang, pos, list(how ORDER BY step) AS hows FROM steps GROUP BY lang, pos
), f AS (
  SELECT l.doc_id, l.leaf, subs.subroot, (SELECT node FROM tops WHERE width = 1) AS root, coalesce(hows, []) AS hows, held
  FROM l JOIN subs ON subs.lang IS NOT DISTINCT FROM l.lang LEFT JOIN way ON way.lang IS NOT DISTINCT FROM l.lang AND way.pos = l.pos
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(hows, lambda h: substr(h, 2)), '')) AS proof_sha256,
       list_reduce(list_prepend(held, hows), lambda a, h: sha256(CASE left(h, 1) WHEN '-' THEN a WHEN 'L' THEN substr(h, 2) || a ELSE a || substr(h, 2) END)) AS folded_root,
       folded_root = root AS verified
FROM f)
"""


@query("op13_merkle_manifest", _OP13_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", "text")
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    out = merkle.manifest(docs, altered={"n_chars": more}, where=F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


_OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


@query("op11_exact_topk", _OP11_SQL)
def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(mtree.usable(F.col("embedding")))
    return mtree.top_k(rows.select("vec_id", mtree.scaled(F.col("embedding")).alias("v")), F.col("vec_id") % 50 == 0)


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return align.align(docs, f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model", groups=False)
