"""The registered queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import _base, chat_format, embedding_dedup, jaccard_join, language_id, packing, sentencepiece_bpe, suffix_dedup, token_counts, topk_search, url_filter

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = url_filter.filter_urls(_table(spark, sf_dir, "pages"), RULES)
    return got.select("__row.page_id", "host", "path", "rule", "verdict")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    read = chat_format.parse_chats(chat_format.format_chats(rows.unionByName(extra)))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(t["texts"], "\n"), F.lit("\n")))
    read = read.select("conv_id", "formatted", "turns", F.array_join(turns, "").alias("all"), chat_format.loss_text(F.col("turns")).alias("loss"))
    read = read.coalesce(_base.tasks_for(spark, _base.text_bytes(rows)))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("all", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(_table(spark, sf_dir, "documents"), BYTE_BPE, cache_words=600_000)
    return got.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return got.select("__row.doc_id", language_id.held_out(F.col("__row.doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    got = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, PIECE_BPE), PIECE_BPE)
    ids = F.translate(F.col("ids").cast("string"), "[],", "")
    return got.select("__row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("__row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = topk_search.topk(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return got.select("query_id", "rank", "vec_id", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = f"{_base.shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    got = token_counts.token_counts(_table(spark, sf_dir, "documents"), WORD_BPE, store)
    _base.drop_staged(spark.read.parquet(store))  # this query starts an empty store each time
    return got


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_chat_format, op3_packing, op4_language_id, op5_jaccard_join, op6_sentencepiece, op7_suffix_dedup, op8_embedding_dedup, op9_topk_search, op10_token_counts)}

ORACLES = {
    "op1_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) AS v(verdict, rh, rp)
), m AS (
  SELECT h.page_id, h.host, h.path, rh || rp AS rule, r.verdict,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS n
  FROM h LEFT JOIN r ON (h.host = rh OR h.host LIKE '%.' || rh) AND starts_with(h.path, rp)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
""",
    "op2_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role THEN 0 ELSE 1 END AS new FROM c
), g AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY n) AS grp,
         replace(replace(text, '&', '&amp;'), '<', '&lt;') AS etext FROM o
), t AS (
  SELECT conv_id, grp, min(role) AS role, string_agg(text, chr(10) ORDER BY n) AS text, string_agg(text, '' ORDER BY n) AS plain,
         string_agg(etext, '<and>' ORDER BY n) AS etext FROM g GROUP BY conv_id, grp
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY grp)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(plain) ELSE 0 END), 0)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN plain ELSE '' END, '' ORDER BY grp)) AS loss_sha256,
       sum(6 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 1 + length(etext) + 8)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op9_topk_search": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op8_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93
), reach(x, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, reach.r FROM reach JOIN p ON p.a = reach.x),
c AS (SELECT x, min(r) AS root FROM reach GROUP BY x),
n AS (SELECT a, count(*) AS k FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n.k, 0)::BIGINT AS n_links, c.root AS component_id, v.vec_id = c.root AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.a = v.vec_id
""",
    "op5_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x20]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), k AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
p AS (
  SELECT b.a, b.b, b.n = x.n AND b.n = y.n AS same FROM b JOIN k x ON x.doc_id = b.a JOIN k y ON y.doc_id = b.b
  WHERE b.n >= 0.8 * (x.n + y.n - b.n) - 1e-9
), reach(x, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.b, reach.r FROM reach JOIN p ON p.a = reach.x),
c AS (SELECT x, min(r) AS root FROM reach GROUP BY x),
l AS (SELECT a, count(*) AS n, min(CASE WHEN same THEN b END) AS copy FROM p GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(l.copy, d.doc_id)) AS copy_id, coalesce(l.n, 0)::BIGINT AS n_links, c.root AS class_id
FROM d JOIN c ON c.x = d.doc_id LEFT JOIN l ON l.a = d.doc_id
""",
}
