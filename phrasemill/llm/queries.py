"""Registered queries of this subpackage (`QUERIES`) and their DuckDB SQL (`ORACLE`).

Each query applies one operator, with production parameters, to its whole
table and derives the digest columns of its contract from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm import alignment, byte_bpe, conversations, cover_tree, lm_score, lz_fingerprint, pii, quality, simhash, warc
from phrasemill.llm import tables as T
from phrasemill.llm.line_dedup import line_dedup
from phrasemill.llm.packing import pack_documents
from phrasemill.llm.substring_dedup import substring_dedup

QUERIES, ORACLE = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(T.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE["op1_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i+12], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
first AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT doc_id, list(i) AS starts FROM win JOIN first USING (g) WHERE m < doc_id GROUP BY doc_id),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p
  FROM (SELECT doc_id, unnest(starts) AS s FROM hit)),
kept AS (
  SELECT d.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t, count(*) AS n
  FROM d, LATERAL (SELECT unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS p) x
  LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.p = x.p
  WHERE gone.p IS NULL
  GROUP BY d.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(T.read(spark, sf_dir, "documents"), T.tokenizer("word_bpe_49k.json"), end_id=2)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = T.tokenizer("byte_bpe_50k.tiktoken")
    both = byte_bpe.encode(T.read(spark, sf_dir, "documents"), ranks, T.pretoken_pattern(), decoded=True)
    return both.select("doc_id", byte_bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped",
                                   F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op10_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
hot AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN hot.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM l LEFT JOIN hot USING (k) GROUP BY doc_id
"""


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_near_dedup(T.read(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Fitted on labelled rows that aren't held out."""
    labels = T.read(spark, sf_dir, "labels").filter(~quality.held_out(F.col("doc_id")))
    return quality.train(T.read(spark, sf_dir, "documents"), labels, "quality")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    out = quality.score(docs, quality_model(spark, sf_dir))
    return out.select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitise(T.read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [F.aggregate("spans", F.lit(0).cast("long"), pii.count_kind(k)).alias(f"n_{k}") for k in pii.KINDS[:4]]
    return out.select("doc_id", *count, F.sha2(pii.told(F.filter("spans", lambda s: s["rank"] < 4)), 256).alias("base_sha256"),
                      pii.told(F.col("spans")).alias("spans"))


@query
def op7_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_neighbours(T.read(spark, sf_dir, "documents"))


@query
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.lm_scores(T.read(spark, sf_dir, "documents"))
    return out.withColumn("log_score", F.round("log_score", 4))


ORACLE["op6_lm_score"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
tok AS (
  SELECT doc_id, i, w[i] AS g1,
         CASE WHEN i >= 2 THEN w[i-1] || ' ' || w[i] END AS g2,
         CASE WHEN i >= 3 THEN w[i-2] || ' ' || w[i-1] || ' ' || w[i] END AS g3
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
loo AS (
  SELECT doc_id, i,
         count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY g1, doc_id) AS c1,
         CASE WHEN g2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY g2, doc_id) END AS c2,
         CASE WHEN g3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY g3, doc_id) END AS c3,
         count(*) OVER () AS n
  FROM tok),
ctx AS (
  SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS p1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS p2,
         least(i - 1, 2) AS back
  FROM loo),
s AS (
  SELECT doc_id, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS k,
         CASE WHEN c3 > 0 THEN ln(c3::DOUBLE / p2)
              WHEN c2 > 0 THEN (back - 1) * ln(0.4::DOUBLE) + ln(c2::DOUBLE / p1)
              WHEN c1 > 0 THEN back * ln(0.4::DOUBLE) + ln(c1::DOUBLE / n)
              ELSE (back + 1) * ln(0.4::DOUBLE) - ln(n::DOUBLE) END AS l
  FROM ctx)
SELECT d.doc_id, any_value(len(d.w)) AS n_words, count(*) FILTER (k = 3) AS n_trigram, count(*) FILTER (k = 2) AS n_bigram,
       count(*) FILTER (k = 1) AS n_unigram, count(*) FILTER (k = 0) AS n_unseen,
       round(coalesce(sum(l), 0), 4) AS log_score
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""


@query
def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(T.read(spark, sf_dir, "embeddings"))


ORACLE["op3_cover_tree"] = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM embeddings v
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = v.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) n ON n.a = v.vec_id
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(T.read(spark, sf_dir, "conversations"))
    return conversations.repair(rows, gone=F.col("gone")).conversations


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.normalise(warc.write(T.read(spark, sf_dir, "pages")))
    return warc.read(archives, payloads=False).select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of("refers_to").alias("refers_to"))


ORACLE["op11_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT t, min(page_id) AS first FROM p GROUP BY t),
b AS (
  SELECT page_id, t, array_to_string(list_transform(range(1, 41), lambda j:
           substr('0000000100100011010001010110011110001001101010111100110111101111',
                  4 * instr('0123456789abcdef', substr(h, j, 1)) - 3, 4)), '') AS bits
  FROM p)
SELECT page_id, strlen(t) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
         + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
         + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b JOIN f USING (t)
"""


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(T.read(spark, sf_dir, "documents"), T.tokenizer("byte_bpe_50k.json"), T.tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
