"""Queries of the training-data operators over the synthetic tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_neighbours, language_id, passages, preferences, sentencepieces, simhash, token_counts, toxicity, warc
from ._common import table

TOKENIZERS = "/opt/tokenizers"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, written to archives and read back."""
    back = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
n AS (SELECT p.*, first, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(p.h, CAST(i AS INT) + 1, 1)) - 1) AS d FROM p JOIN f ON p.h = f.h)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((16 * d[5 * i // 4 + 1] + d[5 * i // 4 + 2]) >> (3 - (5 * i) % 4)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM n
"""


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a preference pair against itself with its neighbour's last answer: pair_id, n_prompt_turns,
    prompt, chosen, rejected and the spans to learn from as start-end;..."""
    chosen, rejected = preferences.swapped_answers(table(spark, sf_dir, "conversations"))
    out = preferences.format_preferences(chosen, rejected)
    return out.withColumns({c: preferences.spans_text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


OP2_SQL = """
WITH c AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (SELECT pair_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, text DESC) AS k FROM c WHERE role = 'assistant') q WHERE k = 1),
r AS (SELECT c.* FROM c LEFT JOIN last l ON c.pair_id = l.pair_id WHERE l.turn IS NULL OR c.turn < l.turn
  UNION ALL SELECT l.pair_id, l.turn, 'assistant', o.text FROM last l JOIN last o ON o.pair_id = xor(l.pair_id, CAST(1 AS BIGINT))),
cn AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS k FROM c),
rn AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS k FROM r),
differ AS (SELECT coalesce(cn.pair_id, rn.pair_id) AS pair_id, min(coalesce(cn.k, rn.k)) AS first FROM cn FULL JOIN rn ON cn.pair_id = rn.pair_id AND cn.k = rn.k
  WHERE cn.k IS NULL OR rn.k IS NULL OR cn.role <> rn.role OR cn.text <> rn.text GROUP BY 1),
sides AS (SELECT 'c' AS side, * FROM cn UNION ALL SELECT 'r' AS side, * FROM rn),
t AS (SELECT s.*, first, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS out, s.k < coalesce(first, s.k + 1) AS shared FROM sides s LEFT JOIN differ d ON s.pair_id = d.pair_id),
m AS (SELECT *, coalesce(sum(CASE WHEN shared THEN 0 ELSE length(out) END) OVER (PARTITION BY pair_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 13 AS pos FROM t)
SELECT pair_id, count(*) FILTER (WHERE side = 'c' AND shared) AS n_prompt_turns,
  coalesce(string_agg(out, '' ORDER BY k) FILTER (WHERE side = 'c' AND shared), '') AS prompt,
  coalesce(string_agg(out, '' ORDER BY k) FILTER (WHERE side = 'c' AND NOT shared), '') AS chosen,
  coalesce(string_agg(out, '' ORDER BY k) FILTER (WHERE side = 'r' AND NOT shared), '') AS rejected,
  coalesce(string_agg(CAST(pos AS BIGINT) || '-' || CAST(pos + length(text) + 11 AS BIGINT), ';' ORDER BY k) FILTER (WHERE side = 'c' AND NOT shared AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(CAST(pos AS BIGINT) || '-' || CAST(pos + length(text) + 11 AS BIGINT), ';' ORDER BY k) FILTER (WHERE side = 'r' AND NOT shared AND role = 'assistant'), '') AS rejected_spans
FROM m GROUP BY pair_id
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: 3-word shingles, links at 2 or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, tau=2)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.vocabulary_from_sentencepiece(PIECES))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; profiles from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.fit_not_held_out(docs)
    return language_id.predict(docs, profiles).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


# CRC-32 of the id's digits, one after another; then words, n-grams, profiles, rankings and out-of-place distances
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, text, lang FROM documents),
crc(rid, left_over, h) AS (SELECT rid, CAST(doc_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM d WHERE doc_id IS NOT NULL
  UNION ALL SELECT rid, substr(left_over, 2), list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END, xor(h, CAST(ascii(left_over) AS BIGINT))) FROM crc WHERE left_over <> ''),
x AS (SELECT d.*, coalesce(xor(h, CAST(4294967295 AS BIGINT)) % 3 = 1, false) AS held FROM d LEFT JOIN (SELECT * FROM crc WHERE left_over = '') c ON c.rid = d.rid),
w AS MATERIALIZED (SELECT rid, ' ' || word || ' ' AS word, count(*) AS n FROM (SELECT rid, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM x) u GROUP BY ALL),
g AS MATERIALIZED (SELECT rid, substr(word, i, k) AS gram, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, unnest(range(1, length(word) - k + 2)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS k FROM w) u) v
  WHERE k > 1 OR substr(word, i, 1) <> ' ' GROUP BY ALL),
f AS MATERIALIZED (SELECT * FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS place FROM g JOIN x ON x.rid = g.rid WHERE lang IS NOT NULL AND NOT held GROUP BY lang, gram) r WHERE place < 300),
m AS (SELECT * FROM (SELECT rid, gram, row_number() OVER (PARTITION BY rid ORDER BY n DESC, gram) - 1 AS place FROM g) r WHERE place < 300),
t AS (SELECT m.rid, l.lang, CAST(sum(CASE WHEN f.place IS NULL THEN 300 ELSE abs(f.place - m.place) END) AS DOUBLE) AS distance, count(*) AS n
  FROM m CROSS JOIN (SELECT DISTINCT lang FROM f) l LEFT JOIN f ON f.lang = l.lang AND f.gram = m.gram GROUP BY m.rid, l.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY distance, lang) AS k FROM t) r WHERE k = 1)
SELECT x.doc_id, held AS held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(CAST(1 AS DOUBLE) - distance / CAST(300 * b.n AS DOUBLE), CAST(0 AS DOUBLE)) AS score
FROM x LEFT JOIN b ON b.rid = x.rid
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, grade, expected_severity, p_toxic, toxic of every document. The labels know two grades, 0 and 1."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return toxicity.predict(docs, toxicity.fit(docs, labels, n_grades=2, penalty=0.2))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of every document."""
    return sentencepieces.encode(table(spark, sf_dir, "documents"), sentencepieces.load_pieces(PIECES))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document shares with an earlier one: doc_id, start, end, other_id, other_start,
    other_end, n_words, similarity."""
    return passages.repeated_passages(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector: links at cosine >= 0.95."""
    return embedding_neighbours.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


# all pairs, and all that is reachable
OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.component_id = e.vec_id AS kept FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, start, end of every passage of a benchmark item in a document."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_preferences, op3_simhash, op4_token_counts, op5_language_id, op6_toxicity, op7_sentencepiece, op8_passages, op9_embeddings, op10_decontamination)}
ORACLE: dict[str, str] = {"op1_warc": OP1_SQL, "op2_preferences": OP2_SQL, "op5_language_id": OP5_SQL, "op9_embeddings": OP9_SQL}
