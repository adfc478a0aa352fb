"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelforge.llm import chat, decontaminate, line_dedup, mixing, near_dup, quality, token_counts, top_k, toxicity, warc
from parcelforge.llm.tables import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), spark.conf.get("spark.parcelforge.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' deduplicated texts as doc_id, n_lines, lines_dropped, text_sha256."""
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    out = line_dedup.without_repeated_lines(docs.select("doc_id", "text", lines.cast("long").alias("n_lines")))
    return out.select("doc_id", "n_lines", F.col("lines_dropped").cast("long").alias("lines_dropped"), F.sha2("text", 256).alias("text_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered perspectives, masks as text: start-stop, comma-joined."""
    from pyspark.sql import functions as F

    out = chat.perspectives(table(spark, sf_dir, "conversations"))
    return out.withColumn("mask", F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["stop"])), ","))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.embedding_neighbours(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_chat": op8_chat,
    "op9_mixing": op9_mixing,
    "op10_top_k": op10_top_k,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase
  FROM iw, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM dw, (SELECT DISTINCT n FROM win) AS lens, unnest(range(1, len(w) - n + 2)) AS t(i)
), hits AS (
  SELECT doc_id, item, i, grams.n FROM grams JOIN win ON grams.phrase = win.phrase AND grams.n = win.n
), counted AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS t(k) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op3_near_duplicates": rf"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM dw, unnest(range(1, greatest(len(w), 2))) AS t(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), rare AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS r FROM sh JOIN (SELECT s, count(*) AS f FROM sh GROUP BY s) USING (s)
), prefix AS (
  SELECT doc_id, s FROM rare JOIN sizes USING (doc_id) WHERE r <= n - ceil(0.8 * n - 1e-9) + 1
), cand AS (
  SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM prefix a JOIN prefix b ON a.s = b.s AND a.doc_id < b.doc_id
), common AS (
  SELECT u, v, count(*) AS c FROM cand JOIN sh a ON a.doc_id = u JOIN sh b ON b.doc_id = v AND a.s = b.s GROUP BY u, v
), links AS (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)
), edges AS (
  SELECT u, v FROM links UNION SELECT v, u FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edges.v FROM reach JOIN edges ON reach.other = edges.u
), lowest AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN lowest USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
}

SQL["op7_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), best AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
bits AS (SELECT page_id, h, top, sha1(h) AS x FROM p JOIN best USING (h))
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, 5 * i + 1, 5) AS BIGINT) >> (15 - 5 * j)) & 31 AS INTEGER) + 1, 1), '' ORDER BY i, j)
   FROM unnest(range(8)) AS a(i), unnest(range(4)) AS b(j)) AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM bits"""

SQL["op10_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20"""

# Variants as text: a line with word i left out, against lines with word i left out (an exchange) and whole lines (a word more or less).
SQL["op5_line_dedup"] = """
WITH l AS (
  SELECT doc_id, i - 1 AS no, x[i] AS line, string_split(x[i], ' ') AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), unnest(range(1, len(x) + 1)) AS t(i)
), d AS (
  SELECT w, len(w) AS n, min({'doc': doc_id, 'no': no}) AS pos FROM l WHERE trim(line) <> '' GROUP BY w
), cut AS (
  SELECT w, n, pos, i, array_to_string(list_concat(w[1 : i - 1], w[i + 1 : n]), ' ') AS rest FROM d, unnest(range(1, n + 1)) AS t(i) WHERE n >= 8
), swapped AS (
  SELECT i, rest, min(pos) AS first FROM cut GROUP BY i, rest
), shorter AS (
  SELECT rest, min(pos) AS first FROM cut GROUP BY rest
), near AS (
  SELECT c.w FROM cut c JOIN swapped s ON c.i = s.i AND c.rest = s.rest WHERE s.first < c.pos
  UNION SELECT c.w FROM cut c JOIN d ON array_to_string(d.w, ' ') = c.rest WHERE d.n >= 8 AND d.pos < c.pos
  UNION SELECT d.w FROM d JOIN shorter s ON array_to_string(d.w, ' ') = s.rest WHERE d.n >= 8 AND s.first < d.pos
), judged AS (
  SELECT l.doc_id, l.no, l.line, coalesce(d.w IS NOT NULL AND (d.pos <> {'doc': l.doc_id, 'no': l.no} OR near.w IS NOT NULL), false) AS gone
  FROM l LEFT JOIN d ON l.w = d.w LEFT JOIN near ON l.w = near.w
), texts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS lines_dropped, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept FROM judged GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(lines_dropped, 0) AS lines_dropped, sha256(kept) AS text_sha256
FROM documents LEFT JOIN texts USING (doc_id)"""

SQL["op8_chat"] = r"""
WITH own AS (
  SELECT conv_id, turn, role AS speaker, replace(coalesce(text, ''), '<|', '< |') AS said,
    replace(replace(replace(replace(replace(replace(role, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), '<', '%3C'), '|', '%7C'), '>', '%3E') AS name
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, speaker, said) - 1 AS rank FROM own
), who AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM own WHERE speaker <> 'system'
), piece AS (
  SELECT conv_id, perspective, rank // 64 AS part, rank, speaker = perspective AS mine,
    '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || name END || chr(10) AS head, said || '<|im_end|>' AS body
  FROM ranked JOIN who USING (conv_id)
), placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM piece
)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_turns, CAST(min(upto - length(head) - length(body) - 1) AS BIGINT) AS start,
  string_agg(head || body || chr(10), '' ORDER BY rank) AS rendered,
  coalesce(string_agg(CAST(upto - 1 - length(body) AS BIGINT) || '-' || CAST(upto - 1 AS BIGINT), ',' ORDER BY upto) FILTER (mine), '') AS mask,
  CAST(coalesce(sum(length(body)) FILTER (mine), 0) AS BIGINT) AS n_masked
FROM placed GROUP BY conv_id, perspective, part"""
