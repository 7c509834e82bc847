"""Queries opN_<name> over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, html_extract, mixing, packing, pii, quality, simhash, substring_dedup, token_files, warc
from .common import scratch, written


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex(c: str) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus, of any length, and sentences in repeated runs of 20 words or more: a row for each to remove.

    Null and empty texts have none; nulls, ties and repeated rows as in substring_dedup.repeats.
    """
    found = substring_dedup.repeats(_table(spark, sf_dir, "documents"), unit="line", min_words=1, passages=20)
    return found.select("doc_id", "unit", *(F.col(c).cast("long").alias(c) for c in ("start", "end")), F.col("words").cast("long").alias("n_words"), F.col("first_id").alias("first_doc_id"), F.col("first_start").cast("long").alias("first_start"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. A null, empty or text-less page gives an empty text; rows may repeat."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens. A null or empty text is its end id; rows may repeat."""
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 on instruction data: whole conversations in sequences of at most 4096 tokens, 8 segments and 2048 tokens of assistant turns.

    A row for each conversation; one over a limit has a null sequence_id and offset.
    """
    sizes = written(packing.conversation_tokens(_table(spark, sf_dir, "conversations"), tokenizer_path()), "conversations")
    key = F.struct("conv_id", "tokens", "loss").alias("key")
    placed = packing.pack_examples(sizes.select(key, "tokens", "loss"), "key", "tokens", "loss", packing.Limits(4096, 8, 2048), over="apart")
    return placed.select("key.conv_id", "key.tokens", F.col("key.loss").alias("loss_tokens"), "sequence_id", "offset")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. Null texts have size 0, a null source is the last; equal rows are taken alike."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document. Null and empty texts have no words and fail; null languages and sources are groups; rows may repeat."""
    return quality.judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from token files. A null or empty text is its end id; null ids come first, equal ids in an order fixed by their texts."""
    out = scratch(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), out, tokenizer_path(), end_id=2)
    return token_files.read_token_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages as read back from packages. A null html is an empty payload; of equal payloads rows with the smallest id are responses, and rows without an id revisit them."""
    out = scratch(spark, "warc")
    archives = warc.write_archives(_table(spark, sf_dir, "pages"), out)
    return warc.read_archives(spark, out, archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and wordless texts have fingerprint 0; rows without an id name no component; rows may repeat."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", _hex("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, disclosing terms wherever they stand. Null and empty texts have none; equal rows get equal spans."""
    found = pii.find_personal(_table(spark, sf_dir, "documents"), everywhere=True)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector. Null, zero and non-finite vectors and null labels link with nothing; rows may repeat an id or have none."""
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_html_extraction, op3_packing, op4_source_mixing, op5_quality_rules, op6_token_files, op7_warc, op8_simhash, op9_pii, op10_embedding_dedup, instruction_packing)}


#: Sentences of lines, and lines of several sentences beside them; a row number among a document's repeats tells runs apart.
OP1_SQL = r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, unnest(list_transform(l, lambda x, i: CASE WHEN i < len(l) THEN x || chr(10) ELSE x END)) AS t, unnest(range(len(l))) AS ln FROM cut),
line_at AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY ln) - length(t) AS l0 FROM line),
part AS (SELECT doc_id, ln, l0, length(t) AS ll, string_split(regexp_replace(t, '([.!?]+[ \t]+)', '\1' || chr(1), 'g'), chr(1)) AS p, t FROM line_at),
sent AS (SELECT doc_id, ln, l0, ll, unnest(p) AS t, unnest(range(len(p))) AS k FROM part),
sent_at AS (SELECT *, l0 + sum(length(t)) OVER (PARTITION BY doc_id, ln ORDER BY k) - length(t) AS s0 FROM sent),
normal AS (
  SELECT doc_id, ln, l0, ll, s0, length(t) AS n, translate(trim(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM sent_at),
worded AS (SELECT *, count(*) OVER (PARTITION BY doc_id, ln) AS many, row_number() OVER (PARTITION BY doc_id ORDER BY s0) AS idx FROM normal WHERE w <> ''),
unit AS (
  SELECT doc_id, ln, idx, many = 1 AS whole, CASE WHEN many = 1 THEN l0 ELSE s0 END AS start, CASE WHEN many = 1 THEN l0 + ll ELSE s0 + n END AS stop, w FROM worded
  UNION ALL SELECT doc_id, ln, NULL, true, any_value(l0), any_value(l0 + ll), string_agg(w, ' ' ORDER BY idx) FROM worded WHERE many > 1 GROUP BY doc_id, ln),
ranked AS (
  SELECT *, len(string_split(w, ' ')) AS words, row_number() OVER f AS place, first_value(doc_id) OVER f AS first_id, first_value(start) OVER f AS first_start
  FROM unit WINDOW f AS (PARTITION BY w ORDER BY doc_id, start, idx IS NULL)),
later AS (
  SELECT *, CASE WHEN idx IS NOT NULL THEN idx - row_number() OVER (PARTITION BY doc_id, idx IS NULL ORDER BY idx) END AS run, bool_or(idx IS NULL) OVER (PARTITION BY doc_id, ln) AS inside FROM ranked WHERE place > 1),
runs AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS together FROM later)
SELECT doc_id, CASE WHEN whole THEN 'line' ELSE 'sentence' END AS unit, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", CAST(words AS BIGINT) AS n_words,
  first_id AS first_doc_id, CAST(first_start AS BIGINT) AS first_start FROM runs WHERE whole OR together >= 20 AND NOT inside
"""


#: Statistics of words and lines, quantile buckets by rank, and fences of a group, its language or the corpus.
OP5_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
pos AS (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
win AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS c FROM pos),
rep AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM win, range(3) r(j) WHERE c > 1 GROUP BY k),
s AS (
  SELECT k, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (k)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
m AS (
  SELECT k, lang, source, unnest(['symbol_ratio', 'dup_line_ratio', 'repeat_ratio', 'word_length']) AS metric,
    unnest([greatest(0, n_symbols - 2 * sqrt(n_symbols)) / word_chars, greatest(0, n_dup_lines - 2 * sqrt(n_dup_lines)) / n_lines, greatest(0, n_repeat_words - 2 * sqrt(n_repeat_words)) / n_words, word_chars / n_words]) AS v
  FROM j WHERE NOT base_failed),
b AS (SELECT *, CASE WHEN v < 1e-4 THEN -1073741824 ELSE floor(ln(v) / ln(1.005)) END AS bucket FROM m),
r AS (
  SELECT *, row_number() OVER own AS r1, count(*) OVER (PARTITION BY lang, source, metric) AS c1, row_number() OVER mid AS r2, count(*) OVER (PARTITION BY lang, metric) AS c2, row_number() OVER top AS r3, count(*) OVER (PARTITION BY metric) AS c3
  FROM b WINDOW own AS (PARTITION BY lang, source, metric ORDER BY bucket), mid AS (PARTITION BY lang, metric ORDER BY bucket), top AS (PARTITION BY metric ORDER BY bucket)),
u AS (
  SELECT 1 AS lv, lang, source, metric, r1 AS r, c1 AS c, bucket FROM r UNION ALL SELECT 2, lang, NULL, metric, r2, c2, bucket FROM r UNION ALL SELECT 3, NULL, NULL, metric, r3, c3, bucket FROM r),
q AS (
  SELECT lv, lang, source, metric, max(c) AS c, min(bucket) FILTER (WHERE 100 * r >= 25 * c) AS a, min(bucket) FILTER (WHERE 100 * r >= 50 * c) AS m, min(bucket) FILTER (WHERE 100 * r >= 75 * c) AS z, min(bucket) FILTER (WHERE 100 * r >= 90 * c) AS t
  FROM u GROUP BY ALL),
x AS (
  SELECT lv, lang, source, metric, c, CASE WHEN a < -1e9 THEN 0 ELSE 1.005 ** (a + .5) END AS a, CASE WHEN m < -1e9 THEN 0 ELSE 1.005 ** (m + .5) END AS m, CASE WHEN z < -1e9 THEN 0 ELSE 1.005 ** (z + .5) END AS z, CASE WHEN t < -1e9 THEN 0 ELSE 1.005 ** (t + .5) END AS t FROM q),
f AS (
  SELECT lv, lang, source, metric, CASE WHEN lv < 3 AND c < 100 THEN NULL WHEN metric <> 'word_length' THEN m + 16 * (t - m) WHEN a < m THEN m + 8 * (m - a) END AS high,
    CASE WHEN lv < 3 AND c < 100 THEN NULL WHEN metric = 'word_length' AND z > m THEN m - 8 * (z - m) END AS low FROM x),
ok AS (
  SELECT k, bool_and(v <= coalesce(f1.high, f2.high, f3.high, 'inf'::DOUBLE) AND v >= coalesce(f1.low, f2.low, f3.low, 0)) AS inside
  FROM b JOIN f f1 ON f1.lv = 1 AND b.metric = f1.metric AND b.lang IS NOT DISTINCT FROM f1.lang AND b.source IS NOT DISTINCT FROM f1.source
  JOIN f f2 ON f2.lv = 2 AND b.metric = f2.metric AND b.lang IS NOT DISTINCT FROM f2.lang JOIN f f3 ON f3.lv = 3 AND b.metric = f3.metric GROUP BY k)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND coalesce(inside, false) AS kept FROM j LEFT JOIN ok USING (k)
"""

OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p LEFT JOIN f USING (d)
"""

OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS y FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id <= coalesce(y, vec_id) AS kept FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""


def oracle_sql() -> dict:
    return {"op1_substring_dedup": OP1_SQL, "op5_quality_rules": OP5_SQL, "op7_warc": OP7_SQL, "op10_embedding_dedup": OP10_SQL}
