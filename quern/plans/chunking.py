"""Chunking and splitting of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import fixtures
from quern.functions.text import estimate_tokens, sentences
from quern.operators.chunking import (
    BULLET, DIVIDER, HEADING, NUMBERED, QUESTION, chunk_documents, section_path, semantic_segments, structural_blocks,
)
from quern.operators.indexing import deterministic_provider

_SELECT = ["document_id", "chunk_id", "chunk_index", "text", "char_count", "start", "stop"]


def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(fixtures.paragraphs(spark, sf_dir), "paragraph", target=1 << 20).select(*_SELECT)


def chunk_paragraph_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_documents(fixtures.paragraphs(spark, sf_dir), "paragraph", target=300, overlap=30)
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("char_count").alias("n_chars"), F.max("stop").alias("stop")
    )


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_documents(fixtures.documents(spark, sf_dir), "recursive", target=400, overlap=50)
    return chunks.select(*_SELECT)


def chunk_section_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in two sections of half its characters; the second one has no title."""
    docs = fixtures.documents(spark, sf_dir)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    sections = F.array(
        F.struct(F.lit("s1").alias("section_id"), F.col("title"), F.lit(0).alias("start_offset"), half.alias("end_offset")),
        F.struct(
            F.lit("s2").alias("section_id"), F.lit("").alias("title"), half.alias("start_offset"),
            F.col("n_chars").cast("int").alias("end_offset"),
        ),
    )
    chunks = chunk_documents(
        docs.withColumn("sections", sections), "recursive", target=1000, overlap=100, sections="sections"
    )
    return chunks.select("document_id", "chunk_index", F.element_at("section_path", 1).alias("section"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("n", "s")).select(
        "doc_id", "n", "s.text", "s.start", "s.stop"
    )


def structural_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents whose first letters stand for kinds of lines; a line of two
    words or fewer becomes blank."""
    text = F.col("text")
    for letter, mark in (("T", "# T"), ("A", "- A"), ("O", "---"), ("E", "Note: E"), ("D", "1. D")):
        text = F.regexp_replace(text, f"(?m)^{letter}", mark)
    docs = fixtures.documents(spark, sf_dir).withColumn("text", text)
    return structural_blocks(docs).select("document_id", "block", "type", "text", "start", "stop")


def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("text", "(?m)^T", "# T"), "(?m)^A", "- A")
    docs = fixtures.documents(spark, sf_dir).withColumn("text", text)
    chunks = chunk_documents(docs, "semantic", target=500, overlap=50)
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("char_count").cast("long").alias("n_bytes")
    )


def semantic_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (in ASCII) as paragraphs whose lines are sentences, joined by their vectors."""
    text = F.regexp_replace("text", r"[^\x00-\x7f]", "x")
    blocks = fixtures.documents(spark, sf_dir).select(
        "document_id", F.lit(0).alias("block"), F.lit("paragraph").alias("type"), text.alias("text"), F.lit(0).alias("start"),
        F.octet_length(text).alias("stop"),
    )
    made = semantic_segments(blocks, target=600, provider=deterministic_provider)
    return made.select("document_id", "segment", F.md5("text").alias("text_md5"), "start", "stop")


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.documents(spark, sf_dir).select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


QUERIES = {
    "chunk_paragraph": chunk_paragraph,
    "chunk_paragraph_sized": chunk_paragraph_sized,
    "chunk_recursive": chunk_recursive,
    "chunk_section_path": chunk_section_path,
    "sentence_split": sentence_split,
    "structural_split": structural_split,
    "chunk_semantic": chunk_semantic,
    "semantic_paragraphs": semantic_paragraphs,
    "token_estimate": token_estimate,
}

_SPACES = r"[ \t\n\r\f\v]"


def _windows(source: str, target: int, step: int, start: str = "0") -> str:
    """Rows (…source columns, k, part, at) of windows over column ``t``."""
    return f"""SELECT *, substr(t, k * {step} + 1, {target}) AS part, {start} + k * {step} AS pos FROM (
  SELECT *, unnest(range(CASE WHEN length(t) <= {target} THEN 1
    ELSE ceil((length(t) - {target}) / {step}::DOUBLE)::INT + 1 END)) AS k FROM {source} WHERE length(t) > 0)"""


_TRIM = rf"regexp_replace(part, '^{_SPACES}+|{_SPACES}+$', '', 'g')"
_LEAD = rf"(length(part) - length(regexp_replace(part, '^{_SPACES}+', '')))"

ORACLE_SQL = {
    "chunk_paragraph": rf"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part,
  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
o AS (SELECT doc_id, part, i, coalesce(sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM p),
s AS (SELECT doc_id, i, {_TRIM} AS t, pos + {_LEAD} AS start FROM o WHERE {_TRIM} <> '')
SELECT 'doc_' || doc_id AS document_id, 'doc_' || doc_id || '_chunk_' || n AS chunk_id, n - 1 AS chunk_index,
  t AS text, length(t) AS char_count, start, start + length(t) AS stop
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM s)""",
    "chunk_paragraph_sized": rf"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part,
  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
o AS (SELECT doc_id, part, i, coalesce(sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM p),
s AS (SELECT doc_id, {_TRIM} AS t, pos + {_LEAD} AS start FROM o WHERE {_TRIM} <> ''),
w AS ({_windows("s", 300, 270, "start")}),
x AS (SELECT doc_id, {_TRIM} AS t, pos + {_LEAD} AS start FROM w WHERE {_TRIM} <> '')
SELECT 'doc_' || doc_id AS document_id, count(*) AS n_chunks, sum(length(t))::BIGINT AS n_chars,
  max(start + length(t)) AS stop FROM x GROUP BY doc_id""",
    "chunk_recursive": rf"""
WITH w AS ({_windows("(SELECT doc_id, text AS t FROM documents)", 400, 350)}),
s AS (SELECT doc_id, k, {_TRIM} AS t, pos + {_LEAD} AS start FROM w WHERE {_TRIM} <> '')
SELECT 'doc_' || doc_id AS document_id, 'doc_' || doc_id || '_chunk_' || n AS chunk_id, n - 1 AS chunk_index,
  t AS text, length(t) AS char_count, start, start + length(t) AS stop
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM s)""",
    "chunk_section_path": rf"""
WITH w AS ({_windows("(SELECT doc_id, n_chars, text AS t FROM documents)", 1000, 900)}),
s AS (SELECT doc_id, n_chars, k, pos + {_LEAD} AS start FROM w WHERE {_TRIM} <> '')
SELECT 'doc_' || doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index,
  CASE WHEN start < floor(n_chars / 2) THEN 'doc_' || doc_id ELSE 's2' END AS section FROM s""",
    "sentence_split": rf"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^。！？\n]*[。！？\n]|[^。！？\n]+')) AS part,
  generate_subscripts(regexp_extract_all(text, '[^。！？\n]*[。！？\n]|[^。！？\n]+'), 1) AS i FROM documents),
o AS (SELECT *, sum(octet_length(encode(part))) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS stop FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, {_TRIM} AS text,
  stop - octet_length(encode(part)) AS start, stop FROM o WHERE {_TRIM} <> ''""",
    "token_estimate": r"""
SELECT doc_id, ceil(length(regexp_replace(text, '[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}]', '', 'g')) / 2.0
  + length(regexp_replace(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x00-\x20]', '', 'g')) / 4.0)::BIGINT
  AS tokens FROM documents""",
    "structural_split": rf"""
WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '(?m)^T', '# T', 'g'), '(?m)^A', '- A', 'g'), '(?m)^O', '---', 'g'), '(?m)^E', 'Note: E', 'g'), '(?m)^D', '1. D', 'g') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i, len(string_split(t, chr(10))) AS last FROM d),
a AS (SELECT *, {_TRIM.replace("part", "line")} AS trimmed, octet_length(encode(line)) AS size FROM l),
b AS (SELECT *, coalesce(sum(size + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
  size + (i < last)::INT AS width, starts_with(trimmed, '```') AS fence,
  sum(starts_with(trimmed, '```')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM a),
c AS (SELECT *, fence OR fences % 2 = 1 AS code, fence AND fences % 2 = 1 AS opens, NOT (fence OR fences % 2 = 1) AND trimmed = '' AS blank FROM b),
e AS (SELECT *, CASE WHEN code THEN 'code' WHEN blank THEN NULL WHEN regexp_matches(trimmed, '{HEADING}') THEN 'heading'
  WHEN regexp_matches(trimmed, '{QUESTION}') THEN 'qa' WHEN regexp_matches(trimmed, '{DIVIDER}') THEN 'divider'
  WHEN regexp_matches(trimmed, '{NUMBERED}') OR regexp_matches(trimmed, '{BULLET}') THEN 'list' ELSE 'paragraph' END AS own FROM c),
f AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
  coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY i), false) AS since FROM e),
g AS (SELECT *, coalesce(CASE WHEN own = 'code' THEN opens ELSE own IS NOT NULL AND (prior IS NULL OR prior <> own
  OR own IN ('heading', 'divider') OR (own = 'paragraph' AND since)) END, false) AS starts FROM f),
h AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM g),
k AS (SELECT *, first_value(own IGNORE NULLS) OVER (PARTITION BY doc_id, block ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kind
  FROM h WHERE block > 0),
m AS (SELECT doc_id, kind, string_agg(line, chr(10) ORDER BY i) AS part, min(pos) AS start, max(pos + width) AS stop FROM k
  WHERE NOT (blank AND kind IN ('paragraph', 'code')) GROUP BY doc_id, block, kind)
SELECT 'doc_' || doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS block, kind AS type,
  {_TRIM} AS text, start, stop FROM m WHERE {_TRIM} <> ''""",
    "semantic_paragraphs": rf"""
WITH RECURSIVE d AS (SELECT doc_id, n_chars, regexp_replace(text, '[^\x00-\x7f]', 'x', 'g') AS text FROM documents),
p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS part,
  generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) AS k FROM d WHERE n_chars > 600),
o AS (SELECT *, sum(octet_length(encode(part))) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS stop FROM p),
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, {_TRIM} AS t, stop - octet_length(encode(part)) AS start, stop
  FROM o WHERE {_TRIM} <> ''),
v AS (SELECT *, sha256('mock-embedding-v1|doc_' || doc_id || '_block_0_sent_' || i || '|' || sha256(t) || '|' || length(t)) AS h FROM s),
x AS (SELECT *, list_transform(range(8), lambda j: (('0x' || substr(h, 1 + 8 * j, 8))::UBIGINT % 10000 / 10000.0::DOUBLE)::FLOAT::DOUBLE) AS vec FROM v),
y AS (SELECT doc_id, i, t, start, stop, coalesce(list_cosine_similarity(lag(vec) OVER (PARTITION BY doc_id ORDER BY i), vec) < 0.6, false) AS breaks FROM x),
f AS (SELECT doc_id, i, t, start, stop, length(t) AS size, 1 AS held, 0 AS seg FROM y WHERE i = 0
  UNION ALL SELECT y.doc_id, y.i, y.t, y.start, y.stop, CASE WHEN f.full OR y.breaks THEN 0 ELSE f.size END + length(y.t),
    CASE WHEN f.full OR y.breaks THEN 1 ELSE f.held + 1 END, f.seg + (f.full OR (y.breaks AND f.size > 0))::INT
  FROM (SELECT *, size >= 600 AND held > 1 AS full FROM f) f JOIN y ON y.doc_id = f.doc_id AND y.i = f.i + 1),
g AS (SELECT doc_id, seg, string_agg(t, '' ORDER BY i) AS part, min(start) AS start, max(stop) AS stop FROM f GROUP BY doc_id, seg),
many AS (SELECT doc_id FROM g GROUP BY doc_id HAVING count(*) > 1),
w AS ({_windows("(SELECT doc_id, text AS t FROM d WHERE n_chars > 600 AND doc_id NOT IN (SELECT doc_id FROM many))", 600, 540)}),
z AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS seg, {_TRIM} AS t,
  octet_length(encode(substr(t, 1, k * 540))) + octet_length(encode(substr(part, 1, {_LEAD}))) AS start FROM w WHERE {_TRIM} <> '')
SELECT 'doc_' || doc_id AS document_id, seg::INT AS segment, md5({_TRIM}) AS text_md5, start::INT AS start, stop::INT AS stop
  FROM g WHERE doc_id IN (SELECT doc_id FROM many)
UNION ALL SELECT 'doc_' || doc_id, seg::INT, md5(t), start::INT, (start + octet_length(encode(t)))::INT FROM z
UNION ALL SELECT 'doc_' || doc_id, 0, md5(text), 0, octet_length(encode(text)) FROM d WHERE n_chars <= 600""",
}
