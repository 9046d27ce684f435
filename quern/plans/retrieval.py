"""Keyword, hybrid and scoped retrieval over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import fixtures
from quern.functions.text import extract_terms, tokenize_terms
from quern.operators import bm25
from quern.operators.filters import in_scope, metadata_matches
from quern.operators.local import containment_scores
from quern.operators.ranking import clamp_top_k, low_quality, min_max, top_k, with_fallback

CHUNKS = bm25.Columns(chunk="doc_id")
TITLED = bm25.Columns(chunk="doc_id", title="title")


def _scores(spark: SparkSession, sf_dir: str, columns=CHUNKS) -> DataFrame:
    return bm25.bm25_scores(fixtures.documents(spark, sf_dir), fixtures.queries(spark, sf_dir), columns)


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = tokenize_terms(F.col("text"))
    return fixtures.documents(spark, sf_dir).select(
        "doc_id", F.size(terms).cast("long").alias("n_terms"), F.array_join(F.array_sort(terms), " ").alias("terms")
    )


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.document_frequency(bm25.terms_of(fixtures.documents(spark, sf_dir), CHUNKS))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = bm25.corpus_statistics(bm25.terms_of(fixtures.documents(spark, sf_dir), CHUNKS))
    return stats.select(F.col("_n").alias("n_docs"), F.round("_mean", 6).alias("mean_length"))


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_k(_scores(spark, sf_dir).withColumn("score", F.round("score", 6)), 20, tie="doc_id")
    return best.select("query_id", "doc_id", "score", "rank")


def bm25_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_k(_scores(spark, sf_dir, TITLED).withColumn("score", F.round("score", 6)), 6, tie="doc_id")
    return best.select("query_id", "doc_id", "score", "rank")


def minmax_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole keyword search: top 20, scaling within them, top k of each query."""
    candidates = top_k(_scores(spark, sf_dir).withColumn("score", F.round("score", 6)), 20, tie="doc_id")
    scaled = min_max(candidates.drop("rank")).withColumn("score", F.round("normalized", 6)).drop("normalized")
    best = top_k(scaled, 20, tie="doc_id")
    asked = fixtures.queries(spark, sf_dir).select("query_id", clamp_top_k(F.col("top_k")).alias("k"))
    return best.join(asked, "query_id").filter("rank <= k").select("query_id", "doc_id", "score", "rank")


def scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's knowledge base only; statistics are those of the rows in scope."""
    docs = fixtures.documents(spark, sf_dir).filter(
        in_scope(F.lit("en"), F.lit(""), F.col("tenant_id"), F.col("org_id"))
        & F.array_contains(F.array(F.lit("src1"), F.lit("src2"), F.lit("src3")), F.col("knowledge_base_id"))
    )
    scored = bm25.bm25_scores(docs, fixtures.queries(spark, sf_dir), CHUNKS).withColumn("score", F.round("score", 6))
    return top_k(scored, 6, tie="doc_id").select("query_id", "doc_id", "score", "rank")


def loose_metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.labelled_documents(spark, sf_dir)
    wanted = {"quality": 1, "LANG": "en"} | {"lang": " EN ", "knowledgeBaseId": "", "tenantId": "en"}
    wanted.pop("LANG")
    return docs.filter(metadata_matches(wanted, F.col("metadata"))).select("doc_id")


def kb_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.documents(spark, sf_dir)
    chosen = docs.filter("tenant_id = 'de'").select("knowledge_base_id").distinct()
    return docs.join(chosen, "knowledge_base_id", "left_semi").select("doc_id", "knowledge_base_id")


def local_term_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demo corpus' score: query terms (repeats count) that the title or text contains."""
    docs = fixtures.documents(spark, sf_dir).select(
        "doc_id", F.lower(F.concat_ws(" ", "title", "text")).alias("hay")
    )
    terms = fixtures.queries(spark, sf_dir).select(
        "query_id", extract_terms(F.col("query")).alias("terms")
    )
    scored = containment_scores(docs, terms, chunk="doc_id", text="hay", best=6)
    return top_k(scored, 6, tie="doc_id").select("query_id", "doc_id", "score", "rank")


def fallback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoped search first; queries without a hit there fall back to all documents."""
    docs = fixtures.documents(spark, sf_dir)
    asked = fixtures.queries(spark, sf_dir)
    few = docs.filter("knowledge_base_id = 'src7' and tenant_id = 'es'")
    first = bm25.bm25_scores(few, asked, CHUNKS)
    second = bm25.bm25_scores(docs, asked, CHUNKS)
    first, second = (
        top_k(x.withColumn("score", F.round("score", 6)), 3, tie="doc_id") for x in (first, second)
    )
    return with_fallback(first, second).select("query_id", "doc_id", "score", "rank", "source")


def low_quality_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = low_quality(_scores(spark, sf_dir).withColumn("score", F.round("score", 6)), least=40.0)
    return flagged.select("query_id", "max_score", "low_quality")


QUERIES = {
    "tokenize_terms": tokenize,
    "doc_freq": doc_freq,
    "corpus_stats": corpus_stats,
    "bm25_search": bm25_search,
    "bm25_title_boost": bm25_titled,
    "minmax_fusion": minmax_fusion,
    "scoped_search": scoped_search,
    "loose_metadata_filter": loose_metadata_filter,
    "kb_semi_join": kb_semi_join,
    "local_term_score": local_term_score,
    "fallback_union": fallback_union,
    "low_quality_flag": low_quality_flag,
}


def _terms(source: str, key: str, text: str, name: str) -> str:
    runs = r"regexp_extract_all(lower(trim(coalesce({t}, ''))), '[\p{{L}}\p{{Nd}}]+')".format(t=text)
    return (
        f"{name} AS (SELECT {key}, list_distinct(list_filter({runs}, lambda x: octet_length(encode(x)) >= 2)) AS terms "
        f"FROM {source})"
    )


def _bm25(where: str = "true", extra: str = "", prefix: str = "") -> str:
    """CTEs up to ``{prefix}scored(query_id, doc_id, score)``."""
    p = prefix
    return f"""
{_terms(f"(SELECT * FROM documents WHERE {where})", "doc_id", "text", p + "dt")},
{_terms("benchmark", "item_id AS query_id", "text", p + "qt")},
{p}st AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS mean FROM {p}dt),
{p}post AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM {p}dt),
{p}freq AS (SELECT term, count(*) AS df FROM {p}post GROUP BY term),
{p}asked AS (SELECT query_id, unnest(terms) AS term FROM {p}qt),
{p}scored AS (
  SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.5
    / (1 + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM {p}asked JOIN {p}freq USING (term) JOIN {p}post USING (term), {p}st GROUP BY query_id, doc_id)"""


def _top(source: str, k: int) -> str:
    return (
        f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank "
        f"FROM {source} QUALIFY rank <= {k}"
    )


ORACLE_SQL = {
    "tokenize_terms": f"""WITH {_terms("documents", "doc_id", "text", "t")}
SELECT doc_id, len(terms)::BIGINT AS n_terms, array_to_string(list_sort(terms), ' ') AS terms FROM t""",
    "doc_freq": f"""WITH {_terms("documents", "doc_id", "text", "t")}
SELECT term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM t) GROUP BY term""",
    "corpus_stats": f"""WITH {_terms("documents", "doc_id", "text", "t")}
SELECT count(*) AS n_docs, round(avg(len(terms)), 6) AS mean_length FROM t""",
    "bm25_search": f"WITH {_bm25()} {_top('scored', 20)}",
    "bm25_title_boost": f"""WITH
dt AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(trim('doc_' || doc_id || ' ' || text)),
  '[\\p{{L}}\\p{{Nd}}]+'), lambda x: octet_length(encode(x)) >= 2)) AS terms,
  list_distinct(list_filter(regexp_extract_all('doc_' || doc_id, '[\\p{{L}}\\p{{Nd}}]+'),
  lambda x: octet_length(encode(x)) >= 2)) AS title FROM documents),
{_terms("benchmark", "item_id AS query_id", "text", "qt")},
st AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS mean FROM dt),
post AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term, 1.0 AS w FROM dt
  UNION ALL SELECT doc_id, len(title), unnest(title), 0.3 FROM dt),
freq AS (SELECT term, count(*) AS df FROM post WHERE w = 1.0 GROUP BY term),
asked AS (SELECT query_id, unnest(terms) AS term FROM qt),
scored AS (SELECT query_id, doc_id, round(sum(w * ln((n - df + 0.5) / (df + 0.5) + 1) * 2.5
    / (1 + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM asked JOIN freq USING (term) JOIN post USING (term), st GROUP BY query_id, doc_id)
{_top('scored', 6)}""",
    "minmax_fusion": f"""WITH {_bm25()}, c AS ({_top('scored', 20)}),
m AS (SELECT query_id, doc_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5
  ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score
  FROM c WINDOW w AS (PARTITION BY query_id))
{_top('m', 6)}""",
    "scoped_search": f"""WITH {_bm25("lang = 'en' AND source IN ('src1', 'src2', 'src3')")} {_top('scored', 6)}""",
    "loose_metadata_filter": "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND lang = 'en'",
    "kb_semi_join": """SELECT doc_id, source AS knowledge_base_id FROM documents
WHERE source IN (SELECT source FROM documents WHERE lang = 'de')""",
    "local_term_score": f"""WITH q AS (SELECT item_id AS query_id, list_filter(
  string_split_regex(lower(text), '[^0-9a-z一-龥]+'), lambda t: length(t) >= 2) AS terms FROM benchmark),
d AS (SELECT doc_id, lower('doc_' || doc_id || ' ' || text) AS hay FROM documents),
s AS (SELECT query_id, doc_id, len(list_filter(terms, lambda t: contains(hay, t)))::DOUBLE AS score FROM q, d),
p AS (SELECT * FROM s WHERE score > 0) {_top('p', 6)}""",
    "fallback_union": f"""WITH {_bm25("source = 'src7' AND lang = 'es'", prefix="a_")}, {_bm25(prefix="b_")},
p AS ({_top('a_scored', 3)}), s AS ({_top('b_scored', 3)})
SELECT *, 'primary' AS source FROM p
UNION ALL SELECT *, 'fallback' FROM s WHERE query_id NOT IN (SELECT query_id FROM p)""",
    "low_quality_flag": f"""WITH {_bm25()}
SELECT query_id, max(score) AS max_score, max(score) < 40.0 AS low_quality FROM scored GROUP BY query_id""",
}
