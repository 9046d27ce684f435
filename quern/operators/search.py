"""The whole search for batches of queries: scope, score, filter, rerank, fuse, cut.

Queries may differ in tenant, organisation, knowledge bases and filters. Queries of the
same scope share their candidates and, for keywords, the statistics of these candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import is_blank
from quern.operators import bm25
from quern.operators.filters import SCORE_THRESHOLD, in_knowledge_bases, in_scope, metadata_column_matches
from quern.operators.ranking import CANDIDATES, clamp_top_k, min_max, reciprocal_rank_fusion, top_k, weighted_fusion
from quern.session import materialize

#: ``(query, record) pairs -> rerank_score``; pairs without one are dropped.
Reranker = Callable[[DataFrame], DataFrame]

#: Keys that a scope's records are dealt to; its queries are copied as often.
SALTS = 32

_SCOPE = ("tenant_id", "org_id", "knowledge_base_ids", "filters")


def valid_queries(queries: DataFrame) -> DataFrame:
    """Queries with an id and a text, with clamped ``top_k`` and the scope's key."""
    columns = queries.columns
    absent = {
        "tenant_id": F.lit(""), "org_id": F.lit(""), "top_k": F.lit(None).cast("int"),
        "knowledge_base_ids": F.array().cast("array<string>"), "filters": F.create_map().cast("map<string,string>"),
    }
    rows = queries.withColumns({k: v for k, v in absent.items() if k not in columns})
    scope = F.sha2(
        F.to_json(
            F.struct("tenant_id", "org_id", F.array_sort("knowledge_base_ids").alias("k"), F.array_sort(F.map_entries("filters")).alias("f"))
        ),
        256,
    )
    return (
        rows.filter(F.col("query_id").isNotNull() & ~is_blank(F.col("query")))
        .withColumn("top_k", clamp_top_k(F.col("top_k")))
        .withColumn("scope", scope)
    )


def scope_members(records: DataFrame, queries: DataFrame) -> DataFrame:
    """``scope, record_id`` of each record in each distinct scope, written once.

    Scopes are a stated set, as the queries are; every record's narrow columns are tested
    against them in one pass. Texts and vectors do not take part.
    """
    scopes = queries.select("scope", *(F.col(c).alias(f"_{c}") for c in _SCOPE)).dropDuplicates(["scope"])
    reserved = {
        "documentId": F.col("document_id"), "knowledgeBaseId": F.col("knowledge_base_id"), "tenantId": F.col("tenant_id"), "orgId": F.col("org_id"),
    }
    inside = (
        in_scope(F.col("_tenant_id"), F.col("_org_id"), F.col("tenant_id"), F.col("org_id"))
        & in_knowledge_bases(F.col("_knowledge_base_ids"), F.col("knowledge_base_id"))
        & metadata_column_matches(F.col("_filters"), F.col("metadata"), reserved)
    )
    narrow = records.select("record_id", "document_id", "knowledge_base_id", "tenant_id", "org_id", "metadata")
    return materialize(narrow.join(scopes, F.coalesce(inside, F.lit(False))).select("scope", "record_id"), "scopes")


def keyword_hits(records: DataFrame, members: DataFrame, queries: DataFrame) -> DataFrame:
    columns = bm25.Columns(chunk="record_id", text="content", title="title", scope="scope")
    return bm25.bm25_scores(records, queries, columns, members)


def vector_hits(
    records: DataFrame, members: DataFrame, queries: DataFrame, k: int = CANDIDATES, least: float = SCORE_THRESHOLD
) -> DataFrame:
    """The nearest candidates of each query's own scope that reach the threshold."""
    asked = queries.filter(F.size("query_vector") > 0)
    out = nearest_in_scope(records, members, asked, k, least)
    return out.select("query_id", "record_id", "score")


def nearest_in_scope(records: DataFrame, members: DataFrame, asked: DataFrame, k: int, least: float, salts: int = SALTS) -> DataFrame:
    """The nearest records within each query's scope, exactly. A scope's records are dealt to
    ``salts`` keys and its queries sent to each of them, so a scope of most records is not one
    task; adaptive execution may split a key further."""
    from quern.functions.vector import cosine, norm

    left = records.filter(F.size("vector") > 0).select("record_id", "vector", norm(F.col("vector")).alias("_vn"))
    right = asked.select("query_id", "scope", "query_vector", norm(F.col("query_vector")).alias("_qn"))
    dealt = members.withColumn("_salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int"))
    everywhere = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = left.join(dealt, "record_id").join(everywhere, ["scope", "_salt"]).filter(F.size("vector") == F.size("query_vector"))
    score = cosine(F.col("vector"), F.col("query_vector"), F.col("_vn"), F.col("_qn"))
    scored = pairs.select("query_id", "record_id", score.alias("score")).filter(F.col("score") >= least)
    return top_k(scored, k, tie="record_id")


def search(records: DataFrame, queries: DataFrame, mode: str = "keyword", *, reranker: Reranker | None = None) -> DataFrame:
    """``query_id, rank, record_id, chunk_id, title, content, score, score_source`` of the
    best ``top_k`` hits of each query.

    ``keyword``: BM25. ``vector``: cosine of at least 0.3. ``hybrid``: both lists fused by
    reciprocal ranks; queries without a vector hit take their keyword hits, which
    ``score_source`` tells. The best 20 are reranked (by nothing, without a reranker),
    their scores scaled within the query, and cut to the query's ``top_k``. Invalid queries
    have no hits.
    """
    asked = valid_queries(queries)
    members = scope_members(records, asked)
    if mode == "keyword":
        scored = keyword_hits(records, members, asked).withColumn("score_source", F.lit("keyword"))
    elif mode == "vector":
        scored = vector_hits(records, members, asked).withColumn("score_source", F.lit("vector"))
    elif mode == "hybrid":
        near = materialize(vector_hits(records, members, asked), "near")
        words = materialize(keyword_hits(records, members, asked), "words")
        served = near.select("query_id").distinct()
        both = words.join(served, "query_id", "left_semi")
        rest = words.join(served, "query_id", "left_anti").withColumn("score_source", F.lit("keyword"))
        fused = reciprocal_rank_fusion([near, top_k(both, CANDIDATES, tie="record_id").drop("rank")], tie="record_id")
        scored = fused.withColumn("score_source", F.lit("hybrid")).unionByName(rest)
    else:
        raise ValueError(f"unknown mode {mode}")
    best = top_k(scored, CANDIDATES, tie="record_id").drop("rank")
    if reranker is None:
        ranked = min_max(best).drop("score").withColumnRenamed("normalized", "score")
    else:
        texts = best.join(asked.select("query_id", "query"), "query_id").join(records.select("record_id", "content"), "record_id")
        again = reranker(texts).select("query_id", "record_id", "rerank_score")
        joined = best.withColumnRenamed("score", "retrieval_score").join(again, ["query_id", "record_id"])
        ranked = weighted_fusion(joined).drop("retrieval_score", "rerank_score")
    cut = top_k(ranked, CANDIDATES, tie="record_id").join(asked.select("query_id", "top_k"), "query_id").filter("rank <= top_k")
    shown = records.select("record_id", "chunk_id", "title", "content")
    return cut.join(shown, "record_id").select(
        "query_id", "rank", "record_id", "chunk_id", "title", "content", "score", "score_source"
    )


def lexical_reranker(pairs: DataFrame) -> DataFrame:
    """A reranker without a model: the share of the query's terms in the content."""
    from quern.functions.columns import let
    from quern.functions.text import tokenize_terms

    def share(terms, found):
        return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, found)) / F.size(terms)).otherwise(F.lit(0.0))

    score = let(tokenize_terms(F.col("query")), lambda q: let(tokenize_terms(F.col("content")), lambda d: share(q, d)))
    return pairs.withColumn("rerank_score", score)


def search_rounds(
    turns: DataFrame, find: Callable[[DataFrame], DataFrame], *, most: int = 3, least: float = 0.3
) -> DataFrame:
    """Searches of an agent's turns: the rewritten query first, then one other sub-query a
    round for turns whose hits so far do not reach the threshold; ``most`` rounds at most.

    ``turns``: query_id, rewritten, sub_queries. ``find`` maps (query_id, query) to hits with
    a score. Hits of all rounds stay, with their ``round``, and are not deduplicated. The
    loop runs on the driver; each round's hits are written, so no round is searched twice.
    """
    out = None
    others = F.filter("sub_queries", lambda q: q != F.col("rewritten"))
    waiting = turns.select("query_id", F.concat(F.array("rewritten"), others).alias("queries"))
    for number in range(most):
        asked = waiting.select("query_id", F.get("queries", F.lit(number)).alias("query")).filter("query is not null")
        hits = materialize(find(asked).withColumn("round", F.lit(number)), "round")
        out = hits if out is None else out.unionByName(hits)
        good = hits.filter(F.col("score") >= least).select("query_id").distinct()
        waiting = waiting.join(good, "query_id", "left_anti")
    return out
