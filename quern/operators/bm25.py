"""Keyword search: postings, statistics and BM25 for batches of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import tokenize_terms
from quern.session import materialize

K1, B = 1.5, 0.75
TITLE_WEIGHT = 0.3
#: Steps per unit of a score. Shares are added as whole steps: no order of additions changes a sum, and chunks of
#: equal terms have equal scores, so the id decides between them.
STEPS = float(1 << 40)


@dataclass(frozen=True)
class Columns:
    """Names of the columns that a search reads."""

    chunk: str = "chunk_id"
    text: str = "text"
    title: str | None = None
    query: str = "query_id"
    query_text: str = "query"
    #: a column of both tables: statistics are those of the chunks of the query's scope
    scope: str | None = None
    #: from a text to its distinct terms; ``segmentation.tokenizer`` adds a dictionary's words
    tokenize: Callable[[Column], Column] = tokenize_terms


def idf(n: Column, df: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5) + 1); 0 for a term no document has."""
    return F.when(df > 0, F.log((n - df + 0.5) / (df + 0.5) + 1)).otherwise(F.lit(0.0))


def term_score(idf_: Column, tf: Column, length: Column, mean: Column) -> Column:
    return F.when(mean > 0, idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))).otherwise(F.lit(0.0))


def total(share: Column) -> Column:
    """The sum of the shares of a score, whatever their order."""
    return F.sum(F.rint(share * STEPS).cast("long")) / STEPS


def terms_of(chunks: DataFrame, c: Columns = Columns()) -> DataFrame:
    """``chunk, _terms, _title_terms, _dl, _tl``: distinct terms and their numbers. The body
    is the title and the text."""
    body = F.concat_ws(" ", c.title, c.text) if c.title else F.col(c.text)
    title = c.tokenize(F.col(c.title)) if c.title else F.array().cast("array<string>")
    scope = F.col(c.scope) if c.scope else F.lit(0)
    found = chunks.select(F.col(c.chunk).alias("_chunk"), scope.alias("_scope"), c.tokenize(body).alias("_terms"), title.alias("_title_terms"))
    return found.withColumns({"_dl": F.size("_terms"), "_tl": F.size("_title_terms")})


def document_frequency(terms: DataFrame) -> DataFrame:
    """``term, df``: in how many documents each term occurs."""
    return terms.select(F.explode("_terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_statistics(terms: DataFrame) -> DataFrame:
    """Per scope: the number of documents and their mean number of distinct terms. Documents
    without terms count."""
    return terms.groupBy("_scope").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col("_dl").cast("double")).alias("_mean"))


def bm25_scores(
    chunks: DataFrame, queries: DataFrame, c: Columns = Columns(), members: DataFrame | None = None
) -> DataFrame:
    """``query, chunk, score`` for every pair with a score above 0. With a scope, either the
    chunks have its column or ``members`` lists it (``scope, chunk``); a chunk may be in several.

    Terms are sets, so a term's frequency is 1 and a document's length the number of its
    distinct terms. The title counts with a weight and the body's statistics. The chunks
    are tokenized once: postings of the queries' terms, and one marker per chunk for the
    statistics, are written to the shared folder; what follows reads only these. Queries
    and postings meet in an equi-join on the term, which Spark broadcasts if the queries
    are few.
    """
    terms = terms_of(chunks, c if members is None else replace(c, scope=None))
    scope = F.col(c.scope) if c.scope else F.lit(0)
    asked = queries.select(
        F.col(c.query).alias("_query"), scope.alias("_scope"), F.explode(c.tokenize(F.col(c.query_text))).alias("term")
    )
    wanted = asked.select(F.col("term").alias("_w")).distinct()

    def tagged(column: str, kind: str) -> Column:
        return F.transform(F.col(column), lambda t: F.struct(t.alias("term"), F.lit(kind).alias("kind")))

    # a marker per chunk counts it in the statistics; it is no term, and all of them differ, so they part in the join
    mark = F.concat(F.lit("\x00"), F.col("_chunk").cast("string"))
    marker = F.array(F.struct(mark.alias("term"), F.lit("chunk").alias("kind")))
    every = F.concat(marker, tagged("_terms", "body"), tagged("_title_terms", "title"))
    kept = ("_chunk", "_scope", "_dl", "_tl")
    rows = terms.select(*kept, F.explode(every).alias("p")).select(*kept, "p.*")
    found = materialize(
        rows.join(wanted, rows["term"] == wanted["_w"], "left").filter("_w is not null or kind = 'chunk'").drop("_w"), "postings"
    )
    if members is not None:
        own = members.select(F.col(c.scope).alias("_s"), F.col(c.chunk).alias("_c"))
        found = found.join(own, found["_chunk"] == own["_c"]).select(
            "_chunk", F.col("_s").alias("_scope"), "_dl", "_tl", "term", "kind"
        )
    postings = found.filter("kind <> 'chunk'")
    statistics = corpus_statistics(found.filter("kind = 'chunk'"))
    frequency = postings.filter("kind = 'body'").groupBy("_scope", "term").agg(F.count(F.lit(1)).alias("_df"))
    weighted = frequency.join(statistics, "_scope").select(
        "_scope", "term", idf(F.col("_n"), F.col("_df")).alias("_idf"), "_mean"
    )
    # written, so that Spark knows that the queries' side is the small one and streams the postings
    weights = materialize(asked.join(weighted, ["_scope", "term"]), "weights")
    one = F.lit(1.0)
    body = term_score(F.col("_idf"), one, F.col("_dl"), F.col("_mean"))
    title = TITLE_WEIGHT * term_score(F.col("_idf"), one, F.col("_tl"), F.col("_mean"))
    return (
        postings.join(weights, ["_scope", "term"])
        .groupBy("_query", "_chunk")
        .agg(total(F.when(F.col("kind") == "title", title).otherwise(body)).alias("score"))
        .filter("score > 0")
        .select(F.col("_query").alias(c.query), F.col("_chunk").alias(c.chunk), "score")
    )
