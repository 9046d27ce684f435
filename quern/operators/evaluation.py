"""Offline evaluation of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.metrics import answer_relevance, context_precision, context_recall, faithfulness
from quern.functions.text import eval_terms
from quern.operators.local import containment_scores


def eval_retrieve(cases: DataFrame, corpus: DataFrame, k: int = 6) -> DataFrame:
    """``case_id, retrieved``: contents of the best chunks of the case's knowledge base (all,
    without one): a point per query term in title or content, half a point more in the
    title; ties keep the corpus order (``corpus_pos``). The cases are a stated set: the corpus
    is read once per block of them."""
    asked = cases.select("case_id", "knowledge_base_id", eval_terms(F.col("question")).alias("terms"))
    mark = F.coalesce(F.sha2("content", 256), F.lit("none"))
    texts = corpus.select(
        F.col("knowledge_base_id").alias("_kb"), F.struct("corpus_pos", mark.alias("mark")).alias("_row"), "content",
        F.lower(F.concat_ws(" ", "title", "content")).alias("_hay"), F.lower("title").alias("_title"),
    )
    # only places and scores travel; contents are joined to the best k
    scored = containment_scores(
        texts, asked, chunk="_row", query="case_id", weights={"_hay": 1.0, "_title": 0.5}, chunk_scope="_kb", query_scope="knowledge_base_id"
    )
    window = Window.partitionBy("case_id").orderBy(F.desc("score"), "_row")
    best = scored.withColumn("n", F.row_number().over(window)).filter(F.col("n") <= k)
    best = best.join(texts.select("_row", "content").dropDuplicates(["_row"]), "_row")
    hits = best.groupBy("case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda c: c["content"]).alias("retrieved")
    )
    return cases.select("case_id").join(hits, "case_id", "left").select(
        "case_id", F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved")
    )


def template_answer(retrieved):
    return F.when(
        F.size(retrieved) > 0, F.concat(F.lit("Based on available information: "), F.array_join(retrieved, " "))
    ).otherwise(F.lit("No relevant information found to answer this question."))


def evaluate(cases: DataFrame, retrieved: DataFrame, *, against_retrieved: bool = False) -> DataFrame:
    """Four metrics per case. Faithfulness is measured against the truths, as the runs to be
    matched do, or (``against_retrieved``) against what was retrieved."""
    rows = cases.join(retrieved, "case_id").withColumn("answer", template_answer(F.col("retrieved")))
    evidence = F.col("retrieved") if against_retrieved else F.col("truths")
    return rows.select(
        "case_id",
        faithfulness(F.col("answer"), evidence).alias("faithfulness"),
        answer_relevance(F.col("question"), F.col("answer")).alias("answer_relevance"),
        context_precision(F.col("retrieved"), F.col("truths")).alias("context_precision"),
        context_recall(F.col("retrieved"), F.col("truths")).alias("context_recall"),
    )


def aggregate_metrics(results: DataFrame) -> DataFrame:
    """One row: the means, the number of cases and of those that pass (recall of a half and
    relevance of three tenths)."""
    names = ("faithfulness", "answer_relevance", "context_precision", "context_recall")
    passed = (F.col("context_recall") >= 0.5) & (F.col("answer_relevance") >= 0.3)
    return results.agg(
        *(F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names),
        F.count(F.lit(1)).alias("cases"),
        F.count_if(passed).alias("passed"),
    )
