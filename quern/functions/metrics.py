"""Evaluation metrics as Column expressions over texts and arrays of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.columns import let
from quern.functions.text import is_blank, keywords, script_trim


def _share(items: Column, test, none: float = 0.0) -> Column:
    """The share of items that pass, ``none`` where there are no items."""

    def share(i: Column) -> Column:
        n = F.coalesce(F.size(i), F.lit(0))
        return F.when(n <= 0, F.lit(none)).otherwise(F.size(F.filter(i, test)) / n)

    return let(items, share)


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of words of two characters or more."""

    def words(text: Column) -> Column:
        return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) >= 2))

    def similarity(x: Column, y: Column) -> Column:
        value = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(value)

    return let(words(a), lambda x: let(words(b), lambda y: similarity(x, y)))


def same_passage(chunk: Column, truth: Column) -> Column:
    """Whether a chunk holds the truth, the truth holds the chunk's first 200 characters,
    or three tenths of their words are shared."""
    c, t = F.lower(chunk), F.lower(truth)
    return F.contains(c, t) | F.contains(t, F.substring(c, 1, 200)) | (word_jaccard(c, t) >= 0.3)


def context_precision(retrieved: Column, truths: Column) -> Column:
    """The share of retrieved chunks that match a truth; 0 if nothing was retrieved."""
    return _share(retrieved, lambda c: F.exists(truths, lambda t: same_passage(c, t)))


def context_recall(retrieved: Column, truths: Column) -> Column:
    """The share of truths that a retrieved chunk matches; 0 without truths."""
    return _share(truths, lambda t: F.exists(retrieved, lambda c: same_passage(c, t)))


def answer_relevance(question: Column, answer: Column) -> Column:
    """The share of the question's keywords in the answer; 0.5 if it has none, 0 if either
    text is blank."""
    found = let(F.lower(answer), lambda lowered: _share(keywords(question), lambda k: F.contains(lowered, k), none=0.5))
    return F.when(is_blank(question) | is_blank(answer), F.lit(0.0)).otherwise(found)


def faithfulness(answer: Column, evidence: Column) -> Column:
    """The share of the answer's claims that the evidence supports.

    Claims are sentences of ten characters or more. A claim of two words or fewer must
    occur as it is; a longer one is supported if three tenths of its word triples occur,
    or seven tenths of the share of its numbers and capitalised words reach that.
    """
    claims = F.filter(F.transform(F.split(answer, "[.。!！?？\n]+"), script_trim), lambda s: F.length(s) >= 10)

    def supported(claim: Column, pool: Column) -> Column:
        def of_words(words: Column) -> Column:
            n = F.size(words)
            triples = F.transform(
                F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 3), " ")
            )
            entities = F.regexp_extract_all(claim, F.lit(r"(\d+(?:\.\d+)?%?|[A-Z][a-z]+)"), F.lit(1))
            by_words = _share(triples, lambda g: F.contains(pool, g))
            by_entities = _share(entities, lambda e: F.contains(pool, F.lower(e))) * 0.7
            return F.when(n <= 2, F.contains(pool, F.lower(claim))).otherwise(F.greatest(by_words, by_entities) >= 0.3)

        return let(F.split(F.lower(claim), r"\s+"), of_words)

    value = let(F.lower(F.array_join(evidence, " ")), lambda pool: _share(claims, lambda c: supported(c, pool)))
    return F.when(is_blank(answer) | (F.coalesce(F.size(evidence), F.lit(0)) <= 0), F.lit(0.0)).otherwise(value)
