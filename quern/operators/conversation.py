"""Conversation memory: pairs, recency budgets, summaries, context and prompt texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import estimate_tokens, is_blank
from quern.session import ship_package

CONTEXT_BUDGET = 6000
RECENT_RATIO = 0.5
LOOP_BUDGET = 4000
GROUNDING_BUDGET, GROUNDING_CHARACTERS = 2000, 100
#: Texts of the prompt.
SYSTEM_PROMPT = (
    "You are the TS orchestration layer for an enterprise RAG product. Ground answers in provided evidence, separate "
    "tool evidence from knowledge evidence, and keep the Go execution boundary replaceable."
)
SCENES = {
    "direct": "No external evidence is available. Answer conservatively and state uncertainty when needed.",
    "kb": "Use knowledge-base evidence first and avoid inventing unsupported details.",
    "mcp": "Use tool / MCP evidence first and describe it as live or operational context when relevant.",
    "mixed": "Blend knowledge-base evidence with tool / MCP evidence and make their sources distinguishable.",
}


def _order(conversation: str = "conversation_id") -> Window:
    return Window.partitionBy(conversation).orderBy("position")


def message_pairs(messages: DataFrame) -> DataFrame:
    """User messages with the assistant's reply that follows directly, as one text."""
    window = _order()
    reply = F.when(F.lead("role").over(window) == "assistant", F.concat(F.lit("\n"), F.lead("content").over(window)))
    return (
        messages.withColumn("text", F.concat("content", F.coalesce(reply, F.lit(""))))
        .filter("role = 'user'")
        .select("conversation_id", "position", "text")
    )


def fit_to_budget(items: DataFrame, budget: int, cost: Column, by: str = "conversation_id", order: str = "position") -> DataFrame:
    """The newest items whose costs, added from the newest on, stay within the budget."""
    newest = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("cost", cost).withColumn("used", F.sum("cost").over(newest)).filter(F.col("used") <= budget)


def recent_context(messages: DataFrame, budget: int = int(CONTEXT_BUDGET * RECENT_RATIO)) -> DataFrame:
    return fit_to_budget(message_pairs(messages), budget, estimate_tokens(F.col("text")))


def last_user_turn(messages: DataFrame) -> DataFrame:
    """``conversation_id, content``: the newest user message that is not blank."""
    said = messages.filter((F.col("role") == "user") & ~is_blank(F.col("content")))
    return said.groupBy("conversation_id").agg(F.max_by("content", "position").alias("content"))


def after_summary(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Messages after the last summarised one (``marks``: conversation_id, message_id); all
    messages where there is no mark or the marked one is unknown."""
    marked = messages.join(
        marks.select(F.col("conversation_id").alias("_c"), F.col("message_id").alias("_m")),
        (F.col("conversation_id") == F.col("_c")) & (F.col("message_id") == F.col("_m")),
    ).groupBy("conversation_id").agg(F.min("position").alias("_at"))
    return messages.join(marked, "conversation_id", "left").filter(
        F.col("_at").isNull() | (F.col("position") > F.col("_at"))
    ).drop("_at")


def needs_summary(messages: DataFrame, marks: DataFrame, budget: int = CONTEXT_BUDGET, least: int = 4) -> DataFrame:
    """``conversation_id, total_tokens, unsummarized, needs_summary``: more tokens than the
    budget and at least four messages since the last summary."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda m: m["content"]), "\n")
    total = messages.groupBy("conversation_id").agg(joined.alias("_t")).select("conversation_id", estimate_tokens(F.col("_t")).alias("total_tokens"))
    fresh = after_summary(messages, marks).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("unsummarized"))
    n = F.coalesce("unsummarized", F.lit(0))
    return total.join(fresh, "conversation_id", "left").select(
        "conversation_id", "total_tokens", n.alias("unsummarized"),
        ((F.col("total_tokens") > budget) & (n >= least)).alias("needs_summary"),
    )


def trim_history(messages: DataFrame, budget: int = LOOP_BUDGET, least: int = 3) -> DataFrame:
    """Drop the second message, again and again, until the rest fits the budget or three
    messages are left: the first stays and of the others the newest that fit."""
    window = _order()
    rows = messages.withColumns(
        {
            "n": F.row_number().over(window),
            "cost": estimate_tokens(F.col("content")),
            "total": F.count(F.lit(1)).over(Window.partitionBy("conversation_id")),
        }
    )
    first = F.first("cost").over(window)
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_first", first).withColumn("_used", F.sum("cost").over(newest))
    from_end = F.col("total") - F.col("n") + 1
    keep = (F.col("n") == 1) | (F.col("_used") + F.col("_first") <= budget) | (from_end <= least - 1)
    return rows.filter(keep).select(*messages.columns, "cost")


def truncate_grounding(text: Column, budget: int = GROUNDING_BUDGET, least: int = GROUNDING_CHARACTERS) -> Column:
    """The text cut to four fifths, again and again, until it fits or is 100 characters.

    Estimates of all its beginnings are had from one pass over the text's characters.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None or len(text) <= least:
                return text
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            quarters = np.cumsum(_quarters(points))
            n = len(points)
            while n > least and quarters[n - 1] > 4 * budget:
                n = int(n * 0.8)
            return text[:n]

        return texts.map(one, na_action="ignore").astype(object).where(texts.notna(), None)

    ship_package(SparkSession.active())
    return cut(text)


def _quarters(points: np.ndarray) -> np.ndarray:
    """The quarters of a token that ``text.token_units`` gives each character."""
    cjk = ((points >= 0x4E00) & (points <= 0x9FFF)) | ((points >= 0x3400) & (points <= 0x4DBF)) | ((points >= 0xF900) & (points <= 0xFAFF))
    return np.where(cjk | (points >= 0x10000), 2, (points > 0x20).astype(np.int64))


def knowledge_context(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """``query, kb_context``: numbered blocks of base, title, content and score."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "knowledge_base_id", "title", "content", "score")))
    blocks = F.transform(
        ordered,
        lambda h, i: F.concat(
            (i + 1).cast("string"), F.lit(". ["), h["knowledge_base_id"], F.lit("] "), h["title"], F.lit("\n"), h["content"],
            F.lit("\nscore="), F.format_string("%.2f", h["score"]),
        ),
    )
    return hits.groupBy(by).agg(F.array_join(blocks, "\n\n").alias("kb_context"))


def tool_context(calls: DataFrame, by: str = "query_id") -> DataFrame:
    """``query, tool_context`` from ``position, tool_name, args`` (JSON) and ``summary``."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "tool_name", "args", "summary")))
    blocks = F.transform(
        ordered,
        lambda c, i: F.concat(
            (i + 1).cast("string"), F.lit(". "), c["tool_name"], F.lit("\nargs="), c["args"], F.lit("\n"),
            F.coalesce(c["summary"], F.lit("tool output placeholder")),
        ),
    )
    return calls.groupBy(by).agg(F.array_join(blocks, "\n\n").alias("tool_context"))


def scene(kb: Column, tool: Column) -> Column:
    has_kb, has_tool = F.coalesce(kb, F.lit("")) != "", F.coalesce(tool, F.lit("")) != ""
    return F.when(has_kb & has_tool, "mixed").when(has_kb, "kb").when(has_tool, "mcp").otherwise("direct")


def prompt(kb: Column, tool: Column, message: Column, rewritten: Column) -> Column:
    """``struct<scene, system_prompt, user_prompt, sections>``."""
    kind = scene(kb, tool)
    note = F.lit(SCENES["direct"])
    for name, text in SCENES.items():
        note = F.when(kind == name, text).otherwise(note)
    sections = F.array(
        F.concat(F.lit("Rewrite query: "), rewritten),
        F.when(F.coalesce(kb, F.lit("")) != "", F.concat(F.lit("Knowledge context:\n"), kb)),
        F.when(F.coalesce(tool, F.lit("")) != "", F.concat(F.lit("Tool context:\n"), tool)),
    )
    return F.struct(
        kind.alias("scene"),
        F.concat(F.lit(f"{SYSTEM_PROMPT}\n\nScene: "), kind, F.lit("\n"), note).alias("system_prompt"),
        message.alias("user_prompt"),
        F.filter(sections, lambda s: s.isNotNull()).alias("sections"),
    )


def model_messages(system: Column, summary: Column, context: Column, history: Column, user: Column) -> Column:
    """``array<struct<role, content>>``: system, summary, context, history, user; blank
    parts are left out."""
    def one(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("content"))

    head = F.array(one("system", system), one("system", summary), one("system", context))
    return F.filter(F.concat(head, history, F.array(one("user", user))), lambda m: ~is_blank(m["content"]))


def first_grounding_line(context: Column) -> Column:
    lines = F.filter(F.split(context, "\n"), lambda x: ~is_blank(x))
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
