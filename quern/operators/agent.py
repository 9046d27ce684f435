"""A chat turn from its conversation to the messages for a model, and the agent's loop.

Models, searches and tools are contracts: callables from a DataFrame to a DataFrame, called
once per step for all turns that are still open. The loop runs on the driver, at most five
rounds; what a round gives is written, so nothing is asked twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import let
from quern.functions.text import estimate_tokens, is_blank
from quern.operators.conversation import (
    CONTEXT_BUDGET, GROUNDING_BUDGET, LOOP_BUDGET, RECENT_RATIO, knowledge_context, message_pairs, model_messages, prompt, tool_context,
    truncate_grounding,
)
from quern.operators.planning import retrieval_plan, rewrite_plan
from quern.session import materialize

MOST_STEPS, MOST_SEARCHES, LAST_MESSAGES = 5, 3, 6
SEARCH = "search_knowledge"
ANSWER_BUDGET = 6000
#: Texts of the messages.
SUMMARY_PREFIX = "此前对话摘要："
GROUNDING_PREFIX = "Grounding context for this answer:\n\n"
TRUNCATED = "\n\n[Context truncated to fit model limits]"

Step = Callable[[DataFrame], DataFrame]


def turn_context(turns: DataFrame, messages: DataFrame, conversations: DataFrame, budget: int = int(CONTEXT_BUDGET * RECENT_RATIO)) -> DataFrame:
    """``turns`` (turn_id, conversation_id, position, message) with ``history``,
    ``last_user_turn`` and ``summary_text``.

    The history has, oldest first, the newest pairs before the turn that fit the budget; where
    none does, the last six messages. A turn's position is that of its own message, in
    ``messages`` or after them; blank pairs are left out. Pairs and messages meet the turns
    in windows over running sums, so a conversation of many turns is not multiplied by them.
    ``conversations``: conversation_id, summary (null or blank: none).
    """
    one = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    pairs = message_pairs(messages).withColumn("cost", estimate_tokens(F.col("text"))).filter("cost > 0")
    nothing = F.lit(None).cast("struct<role:string,content:string>")
    zero = F.lit(0).cast("long")
    # a turn comes before the message of its own position
    rows = (
        turns.select("conversation_id", "position", F.lit(0).alias("kind"), "turn_id", nothing.alias("item"), zero.alias("cost"))
        .unionByName(pairs.select("conversation_id", "position", F.lit(1).alias("kind"), F.lit(None).cast(turns.schema["turn_id"].dataType).alias("turn_id"), one(F.lit("user"), F.col("text")).alias("item"), "cost"))
        .unionByName(messages.select("conversation_id", "position", F.lit(2).alias("kind"), F.lit(None).cast(turns.schema["turn_id"].dataType).alias("turn_id"), one(F.col("role"), F.col("content")).alias("item"), zero.alias("cost")))
    )
    own = Window.partitionBy("conversation_id")
    before = own.orderBy("position", "kind").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {"_spent": F.coalesce(F.sum("cost").over(before), zero), "_seen": F.count_if(F.col("kind") == 2).over(before)}
    )
    # odd numbers for items and even ones for turns keep an item of the same sum out
    rows = rows.withColumns(
        {
            "_a": 2 * F.col("_spent") + F.when(F.col("kind") == 0, 0).otherwise(1),
            "_b": 2 * F.col("_seen") + F.when(F.col("kind") == 0, 0).otherwise(1),
        }
    )
    fits = F.collect_list(F.when(F.col("kind") == 1, F.struct("position", "item"))).over(own.orderBy("_a").rangeBetween(-2 * budget, 0))
    last = F.collect_list(F.when(F.col("kind") == 2, F.struct("position", "item"))).over(own.orderBy("_b").rangeBetween(-2 * LAST_MESSAGES, 0))
    found = rows.withColumns({"_fits": fits, "_last": last}).filter("kind = 0")
    chosen = F.array_sort(F.when(F.size("_fits") > 0, F.col("_fits")).otherwise(F.col("_last")))
    history = found.select("turn_id", F.transform(chosen, lambda m: m["item"]).alias("history"))
    summaries = conversations.groupBy("conversation_id").agg(F.max("summary").alias("_summary"))
    from_user = F.filter("history", lambda m: m["role"] == "user")
    return turns.join(history, "turn_id").join(summaries, "conversation_id", "left").withColumns(
        {
            "last_user_turn": F.try_element_at(from_user, F.lit(-1))["content"],
            "summary_text": F.when(is_blank(F.col("_summary")), "").otherwise(F.concat(F.lit(SUMMARY_PREFIX), "_summary")),
        }
    ).drop("_summary")


def prepare_turns(
    turns: DataFrame, messages: DataFrame, conversations: DataFrame, find: Step, visible_bases: list[str], *,
    budget: int = int(CONTEXT_BUDGET * RECENT_RATIO),
) -> DataFrame:
    """One row per turn: ``turn_id, model_messages`` and a struct ``metadata`` (strategy,
    rewritten, mode, top_k, knowledge_base_ids, scene, evidence_count).

    ``find`` maps (query_id, query, top_k, knowledge_base_ids) of the turns that shall retrieve
    to hits (query_id, rank, knowledge_base_id, title, content, score).
    """
    planned = retrieval_plan(rewrite_plan(turn_context(turns, messages, conversations, budget)), visible_bases)
    planned = materialize(planned, "turns")
    asked = planned.filter("should_retrieve").select(
        F.col("turn_id").alias("query_id"), F.col("rewritten").alias("query"), "top_k", "knowledge_base_ids"
    )
    hits = materialize(find(asked), "hits")
    evidence = knowledge_context(hits).join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("evidence")), "query_id")
    rows = planned.join(evidence.withColumnRenamed("query_id", "turn_id"), "turn_id", "left")
    rows = rows.withColumn("_p", prompt(F.col("kb_context"), F.lit(""), F.col("message"), F.col("rewritten")))
    grounding = F.concat(F.lit(GROUNDING_PREFIX), F.array_join("_p.sections", "\n\n"))
    return rows.select(
        "turn_id",
        model_messages(F.col("_p.system_prompt"), F.col("summary_text"), grounding, F.col("history"), F.col("_p.user_prompt")).alias("model_messages"),
        F.struct(
            "strategy", "rewritten", "mode", "top_k", "knowledge_base_ids", F.col("_p.scene").alias("scene"),
            F.coalesce("evidence", F.lit(0)).alias("evidence_count"),
        ).alias("metadata"),
    )


def message_cost(message: Column) -> Column:
    """Estimated tokens of a message; what tools answer counts nothing."""
    return F.when(message["role"] == "tool", F.lit(0).cast("long")).otherwise(estimate_tokens(F.coalesce(message["content"], F.lit(""))))


def trim_messages(messages: Column, budget: int = LOOP_BUDGET, least: int = 3) -> Column:
    """``conversation.trim_history`` for an array: the second message goes, again and again,
    until the rest fits the budget or three messages are left."""

    def dropped(costs: Column) -> Column:
        total = F.aggregate(costs, F.lit(0).cast("long"), lambda s, c: s + c)
        may_go = F.slice(costs, F.lit(2), F.greatest(F.size(costs) - least, F.lit(0)))
        start = F.struct(total.alias("left"), F.lit(0).alias("n"))
        over = lambda s: s["left"] > budget
        step = lambda s, c: F.struct(F.when(over(s), s["left"] - c).otherwise(s["left"]).alias("left"), (s["n"] + over(s).cast("int")).alias("n"))
        return F.aggregate(may_go, start, step, lambda s: s["n"])

    return let(
        dropped(F.transform(messages, message_cost)),
        lambda n: F.concat(F.slice(messages, 1, 1), F.slice(messages, n + 2, F.greatest(F.size(messages), F.lit(1)))),
    )


@dataclass(frozen=True)
class AgentRun:
    """``steps``: turn_id, step, position, thought, action, query, observation, status.
    ``evidence``: the hits of all searches, with turn_id, step and position, also repeated ones.
    ``calls``: turn_id, step, position, tool_name, args, status, summary.
    ``messages``: turn_id and the trimmed messages after the last step."""

    steps: DataFrame
    evidence: DataFrame
    calls: DataFrame
    messages: DataFrame


def _observed(hits: DataFrame) -> DataFrame:
    """``turn_id, position, found``: what a search's answer shows, the best three hits."""
    best = F.slice(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "title", "content", "score")))), 1, 3)
    shown = F.transform(best, lambda h, i: F.format_string("%d. [%s] %s (%.2f)", i + 1, h["title"], F.substring(h["content"], 1, 200), h["score"]))
    return hits.groupBy("turn_id", "position").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" hits\n"), F.array_join(shown, "\n")).alias("found"))


def agent_loop(
    turns: DataFrame, decide: Step, find: Step, call: Step, *, system: str = "", steps: int = MOST_STEPS,
    searches: int = MOST_SEARCHES, budget: int = LOOP_BUDGET,
) -> AgentRun:
    """Steps of all turns (turn_id, message, history, summary_text) until each has an answer.

    ``decide`` maps open turns (turn_id, step, message, messages, searches) to actions (turn_id,
    position, thought, tool, query, args, error): none, or one with an error, ends the turn.
    ``find`` maps (turn_id, position, query) to hits (turn_id, position, rank,
    knowledge_base_id, title, content, score); ``call`` maps (turn_id, position, tool, args) to
    (turn_id, position, status, summary). A turn searches at most three times: further searches
    are refused, and the turn is told so. After each step its messages are trimmed to the
    budget. A turn that still acts in the last step is ended after it.
    """
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    first = F.concat_ws("\n\n", F.lit(system), F.when(is_blank(F.col("summary_text")), None).otherwise(F.col("summary_text")))
    start = F.concat(F.array(one("system", first)), "history", F.array(one("user", F.col("message"))))
    state = materialize(turns.select("turn_id", "message", start.alias("messages"), F.lit(0).alias("searches")), "agent")
    kept: dict[str, list[DataFrame]] = {"steps": [], "evidence": [], "calls": [], "messages": []}

    def ended(rows: DataFrame, step: int, thought: Column, observation: Column, status: str) -> DataFrame:
        return rows.select(
            "turn_id", F.lit(step).alias("step"), F.lit(0).alias("position"), thought.alias("thought"), F.lit("final_answer").alias("action"),
            F.lit(None).cast("string").alias("query"), observation.alias("observation"), F.lit(status).alias("status"),
        )

    for step in range(1, steps + 1):
        # each turn's actions in the order of their positions; their number is what a model gives at once
        acts = decide(state.withColumn("step", F.lit(step))).select("turn_id", "position", "thought", "tool", "query", "args", "error")
        order = Window.partitionBy("turn_id").orderBy("position")
        acts = acts.join(state.select("turn_id", "searches", "message"), "turn_id").withColumns(
            {
                "query": F.coalesce("query", "message"),
                "_failed": F.max(F.col("error").isNotNull()).over(Window.partitionBy("turn_id")),
                "_nth": F.col("searches") + F.count_if(F.col("tool") == SEARCH).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            }
        )
        acts = materialize(acts, "actions")
        good = acts.filter("not _failed")
        allowed = (F.col("tool") == SEARCH) & (F.col("_nth") <= searches)
        hits = materialize(find(good.filter(allowed).select("turn_id", "position", "query")), "evidence")
        called = materialize(call(good.filter(F.col("tool") != SEARCH).select("turn_id", "position", "tool", "args")), "calls")
        seen = good.join(_observed(hits), ["turn_id", "position"], "left").join(
            called.select("turn_id", "position", F.col("status").alias("_status"), "summary"), ["turn_id", "position"], "left"
        )
        observation = (
            F.when((F.col("tool") == SEARCH) & (F.col("_nth") > searches), F.lit(f"No search: {searches} were made. Answer from the evidence."))
            .when(F.col("tool") == SEARCH, F.coalesce("found", F.lit("0 hits")))
            .when(F.col("_status").isNull(), F.concat(F.lit("Unknown tool: "), "tool"))
            .when(F.col("_status") == "succeeded", F.concat_ws(": ", "tool", "summary"))
            .otherwise(F.concat(F.lit("Failed: "), "tool"))
        )
        done = materialize(
            seen.select(
                "turn_id", F.lit(step).alias("step"), "position", "thought", F.when(F.col("tool") == SEARCH, "search").otherwise("call_tool").alias("action"),
                F.when(F.col("tool") == SEARCH, F.col("query")).alias("query"), observation.alias("observation"), F.lit("succeeded").alias("status"),
            ),
            "steps",
        )
        failed = acts.filter("_failed").groupBy("turn_id").agg(F.max("error").alias("error"))
        answered = state.join(acts.select("turn_id").distinct(), "turn_id", "left_anti")
        kept["steps"] += [
            done,
            ended(answered, step, F.lit(""), F.lit("answered"), "succeeded"),
            ended(failed, step, F.lit(""), F.col("error"), "failed"),
        ]
        kept["evidence"].append(hits.withColumn("step", F.lit(step)))
        asked = good.filter(F.col("tool") != SEARCH).select("turn_id", "position", F.col("tool").alias("tool_name"), F.coalesce("args", F.lit("{}")).alias("args"))
        kept["calls"].append(asked.join(called.select("turn_id", "position", "status", "summary"), ["turn_id", "position"], "left").withColumn("step", F.lit(step)))
        # what was said in this step, and the turns that go on
        pair = F.array(one("assistant", F.coalesce("thought", F.lit(""))), one("tool", F.col("observation")))
        said = done.groupBy("turn_id").agg(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", pair.alias("m")))), lambda p: p["m"])).alias("_said"),
            F.count_if(F.col("action") == "search").alias("_more"),
        )
        kept["messages"].append(state.join(said, "turn_id", "left_anti").select("turn_id", "messages"))
        state = materialize(
            state.join(said, "turn_id").select(
                "turn_id", "message", trim_messages(F.concat("messages", "_said"), budget).alias("messages"),
                (F.col("searches") + F.col("_more")).cast("int").alias("searches"),
            ),
            "agent",
        )
        if state.isEmpty():
            break
    kept["steps"].append(ended(state, steps + 1, F.lit(""), F.lit("ended after the last step"), "succeeded"))
    kept["messages"].append(state.select("turn_id", "messages"))

    def together(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    return AgentRun(**{name: together(parts) for name, parts in kept.items()})


def answer_messages(turns: DataFrame, run: AgentRun, *, budget: int = ANSWER_BUDGET) -> DataFrame:
    """``turn_id, scene, model_messages`` for the answer: the prompt, the evidence and tool
    answers of all steps, the history and the message. Above the budget, the grounding is cut."""
    found = Window.partitionBy("turn_id").orderBy("step", "position", "rank")
    hits = run.evidence.withColumn("rank", F.row_number().over(found)).withColumnRenamed("turn_id", "query_id")
    answered = run.calls.withColumn("position", F.row_number().over(Window.partitionBy("turn_id").orderBy("step", "position"))).withColumnRenamed("turn_id", "query_id")
    rows = turns.join(knowledge_context(hits).withColumnRenamed("query_id", "turn_id"), "turn_id", "left").join(
        tool_context(answered).withColumnRenamed("query_id", "turn_id"), "turn_id", "left"
    )
    rows = rows.withColumn("_p", prompt(F.col("kb_context"), F.col("tool_context"), F.col("message"), F.col("message")))
    whole = F.concat(F.lit(GROUNDING_PREFIX), F.array_join("_p.sections", "\n\n"))
    rows = rows.withColumns({"_g": whole}).withColumn("_m", model_messages(F.col("_p.system_prompt"), F.lit(""), F.col("_g"), F.col("history"), F.col("_p.user_prompt")))
    total = F.aggregate(F.transform("_m", message_cost), F.lit(0).cast("long"), lambda s, c: s + c)
    cut = F.concat(truncate_grounding(F.col("_g"), GROUNDING_BUDGET), F.lit(TRUNCATED))
    shorter = model_messages(F.col("_p.system_prompt"), F.lit(""), cut, F.col("history"), F.col("_p.user_prompt"))
    return rows.select("turn_id", F.col("_p.scene").alias("scene"), F.when(total > budget, shorter).otherwise(F.col("_m")).alias("model_messages"))
