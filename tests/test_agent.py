"""Chat turns and the agent's loop against plain versions."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from quern.operators import agent

MESSAGES = "turn_id long, messages array<struct<role:string,content:string>>"


def tokens(text):
    return math.ceil(sum(0.5 if "一" <= c <= "鿿" else 0.25 if ord(c) > 32 else 0 for c in text or ""))


def trimmed(messages, budget, least=3):
    messages = list(messages)
    while sum(0 if r == "tool" else tokens(c) for r, c in messages) > budget and len(messages) > least:
        messages.pop(1)
    return messages


def test_trims_are_those_of_the_loop(spark):
    rng = random.Random(3)
    some = lambda: [(rng.choice(["user", "assistant", "tool"]), rng.choice(["", None, "x" * rng.randrange(60), "知识" * 9])) for _ in range(rng.randrange(9))]
    rows = [(i, some()) for i in range(80)]
    made = spark.createDataFrame(rows, MESSAGES).select("turn_id", agent.trim_messages(F.col("messages"), 20).alias("m"))
    got = {r.turn_id: [tuple(m) for m in r.m] for r in made.collect()}
    assert got == {i: trimmed(m, 20) for i, m in rows}


def pairs_before(messages, position):
    said = [m for m in messages if m[0] < position]
    out, i = [], 0
    while i < len(said):
        if said[i][1] == "user":
            reply = i + 1 < len(said) and said[i + 1][1] == "assistant"
            out.append((said[i][2] or "") + ("\n" + (said[i + 1][2] or "") if reply else ""))
            i += reply
        i += 1
    return out


def history_of(messages, position, budget):
    kept, used = [], 0
    for text in reversed([t for t in pairs_before(messages, position) if tokens(t)]):
        if used + tokens(text) > budget:
            break
        kept.insert(0, ("user", text))
        used += tokens(text)
    return kept or [(r, c) for p, r, c in messages if p < position][-6:]


def test_context_of_turns(spark):
    rng = random.Random(5)
    talks = {
        c: [(p, rng.choice(["user", "assistant"]), rng.choice(["", " ", "ab" * rng.randrange(1, 40), "知" * rng.randrange(1, 30)])) for p in range(rng.randrange(12))]
        for c in range(25)
    }
    messages = spark.createDataFrame(
        [(f"{c}:{p}", c, p, r, t) for c, ms in talks.items() for p, r, t in ms], "message_id string, conversation_id long, position int, role string, content string"
    )
    asked = [(f"{c}:{p}", c, p, "now") for c, ms in talks.items() for p in [m[0] for m in ms if m[1] == "user"] + [len(ms)]]
    turns = spark.createDataFrame(asked, "turn_id string, conversation_id long, position int, message string")
    conversations = spark.createDataFrame([(1, "said"), (1, None), (2, " ")], "conversation_id long, summary string")
    got = {r.turn_id: r for r in agent.turn_context(turns, messages, conversations, 20).collect()}
    assert len(got) == len(asked)
    for turn, c, p, _ in asked:
        want = history_of(talks[c], p, 20)
        assert [tuple(m) for m in got[turn].history] == want, turn
        users = [t for r, t in want if r == "user"]
        assert got[turn].last_user_turn == (users[-1] if users else None)
        assert got[turn].summary_text == ("此前对话摘要：said" if c == 1 else "")
    assert agent.turn_context(turns.filter("false"), messages, conversations).isEmpty()
    assert agent.turn_context(turns, messages.filter("false"), conversations).filter("size(history) > 0").isEmpty()


def loop(spark, plan, budget=4000, steps=5):
    """``plan``: per turn and step the actions (position, tool, query, error)."""
    seen = []
    history = [("user", "h" * 80), ("assistant", "i" * 80)]
    turns = spark.createDataFrame([(t, "ask", "", history) for t in plan], "turn_id long, message string, summary_text string, history array<struct<role:string,content:string>>")
    schema = "turn_id long, position int, thought string, tool string, query string, args string, error string"

    def decide(state):
        rows = state.collect()
        seen.extend((r.turn_id, r.step, [tuple(m) for m in r.messages], r.searches) for r in rows)
        return spark.createDataFrame([(r.turn_id, p, "t" * 40, tool, q, None, e) for r in rows for p, tool, q, e in plan[r.turn_id].get(r.step, ())], schema)

    def find(asked):
        return asked.filter("query <> 'nothing'").select(
            "turn_id", "position", F.lit(1).alias("rank"), F.lit("kb").alias("knowledge_base_id"), F.lit("T").alias("title"), F.repeat("query", F.lit(3000)).alias("content"), F.lit(0.9).alias("score")
        )

    def call(asked):
        return asked.filter("tool <> 'unknown'").select("turn_id", "position", F.when(F.col("tool") == "bad", "failed").otherwise("succeeded").alias("status"), F.lit("sum").alias("summary"))

    run = agent.agent_loop(turns, decide, find, call, system="sys", budget=budget, steps=steps)
    return turns, run, seen


S = agent.SEARCH


def test_a_turn_searches_three_times_at_most_also_within_a_step(spark):
    plan = {1: {1: [(0, S, "a", None), (1, S, "nothing", None), (2, "ok", None, None)], 2: [(5, S, "b", None), (3, S, None, None)]}, 2: {}}
    _, run, seen = loop(spark, plan)
    steps = sorted((r.turn_id, r.step, r.position, r.action, r.query, r.observation.split("\n")[0]) for r in run.steps.collect())
    refused = "No search: 3 were made. Answer from the evidence."
    assert [s for s in steps if s[0] == 1] == [
        (1, 1, 0, "search", "a", "1 hits"), (1, 1, 1, "search", "nothing", "0 hits"), (1, 1, 2, "call_tool", None, "ok: sum"),
        (1, 2, 3, "search", "ask", "1 hits"), (1, 2, 5, "search", "b", refused), (1, 3, 0, "final_answer", None, "answered"),
    ]
    assert [s for s in steps if s[0] == 2] == [(2, 1, 0, "final_answer", None, "answered")]
    assert sorted((r.step, r.position) for r in run.evidence.collect()) == [(1, 0), (2, 3)]
    assert sorted((t, k, n) for t, k, _, n in seen) == [(1, 1, 0), (1, 2, 2), (1, 3, 4), (2, 1, 0)]


def test_messages_are_trimmed_after_each_step(spark):
    plan = {1: {k: [(0, "ok", None, None), (1, "bad", None, None), (2, "unknown", None, None)] for k in range(1, 6)}}
    _, run, seen = loop(spark, plan, budget=45)
    want = [("system", "sys"), ("user", "h" * 80), ("assistant", "i" * 80), ("user", "ask")]
    for turn, step, messages, _ in seen:
        assert messages == want, step
        for text in ("ok: sum", "Failed: bad", "Unknown tool: unknown"):
            want = [*want, ("assistant", "t" * 40), ("tool", text)]
        want = trimmed(want, 45)
    assert len(seen) == 5
    assert [tuple(m) for m in run.messages.first().messages] == want
    last = run.steps.filter("action = 'final_answer'").collect()
    assert [(r.step, r.observation) for r in last] == [(6, "ended after the last step")]
    assert sorted((r.tool_name, r.status) for r in run.calls.filter("step = 1").collect()) == [("bad", "failed"), ("ok", "succeeded"), ("unknown", None)]
    assert run.calls.count() == 15


def test_a_failed_decision_ends_its_turn_alone(spark):
    plan = {1: {1: [(0, S, "a", None)], 2: [(0, S, "b", None), (1, None, None, "model down")]}, 2: {1: [(0, S, "c", None)], 2: [(0, S, "d", None)]}}
    _, run, _ = loop(spark, plan)
    got = sorted((r.turn_id, r.step, r.action, r.status, r.query or r.observation) for r in run.steps.collect())
    assert got == [
        (1, 1, "search", "succeeded", "a"), (1, 2, "final_answer", "failed", "model down"), (2, 1, "search", "succeeded", "c"),
        (2, 2, "search", "succeeded", "d"), (2, 3, "final_answer", "succeeded", "answered"),
    ]
    assert sorted(r.turn_id for r in run.messages.collect()) == [1, 2]


def test_the_grounding_of_a_long_answer_is_cut(spark):
    turns, run, _ = loop(spark, {1: {k: [(0, S, "long words here ", None)] for k in (1, 2, 3)}, 2: {1: [(0, S, "a", None), (1, "ok", None, None)]}})
    made = {r.turn_id: r for r in agent.answer_messages(turns, run).collect()}
    assert [m.role for m in made[1].model_messages] == ["system", "system", "user", "assistant", "user"]
    cut = made[1].model_messages[1].content
    assert cut.endswith(agent.TRUNCATED) and tokens(cut.removesuffix(agent.TRUNCATED)) <= 2000
    assert made[1].scene == "kb" and made[2].scene == "mixed"
    assert not made[2].model_messages[1].content.endswith(agent.TRUNCATED)
