"""Query planning: rewriting, routing to knowledge bases, intents and tools."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import let
from quern.functions.text import looks_like_follow_up, normalize_space, sub_queries

#: Words that route a question to a knowledge base.
KNOWLEDGE_BASE_WORDS = {
    "kb_policy": (
        "policy", "policies", "compliance", "benefit", "leave", "hr", "薪资", "制度", "政策", "请假", "报销", "入职", "离职",
        "转正", "调岗", "考勤", "加班", "年假", "病假", "事假", "婚假", "产假", "差旅", "社保", "公积金", "工资", "绩效", "合同",
        "续签", "请假流程", "报销流程", "入职流程", "离职流程", "onboarding", "offboarding", "reimbursement", "attendance",
        "overtime", "payroll", "contract",
    ),
    "kb_ops": (
        "ops", "incident", "runbook", "ticket", "sla", "support", "运维", "故障", "值班", "报警", "告警", "监控", "部署", "发布",
        "回滚", "扩容", "缩容", "重启", "日志", "排查", "on-call", "pagerduty", "服务", "接口", "超时", "报错", "异常", "崩溃",
        "权限", "账号", "VPN", "服务器", "数据库", "缓存", "deploy", "rollback", "outage", "downtime", "monitor", "alert",
        "restart", "server", "database", "cache",
    ),
    "kb_product": (
        "product", "feature", "roadmap", "release", "spec", "产品", "功能", "版本", "需求", "PRD", "原型", "设计", "评审", "排期",
        "迭代", "上线", "灰度", "AB测试", "用户反馈", "埋点", "数据", "竞品", "调研", "规划", "路线图", "requirement", "design",
        "sprint", "iteration", "launch", "feedback", "analytics", "competitor",
    ),
}
#: A question that names documents is worth a search.
KNOWLEDGE_PATTERN = "(?i)knowledge|document|docs|wiki|manual|handbook|policy|流程|文档|知识库"
TASK_PATTERN = r"(?i)\b(task_[a-z0-9_-]{4,}|ing_[a-z0-9_-]{4,}|ingest_[a-z0-9_-]{4,})\b"
SETTING_PATTERN = r"(?i)\b([a-z][a-z0-9._-]{2,})\b"


def _named(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The names whose words occur in the text, in the table's order."""

    def found(lowered: Column) -> Column:
        def any_of(words) -> Column:
            condition = F.lit(False)
            for w in words:
                condition |= F.contains(lowered, F.lit(w.lower()))
            return condition

        chosen = F.array(*(F.when(any_of(words), F.lit(name)) for name, words in table.items()))
        return F.filter(chosen, lambda x: x.isNotNull())

    return let(F.lower(text), found)


def apply_mappings(mappings: list[tuple[str, str]]):
    """A Column function that replaces source terms by target terms, longest first, keeping
    the case: lower stays lower, upper stays upper, anything else is the target as given.

    ``mappings`` are the enabled ones, a small table. Arrow, since a replacement depends on
    what was matched.
    """
    prepared = []
    for source, target in sorted(mappings, key=lambda m: -len(m[0])):
        source, target = " ".join(source.split()), " ".join(target.split())
        if source and target:
            edge = r"\b" if re.search(r"[0-9A-Za-z_]", source) else ""
            prepared.append((re.compile(f"{edge}{re.escape(source)}{edge}", re.IGNORECASE | re.ASCII), target))

    def replaced(match: re.Match, target: str) -> str:
        text = match.group(0)
        return target.lower() if text.lower() == text else target.upper() if text.upper() == text else target

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        def one(text):
            for pattern, target in prepared if text is not None else ():
                text = pattern.sub(lambda m, t=target: replaced(m, t), text)
            return text

        return texts.map(one)

    return rewrite


def rewrite_plan(turns: DataFrame, mapped: Column | None = None) -> DataFrame:
    """``strategy, rewritten, sub_queries`` for ``message`` and ``last_user_turn`` (or null).

    A follow-up with an earlier turn is merged with it; a question of several parts is
    joined from them; anything else stays.
    """
    original = normalize_space(F.col("message"))
    query = normalize_space(mapped) if mapped is not None else original
    rows = turns.withColumn("_q", query).withColumn("_parts", sub_queries(F.col("_q")))
    follows = looks_like_follow_up(F.col("_q")) & F.col("last_user_turn").isNotNull()
    several = F.size("_parts") > 1
    merged = normalize_space(F.concat(F.col("last_user_turn"), F.lit(". "), F.col("_q")))
    parts = F.when(F.size("_parts") > 0, F.col("_parts")).otherwise(F.array("_q"))
    return rows.withColumns(
        {
            "strategy": F.when(follows, "followup-merge").when(several, "multi-query").otherwise("passthrough"),
            "rewritten": F.when(follows, merged).when(several, F.array_join("_parts", " ; ")).otherwise(F.col("_q")),
            "sub_queries": F.when(follows, parts).when(several, F.col("_parts")).otherwise(F.array("_q")),
        }
    ).drop("_q", "_parts")


def intent_matches(expression: str) -> tuple[str, bool]:
    """(pattern, is a regular expression) of a route expression: ``/re/flags`` with valid
    flags is one, everything else (also a path) is a piece of text."""
    text = expression.strip()
    found = re.fullmatch(r"/(.+)/([gimsuy]*)", text, re.DOTALL)
    if not found:
        return text.lower(), False
    try:
        re.compile(found.group(1))
    except re.error:
        return "", True  # never matches
    flags = "".join(f for f in found.group(2) if f in "ims") + ("" if "i" in found.group(2) else "i")
    return f"(?{flags}){found.group(1)}", True


def _compiles(engine, pattern: str) -> bool:
    """Whether the engine that will run the expression can read it."""
    try:
        engine.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def matching_intents(queries: DataFrame, intents: list[dict]) -> DataFrame:
    """``query_id, intent_id, priority, knowledge_base_ids`` of enabled intents whose route
    expression matches; intents are a small table of rules."""
    text = F.lower("query")
    out = None
    engine = queries.sparkSession._jvm.java.util.regex.Pattern
    for intent in intents:
        if not intent["enabled"] or not intent["route_expression"].strip():
            continue
        pattern, is_regex = intent_matches(intent["route_expression"])
        if is_regex and not (pattern and _compiles(engine, pattern)):
            continue  # a rule that cannot be read matches nothing and stops no other
        hit = text.rlike(pattern) if is_regex else F.contains(text, F.lit(pattern))
        item = F.when(
            hit,
            F.struct(
                F.lit(intent["intent_id"]).alias("intent_id"), F.lit(intent["priority"]).alias("priority"),
                F.array(*map(F.lit, intent["knowledge_base_ids"])).cast("array<string>").alias("knowledge_base_ids"),
            ),
        )
        out = [*(out or []), item]
    if not out:
        return queries.select("query_id").limit(0)
    found = F.filter(F.array(*out), lambda i: i.isNotNull())
    return queries.select("query_id", F.explode(found).alias("i")).select("query_id", "i.*")


def keyword_bases(text: Column) -> Column:
    """Knowledge bases whose words occur in the text, in the table's order."""
    return _named(text, KNOWLEDGE_BASE_WORDS)


def selected_tools(message: Column, tools: dict[str, tuple[str, ...]]) -> Column:
    return _named(message, tools)


def tool_arguments(message: Column) -> Column:
    """``struct<task_id, setting_key>``: a task id, and the first word with a dot."""
    task = F.regexp_extract(message, TASK_PATTERN, 1)
    words = F.filter(F.regexp_extract_all(message, F.lit(SETTING_PATTERN), F.lit(1)), lambda w: F.contains(w, F.lit(".")))
    return F.struct(
        F.when(task != "", task).alias("task_id"), F.try_element_at(words, F.lit(1)).alias("setting_key")
    )


def retrieval_plan(turns: DataFrame, visible_bases: list[str]) -> DataFrame:
    """``should_retrieve, mode, top_k, knowledge_base_ids`` from ``message, rewritten,
    sub_queries`` and, where present, ``intent_base_ids`` and ``tools``."""
    visible = F.array(*map(F.lit, visible_bases)).cast("array<string>")
    by_word = F.array_intersect(keyword_bases(F.concat_ws(" ", "message", "rewritten")), visible)
    if "intent_base_ids" in turns.columns:
        by_intent = F.array_intersect(F.array_distinct("intent_base_ids"), visible)
        chosen = F.when(F.size("intent_base_ids") > 0, by_intent).otherwise(by_word)
    else:
        chosen = by_word
    tools = F.size("tools") > 0 if "tools" in turns.columns else F.lit(False)
    rows = turns.withColumn("knowledge_base_ids", chosen)
    wanted = (F.size("knowledge_base_ids") > 0) | F.col("message").rlike(KNOWLEDGE_PATTERN)
    search = wanted | (F.size("sub_queries") > 1)
    return rows.withColumns(
        {
            "should_retrieve": search,
            "mode": F.when(search, "go-executor").otherwise("ts-local"),
            "top_k": F.when(tools & (F.size("knowledge_base_ids") == 0), 4).otherwise(6),
        }
    )


def agent_trace(turns: DataFrame, steps: Column) -> DataFrame:
    """The trace rows of a turn: one for the chat, one per step and the fixed stages, with
    previews of 500 characters."""
    def row(stage: str, text: Column) -> Column:
        return F.struct(F.lit(stage).alias("stage"), F.substring(text, 1, 500).alias("preview"))

    fixed = ("rewrite.plan", "tool.plan", "retrieval.plan", "retrieval.execute", "context.assembly", "prompt.assembly")
    own = F.transform(steps, lambda s: F.struct(F.concat(F.lit("agent.step."), s["kind"]).alias("stage"), F.substring(s["text"], 1, 500).alias("preview")))
    every = F.concat(F.array(row("chat", F.col("message"))), own, F.array(*(row(s, F.col("rewritten")) for s in fixed)))
    return turns.select("turn_id", F.posexplode(every).alias("position", "t")).select("turn_id", "position", "t.*")
