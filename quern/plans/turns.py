"""Chat turns, agent loops and answers of an embedding service. Searches, tools, decisions
and services are contracts; here they are look-ups in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import fixtures
from quern.operators import agent
from quern.operators.embedding_answers import read_answers
from quern.plans.language import _NORM, _PAIRS, _PREFIX, _S, _bases, _parts, _said, _tokens

BASES = ["kb_ops", "kb_product"]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("_item"), F.lit("kb").alias("knowledge_base_id"),
        F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("title"), F.col("text").alias("content"),
    )


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user message as a turn, from its conversation to the messages for a model."""
    messages = _said(spark, sf_dir)
    turns = messages.filter("role = 'user'").select(F.col("message_id").alias("turn_id"), "conversation_id", "position", F.col("content").alias("message"))
    i = F.col("conversation_id")
    summary = F.when(i % 3 == 0, F.concat(F.lit("about "), i.cast("string"))).when(i % 3 == 1, " ")
    conversations = messages.select("conversation_id").distinct().withColumn("summary", summary)
    items = _items(spark, sf_dir)

    def find(asked):
        ranks = asked.select("query_id", "query", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
        found = ranks.join(items, F.col("_item") == F.length("query") % 50 + F.col("rank") - 1)
        return found.select("query_id", "rank", "knowledge_base_id", "title", "content", (1 / (F.col("rank") + 1)).alias("score"))

    made = agent.prepare_turns(turns, messages, conversations, find, BASES, budget=400)
    rest = F.slice("model_messages", 2, 1000)
    return made.select(
        "turn_id", "metadata.strategy", "metadata.mode", "metadata.scene", "metadata.evidence_count",
        F.array_join(F.transform("model_messages", lambda m: m["role"]), ",").alias("roles"),
        F.md5(F.array_join(F.transform(rest, lambda m: m["content"]), "|")).alias("contents_md5"),
    )


def agent_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of an agent for every user message: none to five searches, of which two may be
    refused, tools that answer, fail or are unknown, and decisions that fail."""
    turns = _said(spark, sf_dir).filter("role = 'user'").select(
        F.col("message_id").alias("turn_id"), F.col("content").alias("message"), F.lit("").alias("summary_text"),
        F.array().cast("array<struct<role:string,content:string>>").alias("history"),
    )
    conv, turn = (F.split("turn_id", ":")[k].cast("long") for k in (0, 1))
    items = _items(spark, sf_dir)
    nations = fixtures.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    def decide(state):
        s, k = (conv + turn) % 7, F.col("step")
        none = F.lit(None).cast("string")

        def act(position, tool, query, args, error=none):
            return F.struct(
                F.lit(position).alias("position"), F.lit("so").alias("thought"), tool.alias("tool"), query.alias("query"),
                args.alias("args"), error.alias("error"),
            )

        search = act(1, F.lit(agent.SEARCH), F.when(k > 1, F.concat(F.lit("step "), k.cast("string"))), none)
        tool = act(2, F.when(conv % 4 == 2, "other").otherwise("nation_of"), none, (conv % 25).cast("string"))
        broken = act(1, none, none, none, F.lit("model failed"))
        acts = F.array(
            F.when(((s <= 5) & (k <= s)) | ((s == 6) & (k == 1)), search), F.when((k == 1) & (conv % 2 == 0), tool), F.when((s == 6) & (k == 2), broken)
        )
        return state.select("turn_id", F.explode(F.filter(acts, lambda a: a.isNotNull())).alias("a")).select("turn_id", "a.*")

    def find(asked):
        found = asked.join(items, F.col("_item") == F.length("query") % 60)
        return found.select("turn_id", "position", F.lit(1).alias("rank"), "knowledge_base_id", "title", "content", F.lit(0.5).alias("score"))

    def call(asked):
        found = asked.filter("tool = 'nation_of'").join(nations, F.col("n_nationkey") == F.col("args").cast("long"))
        status = F.when(F.col("n_nationkey") % 3 == 0, "failed").otherwise("succeeded")
        return found.select("turn_id", "position", status.alias("status"), F.col("n_name").alias("summary"))

    run = agent.agent_loop(turns, decide, find, call, budget=100)
    return run.steps.select("turn_id", "step", "position", "action", F.md5("observation").alias("observation_md5"), "status")


def embedding_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors asked for by fours, with answers of which most fail in one way or another."""
    vectors = fixtures.table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") / 4).cast("long").alias("request_id"), (F.col("vec_id") % 4).cast("int").alias("i"), F.col("embedding").cast("array<float>").alias("v")
    )
    r, i = F.col("request_id"), F.col("i")
    way = r % 9
    index = F.when(way == 6, F.greatest(i, F.lit(1))).otherwise(i)
    vector = F.when((way == 7) & (i == 2), F.slice("v", 1, 3)).otherwise(F.col("v"))
    asked = vectors.groupBy("request_id").agg(
        F.array_sort(F.collect_list("i")).alias("_i"), F.collect_list(F.when((way != 5) | (i > 0), F.struct(index.alias("index"), vector.alias("embedding")))).alias("data")
    )
    sent = F.to_json(F.struct("data", F.when(way == 4, F.struct(F.lit("no").alias("message"))).alias("error")))
    status = F.when(way == 1, None).when(way == 2, (429 + r % 2 * 71 - r % 4).cast("int")).otherwise(F.lit(200))
    told = asked.select(
        "request_id", F.transform("_i", lambda k: F.concat_ws("_", F.lit("v"), (r * 4 + k).cast("string"))).alias("chunk_ids"), status.alias("status"),
        F.when(way == 3, F.concat(F.lit("{"), sent)).otherwise(sent).alias("body"),
    )
    made = read_answers(told, "served", "model")
    return made.select(
        "request_id", F.col("error.reason").alias("reason"), F.col("error.retryable").alias("retryable"),
        F.array_join(F.transform("artifacts", lambda a: F.concat_ws(":", a["chunk_id"], a["dimensions"].cast("string"))), ",").alias("made"),
    )


QUERIES = {"chat_turns": chat_turns, "agent_steps": agent_steps, "embedding_answers": embedding_answers}

ORACLE_SQL = {
    "chat_turns": f"""WITH {_PAIRS}, pc AS (SELECT *, {_tokens('t')} AS cost FROM p),
u AS (SELECT message_id, conv_id, turn, text FROM s WHERE role = 'user'),
h1 AS (SELECT u.message_id, p.position, p.t, sum(cost) OVER (PARTITION BY u.message_id ORDER BY p.position DESC ROWS UNBOUNDED PRECEDING) AS used
  FROM u JOIN pc p ON p.conversation_id = u.conv_id AND p.position < u.turn WHERE cost > 0),
h2 AS (SELECT message_id, list({{'role': 'user', 'content': t}} ORDER BY position) AS h FROM h1 WHERE used <= 400 GROUP BY 1),
h3 AS (SELECT u.message_id, s.turn, s.role, s.text, row_number() OVER (PARTITION BY u.message_id ORDER BY s.turn DESC) AS n
  FROM u JOIN s ON s.conv_id = u.conv_id AND s.turn < u.turn),
h4 AS (SELECT message_id, list({{'role': role, 'content': text}} ORDER BY turn) AS h FROM h3 WHERE n <= 6 GROUP BY 1),
t AS (SELECT u.*, {_NORM.format('text')} AS q, coalesce(h2.h, h4.h, []) AS h FROM u LEFT JOIN h2 USING (message_id) LEFT JOIN h4 USING (message_id)),
r AS (SELECT *, list_filter(h, lambda m: m.role = 'user')[-1].content AS lastt, {_parts('q')} AS parts FROM t),
f AS (SELECT *, regexp_matches(lower(q), '^{_PREFIX}') AND lastt IS NOT NULL AS fu FROM r),
w AS (SELECT *, CASE WHEN fu THEN 'followup-merge' WHEN len(parts) > 1 THEN 'multi-query' ELSE 'passthrough' END AS strategy,
  CASE WHEN fu THEN {_NORM.format("lastt || '. ' || q")} WHEN len(parts) > 1 THEN array_to_string(parts, ' ; ') ELSE q END AS rewritten FROM f),
g AS (SELECT *, {_bases("text || ' ' || rewritten", tuple(BASES))} <> '' OR len(parts) > 1
  OR regexp_matches(text, '(?i)knowledge|document|docs|wiki|manual|handbook|policy|流程|文档|知识库') AS go FROM w),
k AS (SELECT message_id, count(*) AS n, string_agg(rank || '. [kb] item_' || item_id || chr(10) || b.text || chr(10) || 'score='
  || CASE rank WHEN 1 THEN '0.50' ELSE '0.33' END, chr(10) || chr(10) ORDER BY rank) AS kb
  FROM (SELECT *, unnest([1, 2]) AS rank FROM g WHERE go) x JOIN benchmark b ON b.item_id = length(rewritten) % 50 + rank - 1 GROUP BY 1),
m AS (SELECT g.*, kb, coalesce(n, 0) AS n, CASE WHEN conv_id % 3 = 0 THEN '此前对话摘要：about ' || conv_id END AS summary,
  list_filter(h, lambda x: trim(x.content) <> '') AS said FROM g LEFT JOIN k USING (message_id))
SELECT message_id AS turn_id, strategy, CASE WHEN go THEN 'go-executor' ELSE 'ts-local' END AS mode, CASE WHEN n > 0 THEN 'kb' ELSE 'direct' END AS scene,
  n AS evidence_count, concat_ws(',', 'system', CASE WHEN summary IS NOT NULL THEN 'system' END, 'system',
    CASE WHEN len(said) > 0 THEN array_to_string(list_transform(said, lambda x: x.role), ',') END, 'user') AS roles,
  md5(concat_ws('|', summary, 'Grounding context for this answer:' || chr(10) || chr(10) || 'Rewrite query: ' || rewritten
    || coalesce(chr(10) || chr(10) || 'Knowledge context:' || chr(10) || kb, ''),
    CASE WHEN len(said) > 0 THEN array_to_string(list_transform(said, lambda x: x.content), '|') END, text)) AS contents_md5 FROM m""",
    "embedding_answers": """WITH v AS (SELECT vec_id // 4 AS request_id, vec_id, len(embedding) AS n FROM embeddings),
g AS (SELECT request_id, request_id % 9 AS way, 429 + request_id % 2 * 71 - request_id % 4 AS status, string_agg('v_' || vec_id || ':' || n, ',' ORDER BY vec_id) AS made
  FROM v GROUP BY request_id)
SELECT request_id, CASE way WHEN 1 THEN 'provider-request-failed' WHEN 2 THEN 'provider-http-error' WHEN 3 THEN 'provider-response-parse-failed'
  WHEN 4 THEN 'provider-api-error' WHEN 5 THEN 'provider-vector-count-mismatch' WHEN 6 THEN 'provider-vector-index-missing'
  WHEN 7 THEN 'provider-dimension-mismatch' END AS reason,
  CASE WHEN way = 1 THEN true WHEN way = 2 THEN status = 429 OR status >= 500 WHEN way BETWEEN 3 AND 7 THEN false END AS retryable,
  CASE WHEN way NOT BETWEEN 1 AND 7 THEN made END AS made FROM g""",
    "agent_steps": f"""WITH {_S}, u AS (SELECT message_id, conv_id, text, (conv_id + turn) % 7 AS s FROM s WHERE role = 'user'),
k AS (SELECT *, unnest(range(1, 6)) AS step FROM u),
a AS (SELECT *, CASE WHEN step = 1 THEN text ELSE 'step ' || step END AS q FROM k WHERE (s <= 5 AND step <= s) OR (s = 6 AND step = 1)),
x AS (SELECT message_id, step, 1 AS position, 'search' AS action, CASE WHEN step > 3 THEN 'No search: 3 were made. Answer from the evidence.'
  WHEN b.item_id IS NULL THEN '0 hits' ELSE '1 hits' || chr(10) || '1. [item_' || b.item_id || '] ' || substr(b.text, 1, 200) || ' (0.50)' END AS o,
  'succeeded' AS status FROM a LEFT JOIN benchmark b ON b.item_id = length(q) % 60),
y AS (SELECT message_id, 1 AS step, 2 AS position, 'call_tool' AS action, CASE WHEN conv_id % 4 = 2 THEN 'Unknown tool: other'
  WHEN n_nationkey % 3 = 0 THEN 'Failed: nation_of' ELSE 'nation_of: ' || n_name END AS o, 'succeeded' AS status
  FROM u JOIN nation ON n_nationkey = conv_id % 25 WHERE conv_id % 2 = 0),
z AS (SELECT message_id, CASE WHEN s = 6 THEN 2 WHEN s = 0 AND conv_id % 2 = 1 THEN 1 ELSE greatest(s, 1) + 1 END AS step, 0 AS position, 'final_answer' AS action,
  CASE s WHEN 6 THEN 'model failed' WHEN 5 THEN 'ended after the last step' ELSE 'answered' END AS o, CASE s WHEN 6 THEN 'failed' ELSE 'succeeded' END AS status FROM u)
SELECT message_id AS turn_id, step, position, action, md5(o) AS observation_md5, status FROM (FROM x UNION ALL FROM y UNION ALL FROM z)""",
}
