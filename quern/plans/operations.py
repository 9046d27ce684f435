"""Tasks, traces, dashboards and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import fixtures
from quern.functions.rules import retry_class, retry_delay_seconds, retry_tier
from quern.operators import tasks as T
from quern.operators import views
from quern.operators.filters import runnable
from quern.operators.ranking import page


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.tasks(spark, sf_dir)


def runnable_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    due = runnable(F.col("status"), F.col("next_run_at"), F.col("lease_expires_at"), now)
    return _tasks(spark, sf_dir).filter(due).select("task_id", "status")


def claim_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    claimed = T.claim(_tasks(spark, sf_dir), now, limit=100)
    return claimed.select("task_id", "claim", "status", "attempt_count", "dead_letter")


def claim_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return T.run_summary(T.claim(_tasks(spark, sf_dir), now))


def failure_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task failed in a stage, for a reason and from a source that its number gives."""
    k = F.col("k")
    rows = _tasks(spark, sf_dir).withColumns(
        {
            "failure_stage": F.when(k % 2 == 0, "embedding").otherwise("parsing"),
            "failure_reason": F.when(k % 3 == 0, "request timeout").otherwise("bad input"),
            "error_source": F.when(k % 5 == 0, "Tika server").when(k % 7 == 0, "json-store").otherwise("worker"),
            "retryable": k % 4 != 0,
        }
    )
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return T.fail(rows, now).select(
        "task_id", "status", "retry_class", "retry_tier", "retry_after_seconds", "attempts_remaining", "terminal_state",
        "terminal_reason", "dead_letter", "next_run_at",
    )


def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _tasks(spark, sf_dir)
    kind = retry_class(F.lit("indexing"), F.col("k") % 2 == 0, F.lit(""), F.col("status"))
    tier = retry_tier(kind, F.col("k") % 2 == 0)
    return events.select("task_id", kind.alias("kind"), retry_delay_seconds(F.col("k"), tier).alias("seconds"))


def idempotent_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _tasks(spark, sf_dir).withColumn("idempotency_key", F.sha2(F.concat_ws("|", "knowledge_base_id", "document_id", F.col("k").cast("string")), 256))
    finished = F.col("status").isin("succeeded", "failed")
    old, new = keyed.filter(finished), keyed.filter(~finished)
    return T.create_tasks(old, new).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("task_id").alias("tasks"), F.sum("task_id").alias("ids")
    )


def selected_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.selected_tasks(_tasks(spark, sf_dir)).select("knowledge_base_id", "document_id", "task_id", "status")


def ingestion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ingestion_statistics(_tasks(spark, sf_dir))


def recovery_drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return T.recovery_checks(_tasks(spark, sf_dir).withColumn("dead_letter", F.lit(False)), now)


def task_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tasks(spark, sf_dir).filter("status = 'failed'")
    return page(rows, [F.desc("updated_at"), F.desc("created_at"), F.asc("task_id")], 25, 3).select("task_id", "status")


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests squeezed into bursts, whole seconds of a scaled clock."""
    events = fixtures.events(spark, sf_dir)
    second = F.datediff("ts", F.lit("2024-01-01")).cast("double")
    requests = events.select(F.col("event_type").alias("client"), second.alias("at_seconds"))
    return T.token_bucket(requests).groupBy("client", "at_seconds").agg(
        F.count_if("allowed").alias("allowed"), F.count(F.lit(1)).alias("requests")
    )


# --- traces ------------------------------------------------------------------------------


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.trace_nodes(fixtures.trace_events(spark, sf_dir), F.col("event_id").cast("string"))


def trace_node_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("event_id", "node_type", "node_id", "parent_node_id", "duration_ms")


def trace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.trace_runs(_nodes(spark, sf_dir)).select("run_id", "status", "started_at", "finished_at", "duration_ms", "n_nodes")


def trace_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.run_nodes(_nodes(spark, sf_dir))
    return nodes.select("run_id", F.array_join(F.transform("nodes", lambda n: n["stage"]), ">").alias("stages"))


def trace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.trace_statistics(views.trace_runs(_nodes(spark, sf_dir)))


def trace_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.node_parents(_nodes(spark, sf_dir)).select("event_id", "parent_status")


def trace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.operators.filters import traces_matching

    nodes = _nodes(spark, sf_dir)
    runs = views.trace_runs(nodes).join(views.run_nodes(nodes), "run_id")
    return traces_matching(runs, "12:2024-01-0", "failed").select("run_id", "status")


# --- views -------------------------------------------------------------------------------


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of five messages or more are in scope; every third message has metadata."""
    messages = fixtures.messages(spark, sf_dir)
    conversations = (
        messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
        .select("conversation_id", (F.col("conversation_id") % 7).alias("user_id"))
    )
    described = messages.withColumn(
        "metadata",
        F.when(
            F.col("position") % 3 == 0,
            F.lit('{"retrievalSource": "index", "generation": {"model": "m"}, "toolCalls": [{"a": 1}, {"b": 2}]}'),
        ).when(F.col("position") % 3 == 1, F.lit('{"toolCalls": "none"}')),
    )
    sources = fixtures.documents(spark, sf_dir).select("knowledge_base_id").distinct()
    return views.dashboard(
        conversations, described, fixtures.trace_events(spark, sf_dir), sources, _tasks(spark, sf_dir)
    )


def dashboard_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dashboard_ratios(dashboard(spark, sf_dir))


def document_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = fixtures.events(spark, sf_dir).groupBy(
        F.concat(F.lit("doc_"), F.col("user_id").cast("string")).alias("document_id")
    ).agg(F.count(F.lit(1)).alias("n_chunks"))
    return views.document_view(_tasks(spark, sf_dir), counts).select(
        "knowledge_base_id", "document_id", "task_id", "status", "title", "chunk_count", "retrieval_evidence_count"
    )


def chunk_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.documents(spark, sf_dir).withColumn("chunk_index", F.lit(0))
    records = docs.filter("tenant_id = 'en'").select("chunk_id", F.concat_ws("::", "knowledge_base_id", "chunk_id").alias("record_id"))
    return views.chunk_view(docs, records).select("chunk_id", "preview", "record_id", "indexed")


def retrieval_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant messages that carry a retrieval request over two knowledge bases."""
    events = fixtures.events(spark, sf_dir)
    request = F.to_json(
        F.struct(
            F.struct(
                F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("traceId"),
                F.array(F.concat(F.lit("kb_"), (F.col("user_id") % 3).cast("string")), F.lit("kb_all")).alias("knowledgeBaseIds"),
                F.struct(F.concat(F.lit("doc_"), (F.col("user_id") % 10).cast("string")).alias("documentId")).alias("filters"),
                F.when(F.col("event_type").isin("click", "purchase"), "acme").otherwise("other").alias("tenantId"),
            ).alias("retrievalRequest")
        )
    )
    messages = events.select(
        F.when(F.col("event_type") == "view", "user").otherwise("assistant").alias("role"), request.alias("metadata"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") / 1e6)).alias("created_at"), "event_id",
    )
    found = views.retrieval_evidence(messages, "acme")
    return found.select("knowledge_base_id", "document_id", "hits", "latest_trace_id")


def intent_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = fixtures.table(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("intent_id"), F.lit(None).cast("string").alias("parent_intent_id"),
        F.col("r_name").alias("name"), F.col("r_regionkey").alias("priority"),
    )
    nations = fixtures.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("intent_id"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_intent_id"),
        F.col("n_name").alias("name"), F.col("n_nationkey").alias("priority"),
    )
    return views.intent_tree(regions.unionByName(nations)).select("intent_id", "depth", "root_id", "path")


def intent_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = fixtures.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("intent_id"), F.col("n_regionkey").cast("string").alias("parent_intent_id"),
        F.col("n_name").alias("name"), (F.col("n_nationkey") % 3).alias("priority"),
    )
    return views.intent_children(nations).select("parent_intent_id", F.array_join("children", ",").alias("children"))


def scoped_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.documents(spark, sf_dir)
    return views.scoped(docs, "en", "src4").select("document_id", "tenant_id", "org_id")


QUERIES = {
    "runnable_tasks": runnable_tasks,
    "claim_tasks": claim_tasks,
    "claim_summary": claim_summary,
    "failure_transition": failure_transition,
    "retry_delays": retry_delays,
    "idempotent_create": idempotent_create,
    "latest_task_per_document": selected_tasks,
    "ingestion_stats": ingestion_stats,
    "recovery_drill": recovery_drill,
    "task_page": task_page,
    "token_bucket": token_bucket,
    "trace_node_rules": trace_node_rules,
    "trace_rollup": trace_rollup,
    "trace_timeline": trace_timeline,
    "trace_stats": trace_stats,
    "trace_parents": trace_parents,
    "trace_filter": trace_filter,
    "dashboard": dashboard,
    "dashboard_ratios": dashboard_ratios,
    "document_view": document_view,
    "chunk_view": chunk_view,
    "retrieval_evidence": retrieval_evidence,
    "intent_tree": intent_tree,
    "intent_children": intent_children,
    "scoped_list": scoped_list,
}

_T = """t AS (SELECT event_id AS task_id, 'kb_' || (user_id % 3) AS kb, 'doc_' || user_id AS doc,
  CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'pending' END
    AS status, (props->>'$.k')::INT AS k, (props->>'$.k')::INT % 5 AS attempt_count, ts,
  ts + to_minutes((props->>'$.k')::INT) AS later FROM events)"""
_DUE = "status IN ('pending', 'running') AND later <= TIMESTAMP '2024-01-15 12:00:00'"
_CLAIM = f"""{_T}, d AS (SELECT *, {_DUE} AS due FROM t),
o AS (SELECT *, due AND row_number() OVER (PARTITION BY due ORDER BY ts DESC, task_id) <= {{limit}} AS chosen FROM d),
c AS (SELECT *, CASE WHEN NOT due THEN 'not-claimable' WHEN NOT chosen THEN 'waiting' WHEN attempt_count >= 3
  THEN 'dead-letter' ELSE 'claimed' END AS claim FROM o)"""
_N = """n AS (SELECT event_id, user_id || ':' || strftime(ts, '%Y-%m-%d') AS trace_id,
  CASE event_type WHEN 'view' THEN 'retrieval.plan' WHEN 'click' THEN 'retrieval.execute' WHEN 'purchase'
    THEN 'context.assembly' WHEN 'signup' THEN 'chat' ELSE 'generation' END AS stage,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'pending' ELSE 'succeeded' END
    AS status,
  CASE event_type WHEN 'error' THEN 5 WHEN 'click' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS rnk,
  ts AS started_at, make_timestamp(((epoch_us(ts) // 1000) + round(value)::BIGINT) * 1000) AS finished_at FROM events),
m AS (SELECT *, 'node:' || trace_id || CASE WHEN stage = 'chat' THEN ':chat:root' WHEN stage = 'generation'
    THEN ':generation:' || event_id ELSE ':' || stage || ':single' END AS node_id,
  CASE WHEN stage = 'chat' THEN NULL WHEN stage = 'retrieval.execute' THEN 'node:' || trace_id || ':retrieval.plan:single'
    ELSE 'node:' || trace_id || ':chat:root' END AS parent_node_id,
  CASE WHEN (epoch_us(finished_at) // 1000) >= (epoch_us(started_at) // 1000) THEN (epoch_us(finished_at) // 1000) - (epoch_us(started_at) // 1000) END AS duration_ms
  FROM n),
r AS (SELECT trace_id AS run_id, arg_max(status, rnk) AS status, min(started_at) AS started_at,
  max(finished_at) AS finished_at, greatest((epoch_us(max(finished_at)) // 1000) - (epoch_us(min(started_at)) // 1000), 0) AS duration_ms,
  count(*) AS n_nodes FROM n GROUP BY 1)"""
_DASH = """
conv AS (SELECT conv_id, conv_id % 7 AS u FROM conversations GROUP BY conv_id HAVING count(*) >= 5),
msg AS (SELECT c.* FROM conversations c WHERE conv_id IN (SELECT conv_id FROM conv)),
tk AS (SELECT CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running'
  ELSE 'pending' END AS status FROM events),
b AS (SELECT (SELECT count(DISTINCT u) FROM conv) AS active_users, (SELECT count(*) FROM conv) AS conversations,
  (SELECT count(*) FROM msg) AS messages, (SELECT count(*) FROM msg WHERE turn % 3 = 0) AS generated_messages,
  (SELECT count(*) FROM msg WHERE turn % 3 = 0) AS retrieval_annotated_messages,
  (SELECT 2 * count(*) FROM msg WHERE turn % 3 = 0) AS tool_calls, (SELECT count(*) FROM events) AS traces,
  (SELECT count(DISTINCT source) FROM documents) AS knowledge_bases, (SELECT count(*) FROM tk) AS ingestion_tasks,
  (SELECT count(*) FROM tk WHERE status = 'succeeded') AS ingestion_succeeded,
  (SELECT count(*) FROM tk WHERE status = 'failed') AS ingestion_failed,
  (SELECT count(*) FROM tk WHERE status = 'running') AS ingestion_running)"""

ORACLE_SQL = {
    "runnable_tasks": f"WITH {_T} SELECT task_id, status FROM t WHERE {_DUE}",
    "claim_tasks": f"""WITH {_CLAIM.format(limit=100)} SELECT task_id, claim, CASE claim WHEN 'claimed' THEN 'running'
  WHEN 'dead-letter' THEN 'failed' ELSE status END AS status, attempt_count + (claim = 'claimed')::INT AS attempt_count,
  claim = 'dead-letter' AS dead_letter FROM c""",
    "claim_summary": f"""WITH {_CLAIM.format(limit=1 << 40)} SELECT count(*) AS scanned,
  count(*) FILTER (claim = 'claimed') AS claimed, count(*) FILTER (claim = 'dead-letter') AS dead_lettered,
  count(*) FILTER (claim IN ('not-claimable', 'waiting')) AS skipped FROM c""",
    "failure_transition": f"""WITH {_T}, f AS (SELECT *, k % 4 <> 0 AS can, greatest(3 - attempt_count, 0) AS rest,
  CASE WHEN k % 4 = 0 THEN 'non-retryable' WHEN k % 5 = 0 THEN 'dependency-transient' WHEN k % 7 = 0 THEN 'store-transient'
    WHEN k % 3 = 0 THEN 'dependency-transient' WHEN k % 2 = 0 THEN 'dependency-transient' ELSE 'transient' END AS kind FROM t),
g AS (SELECT *, can AND rest > 0 AS again, can AND rest = 0 AS dead,
  CASE kind WHEN 'dependency-transient' THEN 'dependency-backoff' WHEN 'store-transient' THEN 'fast-backoff'
    ELSE 'standard-backoff' END AS tier,
  CASE kind WHEN 'dependency-transient' THEN least(15 * greatest(attempt_count, 1), 300)
    WHEN 'store-transient' THEN least(3 * greatest(attempt_count, 1), 30)
    ELSE least(5 * greatest(attempt_count, 1), 90) END AS delay FROM f)
SELECT task_id, CASE WHEN again THEN 'pending' ELSE 'failed' END AS status, kind AS retry_class,
  CASE WHEN again THEN tier ELSE 'none' END AS retry_tier, CASE WHEN again THEN delay ELSE 0 END AS retry_after_seconds,
  rest AS attempts_remaining, CASE WHEN again THEN NULL WHEN dead THEN 'dead-letter' ELSE 'terminal-failure' END AS terminal_state,
  CASE WHEN again THEN NULL WHEN dead THEN 'max-attempts-exhausted' ELSE 'non-retryable-error' END AS terminal_reason,
  dead AS dead_letter, CASE WHEN again THEN TIMESTAMP '2024-01-15 12:00:00' + to_seconds(delay) END AS next_run_at FROM g""",
    "retry_delays": f"""WITH {_T} SELECT task_id, CASE WHEN k % 2 <> 0 THEN 'non-retryable' ELSE 'dependency-transient' END
  AS kind, CASE WHEN k % 2 <> 0 THEN least(5 * greatest(k, 1), 90) ELSE least(15 * greatest(k, 1), 300) END AS seconds FROM t""",
    "idempotent_create": f"""WITH {_T}, keyed AS (SELECT *, kb || '|' || doc || '|' || k AS key FROM t),
o AS (SELECT key, task_id AS old, status AS s FROM keyed WHERE status IN ('succeeded', 'failed')
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, task_id) = 1),
n AS (SELECT key, task_id, min(task_id) OVER (PARTITION BY key) AS first FROM keyed WHERE status NOT IN ('succeeded', 'failed')),
j AS (SELECT coalesce(old, first) AS task_id, CASE WHEN old IS NULL THEN CASE WHEN task_id = first THEN 'created'
  ELSE 'reused' END WHEN s = 'succeeded' THEN 'already-succeeded' WHEN s = 'failed' THEN 'failed-needs-retry'
  ELSE 'reused' END AS outcome FROM n LEFT JOIN o USING (key))
SELECT outcome, count(*) AS n, count(DISTINCT task_id) AS tasks, sum(task_id)::BIGINT AS ids FROM j GROUP BY outcome""",
    "latest_task_per_document": f"""WITH {_T} SELECT kb AS knowledge_base_id, doc AS document_id, task_id, status FROM t
QUALIFY row_number() OVER (PARTITION BY kb, doc ORDER BY (status <> 'succeeded')::INT, ts DESC, task_id) = 1""",
    "ingestion_stats": f"""WITH {_T} SELECT count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running FROM t""",
    "recovery_drill": f"""WITH {_T} SELECT 'has-tasks' AS "check", count(*) > 0 AS ok FROM t
UNION ALL SELECT 'pending-runnable', count(*) FILTER (status = 'pending' AND {_DUE}) > 0 FROM t
UNION ALL SELECT 'running-expired', count(*) FILTER (status = 'running' AND {_DUE}) > 0 FROM t
UNION ALL SELECT 'dead-letters-failed', true UNION ALL SELECT 'finished-not-claimable', true""",
    "task_page": f"""WITH {_T} SELECT task_id, status FROM t WHERE status = 'failed'
ORDER BY ts DESC, task_id LIMIT 25 OFFSET 50""",
    "token_bucket": """WITH RECURSIVE q AS (SELECT event_type AS client,
  floor((epoch(ts) - 1704067200) / 86400)::DOUBLE AS s, count(*) AS n FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY s) AS i FROM q),
b AS (SELECT client, s, n, i, least(floor(20.0), n)::BIGINT AS allowed, 20.0::DOUBLE - least(floor(20.0), n) AS tokens
  FROM o WHERE i = 1 UNION ALL
  SELECT o.client, o.s, o.n, o.i, least(floor(least(20.0, b.tokens + (o.s - b.s) * 10)), o.n)::BIGINT,
    least(20.0, b.tokens + (o.s - b.s) * 10) - least(floor(least(20.0, b.tokens + (o.s - b.s) * 10)), o.n)
  FROM b JOIN o ON o.client = b.client AND o.i = b.i + 1)
SELECT client, s AS at_seconds, allowed, n AS requests FROM b""",
    "trace_node_rules": f"""WITH {_N} SELECT event_id, stage AS node_type, node_id, parent_node_id, duration_ms FROM m""",
    "trace_rollup": f"WITH {_N} SELECT run_id, status, started_at, finished_at, duration_ms, n_nodes FROM r",
    "trace_timeline": f"""WITH {_N} SELECT trace_id AS run_id, string_agg(stage, '>' ORDER BY started_at, node_id) AS stages
FROM m GROUP BY 1""",
    "trace_stats": f"""WITH {_N} SELECT count(*) AS runs, count(*) FILTER (status = 'succeeded') AS succeeded,
  floor(avg(duration_ms) + 0.5)::BIGINT AS mean_duration_ms FROM r""",
    "trace_parents": f"""WITH {_N}, p AS (SELECT trace_id, node_id, arg_max(status, rnk) AS s FROM m GROUP BY 1, 2)
SELECT event_id, s AS parent_status FROM m LEFT JOIN p ON p.trace_id = m.trace_id AND p.node_id = m.parent_node_id""",
    "trace_filter": f"""WITH {_N} SELECT run_id, status FROM r WHERE status = 'failed' AND (run_id LIKE '%12:2024-01-0%')""",
    "dashboard": f"WITH {_DASH} SELECT * FROM b",
    "dashboard_ratios": f"""WITH {_DASH} SELECT floor(retrieval_annotated_messages * 100.0 / messages + 0.5)::BIGINT AS retrieval_share,
  floor(ingestion_succeeded * 100.0 / ingestion_tasks + 0.5)::BIGINT AS ingestion_success FROM b""",
    "document_view": f"""WITH {_T}, c AS (SELECT 'doc_' || user_id AS doc, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY kb, doc ORDER BY (status <> 'succeeded')::INT, ts DESC, task_id) = 1)
SELECT kb AS knowledge_base_id, s.doc AS document_id, task_id, status, s.doc AS title, coalesce(n, 0) AS chunk_count,
  0 AS retrieval_evidence_count FROM s LEFT JOIN c ON c.doc = s.doc""",
    "chunk_view": """SELECT 'doc_' || doc_id AS chunk_id, CASE WHEN length(text) > 180 THEN substr(text, 1, 180) || '...' ELSE text END
  AS preview, CASE WHEN lang = 'en' THEN source || '::doc_' || doc_id END AS record_id, lang = 'en' AS indexed FROM documents""",
    "retrieval_evidence": """WITH e AS (SELECT event_id, ts, 'doc_' || (user_id % 10) AS document_id,
  unnest(['kb_' || (user_id % 3), 'kb_all']) AS knowledge_base_id FROM events WHERE event_type IN ('click', 'purchase'))
SELECT knowledge_base_id, document_id, count(*) AS hits,
  't' || arg_max(event_id, (ts + to_microseconds(event_id))) AS latest_trace_id FROM e GROUP BY 1, 2""",
    "intent_tree": """SELECT 'r' || r_regionkey AS intent_id, 0 AS depth, 'r' || r_regionkey AS root_id, r_name AS path FROM region
UNION ALL SELECT 'n' || n_nationkey, 1, 'r' || n_regionkey, r_name || '/' || n_name
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "intent_children": """SELECT n_regionkey::VARCHAR AS parent_intent_id,
  string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey % 3, n_name) AS children FROM nation GROUP BY 1""",
    "scoped_list": """SELECT 'doc_' || doc_id AS document_id, lang AS tenant_id, source AS org_id FROM documents
WHERE lang = 'en' AND source = 'src4'""",
}
