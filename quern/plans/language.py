"""Conversation memory, planning, prompts and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import fixtures
from quern.functions import metrics
from quern.functions.text import STOP_WORDS, estimate_tokens, keywords, looks_like_follow_up, normalize_space, sub_queries
from quern.operators import bm25, conversation, evaluation, planning
from quern.operators.ranking import top_k
from quern.plans import retrieval


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.messages(spark, sf_dir).filter("role in ('user', 'assistant')")


def message_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.message_pairs(_said(spark, sf_dir)).select(
        "conversation_id", "position", F.md5("text").alias("text_md5"), estimate_tokens(F.col("text")).alias("tokens")
    )


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = conversation.recent_context(_said(spark, sf_dir), budget=120)
    return kept.select("conversation_id", "position", "cost", "used")


def last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.last_user_turn(_said(spark, sf_dir)).select("conversation_id", F.md5("content").alias("text_md5"))


def summary_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _said(spark, sf_dir)
    marks = messages.filter("position = 1 and role = 'assistant'").select("conversation_id", "message_id")
    return conversation.needs_summary(messages, marks, budget=150)


def history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = conversation.trim_history(_said(spark, sf_dir), budget=100)
    return kept.select("conversation_id", "position", "cost")


def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = bm25.bm25_scores(fixtures.documents(spark, sf_dir), fixtures.queries(spark, sf_dir), retrieval.CHUNKS)
    best = top_k(scored.withColumn("score", F.round("score", 6)), 3, tie="doc_id")
    docs = fixtures.documents(spark, sf_dir).select("doc_id", "knowledge_base_id", "title", F.col("text").alias("content"))
    made = conversation.knowledge_context(best.join(docs, "doc_id"))
    return made.select("query_id", F.length("kb_context").alias("n_chars"), F.md5("kb_context").alias("context_md5"))


def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of queries: a third with knowledge, half with a tool answer."""
    asked = fixtures.queries(spark, sf_dir)
    kb = F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("1. [kb] x\n"), "query"))
    tool = F.when(F.col("query_id") % 2 == 0, "1. list_knowledge_bases\nargs={}\nok").otherwise("")
    made = asked.select("query_id", conversation.prompt(kb, tool, F.col("query"), F.concat("query", F.lit("!"))).alias("p"))
    return made.select("query_id", "p.scene", F.size("p.sections").alias("n_sections"), F.md5(F.array_join("p.sections", "|")).alias("sections_md5"))


def grounding_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.documents(spark, sf_dir)
    return docs.select("doc_id", F.length(conversation.truncate_grounding(F.col("text"), budget=300)).alias("n_chars"))


def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns from messages: the earlier turn is another message's text."""
    messages = _said(spark, sf_dir).filter("role = 'user'")
    turns = messages.select(
        "message_id",
        F.concat(F.when(F.col("position") % 4 == 0, "And ").otherwise(""), "content").alias("message"),
        F.when(F.col("conversation_id") % 2 == 0, F.concat(F.lit("Earlier"), "content")).alias("last_user_turn"),
    )
    return planning.rewrite_plan(turns).select("message_id", "strategy", "rewritten", F.array_join("sub_queries", "|").alias("parts"))


def follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("message_id", looks_like_follow_up(F.col("content")).alias("follow_up"))


def sub_query_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = sub_queries(F.regexp_replace("content", r"\.", "?"))
    return _said(spark, sf_dir).select("message_id", F.size(parts).alias("n"), F.array_join(parts, "|").alias("parts"))


def query_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two terms replaced with their case kept."""
    rewrite = planning.apply_mappings([("the", "THE-Term"), ("of", "from"), ("", "x")])
    return _said(spark, sf_dir).select("message_id", F.md5(rewrite("content")).alias("text_md5"))


def keyword_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.documents(spark, sf_dir)
    return docs.select("doc_id", F.array_join(planning.keyword_bases(F.col("text")), ",").alias("bases"))


def intent_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    intents = [
        {"intent_id": "i1", "priority": 3, "enabled": True, "route_expression": "/\\bidiot|clown\\b/", "knowledge_base_ids": ["kb_ops"]},
        {"intent_id": "i2", "priority": 9, "enabled": True, "route_expression": "The ", "knowledge_base_ids": ["kb_policy", "kb_ops"]},
        {"intent_id": "i3", "priority": 1, "enabled": False, "route_expression": "the", "knowledge_base_ids": []},
        {"intent_id": "i4", "priority": 1, "enabled": True, "route_expression": "/(/", "knowledge_base_ids": ["kb_ops"]},
    ]
    docs = fixtures.documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return planning.matching_intents(docs, intents).select(
        "query_id", "intent_id", "priority", F.array_join("knowledge_base_ids", ",").alias("bases")
    )


def retrieval_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _said(spark, sf_dir).select(
        "message_id", F.col("content").alias("message"), F.lit("").alias("rewritten"),
        F.array_repeat("content", (F.col("position") % 3).cast("int")).alias("sub_queries"),
        F.when(F.col("position") % 2 == 0, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("tools"),
    )
    planned = planning.retrieval_plan(turns, ["kb_ops", "kb_product"])
    return planned.select("message_id", "should_retrieve", "mode", "top_k", F.array_join("knowledge_base_ids", ",").alias("bases"))


def tool_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fixtures.table(spark, sf_dir, "orders")
    key, none = F.col("o_orderkey"), F.lit("")
    task = F.when(key % 3 != 0, F.concat(F.lit("the status of task_"), F.lpad(key.cast("string"), 6, "0"))).otherwise(none)
    setting = F.when(key % 2 == 0, F.concat(F.lit(" and rag.top"), (key % 7).cast("string"), F.lit(".k please"))).otherwise(none)
    text = F.concat(F.col("o_orderpriority"), F.lit(" order: "), task, setting)
    return orders.select("o_orderkey", planning.tool_arguments(text).alias("a")).select("o_orderkey", "a.*")


# --- evaluation --------------------------------------------------------------------------


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions; the truths are their sentences."""
    items = fixtures.table(spark, sf_dir, "benchmark")
    return items.select(
        F.col("item_id").alias("case_id"),
        F.col("text").alias("question"),
        F.filter(F.transform(F.split("text", r"\."), normalize_space), lambda x: x != "").alias("truths"),
        F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("kb_"), (F.col("item_id") % 3).cast("string"))).alias("knowledge_base_id"),
    )


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fixtures.table(spark, sf_dir, "benchmark")
    return items.select(
        F.concat(F.lit("kb_"), (F.col("item_id") % 3).cast("string")).alias("knowledge_base_id"),
        F.element_at(F.split("text", " "), 1).alias("title"), F.col("text").alias("content"), F.col("item_id").alias("corpus_pos"),
    )


def eval_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.eval_retrieve(_cases(spark, sf_dir), _corpus(spark, sf_dir))
    return found.select("case_id", F.size("retrieved").alias("n"), F.md5(F.array_join("retrieved", "|")).alias("retrieved_md5"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir)
    return evaluation.evaluate(cases, evaluation.eval_retrieve(cases, _corpus(spark, sf_dir), k=3))


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("faithfulness", "answer_relevance", "context_precision", "context_recall")
    return _results(spark, sf_dir).select("case_id", *(F.round(n, 6).alias(n) for n in names))


def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = evaluation.aggregate_metrics(_results(spark, sf_dir))
    return row.select("cases", "passed", *(F.round(n, 6).alias(n) for n in row.columns if n not in ("cases", "passed")))


def question_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.documents(spark, sf_dir)
    found = docs.select("doc_id", keywords(F.col("text")).alias("words"))  # a step of its own, so that they are found once
    return found.select("doc_id", F.size("words").alias("n"), F.md5(F.array_join(F.sort_array("words"), " ")).alias("words_md5"))


def passage_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fixtures.table(spark, sf_dir, "benchmark")
    left = items.select(F.col("item_id").alias("a"), F.col("text").alias("ta"))
    right = items.select((F.col("item_id") + 1).alias("b"), F.col("text").alias("tb"))
    pairs = left.join(right, F.col("a") == F.col("b"))
    return pairs.select("a", F.round(metrics.word_jaccard(F.lower("ta"), F.lower("tb")), 6).alias("jaccard"))


QUERIES = {
    "message_pairs": message_pairs,
    "token_budget": token_budget,
    "last_user_turn": last_user_turn,
    "summary_trigger": summary_trigger,
    "history_trim": history_trim,
    "context_assembly": context_assembly,
    "prompt_assembly": prompt_assembly,
    "grounding_truncation": grounding_truncation,
    "query_rewrite": query_rewrite,
    "follow_up": follow_up,
    "sub_query_split": sub_query_split,
    "query_mapping": query_mapping,
    "keyword_routing": keyword_routing,
    "intent_routing": intent_routing,
    "retrieval_plan": retrieval_plan,
    "tool_arguments": tool_arguments,
    "eval_retrieval": eval_retrieval,
    "eval_metrics": eval_metrics,
    "eval_aggregate": eval_aggregate,
    "question_keywords": question_keywords,
    "passage_similarity": passage_similarity,
}


def _tokens(text: str) -> str:
    return (
        f"ceil(length(regexp_replace({text}, '[^一-鿿㐀-䶿豈-﫿]', '', 'g')) / 2.0 + "
        rf"length(regexp_replace({text}, '[一-鿿㐀-䶿豈-﫿\x00-\x20]', '', 'g')) / 4.0)::BIGINT"
    )


_S = "s AS (SELECT *, conv_id || ':' || turn AS message_id FROM conversations WHERE role IN ('user', 'assistant'))"
_PAIRS = f"""{_S}, l AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM s
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id AS conversation_id, turn AS position, text || CASE WHEN r2 = 'assistant' THEN chr(10) || t2 ELSE '' END
  AS t FROM l WHERE role = 'user')"""
_NORM = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_PREFIX = "(" + "|".join(("that", "this", "it", "those", "these", "they", "he", "she", "其", "这个", "那个", "这些", "那些", "它",
                          "它们", "继续", "再", "顺便", "continue", "also", "and")) + ")"
_SPLIT = r"(?i)[?？!！;；\n]+|\s+and\s+|\s+also\s+"


def _parts(text: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex({text}, '{_SPLIT}'), lambda x: {_NORM.format('x')}), "
        "lambda x: x <> '')[1:3]"
    )


def _bases(text: str, names=tuple(planning.KNOWLEDGE_BASE_WORDS)) -> str:
    cases = []
    for name in names:
        words = ", ".join("'" + w.lower() + "'" for w in planning.KNOWLEDGE_BASE_WORDS[name])
        cases.append(f"CASE WHEN len(list_filter([{words}], lambda w: contains(lower({text}), w))) > 0 THEN '{name}' END")
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), ',')"


_STOP = "|".join(w for w in STOP_WORDS if w.isascii())
_KEYS = (
    "list_distinct(list_filter(string_split_regex(regexp_replace(regexp_replace(lower({t}), "
    rf"'\b({_STOP})\b', ' ', 'g'), '\b({_STOP})\b', ' ', 'g'), '[^a-z0-9一-鿿]+'), lambda w: length(w) >= 2))"
)
_JACCARD = (
    "CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 ELSE len(list_intersect(wa, wb))::DOUBLE / "
    "len(list_distinct(list_concat(wa, wb))) END"
)


def _words(text: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({text}), '\s+'), lambda w: length(w) >= 2))"


def _eval(k: int) -> str:
    return rf"""cs AS (SELECT item_id AS case_id, text AS question, list_filter(list_transform(string_split(text, '.'),
  lambda x: {_NORM.format('x')}), lambda x: x <> '') AS truths,
  CASE WHEN item_id % 2 = 0 THEN 'kb_' || (item_id % 3) END AS kb FROM benchmark),
ct AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(question), '[^a-z0-9]+'), lambda t: length(t) >= 2)) AS terms FROM cs),
co AS (SELECT 'kb_' || (item_id % 3) AS kb, lower(string_split(text, ' ')[1]) AS title, lower(string_split(text, ' ')[1] || ' ' || text) AS hay,
  text AS content, item_id AS pos FROM benchmark),
sc AS (SELECT case_id, content, pos, len(list_filter(terms, lambda t: contains(hay, t)))
    + 0.5 * len(list_filter(terms, lambda t: contains(title, t))) AS score FROM ct, co WHERE ct.kb IS NULL OR ct.kb = co.kb),
tk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, pos) AS n FROM sc WHERE score > 0 QUALIFY n <= {k}),
re AS (SELECT case_id, list(content ORDER BY n) AS retrieved FROM tk GROUP BY case_id),
rr AS (SELECT cs.*, coalesce(retrieved, []) AS retrieved FROM cs LEFT JOIN re USING (case_id))"""


_METRICS = rf"""{_eval(3)},
pr AS (SELECT case_id, i, j, c, t, {_words('c')} AS wa, {_words('t')} AS wb FROM (SELECT case_id, unnest(retrieved) AS c,
  generate_subscripts(retrieved, 1) AS i, truths FROM rr) a, LATERAL (SELECT unnest(a.truths) AS t, generate_subscripts(a.truths, 1) AS j)),
ok AS (SELECT case_id, i, j, contains(lower(c), lower(t)) OR contains(lower(t), substr(lower(c), 1, 200)) OR {_JACCARD} >= 0.3 AS m FROM pr),
p AS (SELECT case_id, avg(m::INT) AS context_precision FROM (SELECT case_id, i, bool_or(m) AS m FROM ok GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT case_id, avg(m::INT) AS context_recall FROM (SELECT case_id, j, bool_or(m) AS m FROM ok GROUP BY 1, 2) GROUP BY 1),
an AS (SELECT *, CASE WHEN len(retrieved) > 0 THEN 'Based on available information: ' || array_to_string(retrieved, ' ')
  ELSE 'No relevant information found to answer this question.' END AS answer FROM rr),
ke AS (SELECT case_id, answer, truths, {_KEYS.format(t='question')} AS k FROM an),
ar AS (SELECT case_id, CASE WHEN len(k) = 0 THEN 0.5 ELSE len(list_filter(k, lambda w: contains(lower(answer), w)))::DOUBLE / len(k) END
  AS answer_relevance FROM ke),
cl AS (SELECT case_id, lower(array_to_string(truths, ' ')) AS pool, claim, string_split_regex(lower(claim), '\s+') AS w,
  regexp_extract_all(claim, '\d+(?:\.\d+)?%?|[A-Z][a-z]+') AS ent FROM (SELECT case_id, truths,
  unnest(list_filter(list_transform(string_split_regex(answer, '[.。!！?？\n]+'), lambda x: trim(x, e' \t\r\n')),
  lambda x: length(x) >= 10)) AS claim FROM ke)),
cg AS (SELECT *, list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' ')) AS g FROM cl),
cv AS (SELECT case_id, CASE WHEN len(w) <= 2 THEN contains(pool, lower(claim)) ELSE greatest(
  len(list_filter(g, lambda x: contains(pool, x)))::DOUBLE / len(g),
  CASE WHEN len(ent) = 0 THEN 0.0 ELSE len(list_filter(ent, lambda e: contains(pool, lower(e))))::DOUBLE / len(ent) * 0.7 END) >= 0.3 END
  AS sup FROM cg),
fa AS (SELECT case_id, avg(sup::INT) AS faithfulness FROM cv GROUP BY 1),
me AS (SELECT case_id, round(coalesce(faithfulness, 0.0), 6) AS faithfulness, round(answer_relevance, 6) AS answer_relevance,
  round(coalesce(context_precision, 0.0), 6) AS context_precision, round(coalesce(context_recall, 0.0), 6) AS context_recall,
  coalesce(faithfulness, 0.0) AS f, answer_relevance AS a, coalesce(context_precision, 0.0) AS cp, coalesce(context_recall, 0.0) AS cr
  FROM rr LEFT JOIN fa USING (case_id) LEFT JOIN ar USING (case_id) LEFT JOIN p USING (case_id) LEFT JOIN q USING (case_id))"""

ORACLE_SQL = {
    "message_pairs": f"WITH {_PAIRS} SELECT conversation_id, position, md5(t) AS text_md5, {_tokens('t')} AS tokens FROM p",
    "token_budget": f"""WITH {_PAIRS}, c AS (SELECT *, {_tokens('t')} AS cost FROM p),
u AS (SELECT *, sum(cost) OVER (PARTITION BY conversation_id ORDER BY position DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM c)
SELECT conversation_id, position, cost, used FROM u WHERE used <= 120""",
    "last_user_turn": f"""WITH {_S} SELECT conv_id AS conversation_id, md5(arg_max(text, turn)) AS text_md5 FROM s
WHERE role = 'user' AND trim(text) <> '' GROUP BY 1""",
    "summary_trigger": f"""WITH {_S}, t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS x FROM s GROUP BY 1),
m AS (SELECT DISTINCT conv_id FROM s WHERE turn = 1 AND role = 'assistant'),
f AS (SELECT s.conv_id, count(*) FILTER (m.conv_id IS NULL OR turn > 1) AS n FROM s LEFT JOIN m ON m.conv_id = s.conv_id GROUP BY 1)
SELECT t.conv_id AS conversation_id, {_tokens('x')} AS total_tokens, n AS unsummarized, {_tokens('x')} > 150 AND n >= 4 AS needs_summary
FROM t JOIN f USING (conv_id)""",
    "history_trim": f"""WITH {_S}, c AS (SELECT conv_id, turn, {_tokens('text')} AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
  count(*) OVER (PARTITION BY conv_id) AS total FROM s),
u AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used,
  first(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM c)
SELECT conv_id AS conversation_id, turn AS position, cost FROM u WHERE n = 1 OR used + f <= 100 OR total - n + 1 <= 2""",
    "context_assembly": f"""WITH {retrieval._bm25()}, c AS ({retrieval._top('scored', 3)})
, x AS (SELECT query_id, string_agg(rank || '. [' || source || '] doc_' || doc_id || chr(10) || text || chr(10)
  || 'score=' || printf('%.2f', score), chr(10) || chr(10) ORDER BY rank) AS k
FROM c JOIN documents USING (doc_id) GROUP BY query_id)
SELECT query_id, length(k) AS n_chars, md5(k) AS context_md5 FROM x""",
    "prompt_assembly": """WITH b AS (SELECT item_id, text, CASE WHEN item_id % 3 = 0 THEN '1. [kb] x' || chr(10) || text END AS kb,
  CASE WHEN item_id % 2 = 0 THEN '1. list_knowledge_bases' || chr(10) || 'args={}' || chr(10) || 'ok' END AS tool FROM benchmark)
SELECT item_id AS query_id, CASE WHEN kb IS NOT NULL AND tool IS NOT NULL THEN 'mixed' WHEN kb IS NOT NULL THEN 'kb'
  WHEN tool IS NOT NULL THEN 'mcp' ELSE 'direct' END AS scene, 1 + (kb IS NOT NULL)::INT + (tool IS NOT NULL)::INT AS n_sections,
  md5(concat_ws('|', 'Rewrite query: ' || text || '!', 'Knowledge context:' || chr(10) || kb, 'Tool context:' || chr(10) || tool))
  AS sections_md5 FROM b""",
    "grounding_truncation": f"""WITH RECURSIVE r AS (SELECT doc_id, text AS t FROM documents UNION ALL
  SELECT doc_id, substr(t, 1, floor(length(t) * 0.8::DOUBLE)::INT) FROM r WHERE {_tokens('t')} > 300 AND length(t) > 100)
SELECT doc_id, min(length(t)) AS n_chars FROM r GROUP BY doc_id""",
    "query_rewrite": f"""WITH {_S}, t AS (SELECT message_id, {_NORM.format("(CASE WHEN turn % 4 = 0 THEN 'And ' ELSE '' END) || text")} AS q,
  CASE WHEN conv_id % 2 = 0 THEN 'Earlier' || text END AS lastt FROM s WHERE role = 'user'),
p AS (SELECT *, {_parts('q')} AS parts, regexp_matches(lower(q), '^{_PREFIX}') AND lastt IS NOT NULL AS fu FROM t)
SELECT message_id, CASE WHEN fu THEN 'followup-merge' WHEN len(parts) > 1 THEN 'multi-query' ELSE 'passthrough' END AS strategy,
  CASE WHEN fu THEN {_NORM.format("lastt || '. ' || q")} WHEN len(parts) > 1 THEN array_to_string(parts, ' ; ') ELSE q END AS rewritten,
  CASE WHEN fu THEN CASE WHEN len(parts) > 0 THEN array_to_string(parts, '|') ELSE q END WHEN len(parts) > 1
    THEN array_to_string(parts, '|') ELSE q END AS parts FROM p""",
    "follow_up": f"WITH {_S} SELECT message_id, regexp_matches(lower(trim(text)), '^{_PREFIX}') AS follow_up FROM s",
    "sub_query_split": f"""WITH {_S}, p AS (SELECT message_id, {_parts("replace(text, '.', '?')")} AS x FROM s)
SELECT message_id, len(x)::INT AS n, array_to_string(x, '|') AS parts FROM p""",
    "keyword_routing": f"SELECT doc_id, {_bases('text')} AS bases FROM documents",
    "intent_routing": r"""SELECT doc_id AS query_id, 'i1' AS intent_id, 3 AS priority, 'kb_ops' AS bases FROM documents
WHERE regexp_matches(lower(text), '(?i)\bidiot|clown\b')
UNION ALL SELECT doc_id, 'i2', 9, 'kb_policy,kb_ops' FROM documents WHERE contains(lower(text), 'the')""",
    "retrieval_plan": f"""WITH {_S}, b AS (SELECT message_id, turn, {_bases("text || ' '", ('kb_ops', 'kb_product'))} AS bases,
  regexp_matches(text, '(?i)knowledge|document|docs|wiki|manual|handbook|policy|流程|文档|知识库') AS named FROM s),
c AS (SELECT *, bases <> '' OR named OR turn % 3 > 1 AS go FROM b)
SELECT message_id, go AS should_retrieve, CASE WHEN go THEN 'go-executor' ELSE 'ts-local' END AS mode,
  CASE WHEN turn % 2 = 0 AND bases = '' THEN 4 ELSE 6 END AS top_k, bases FROM c""",
    "tool_arguments": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'task_' || lpad(o_orderkey::VARCHAR, 6, '0') END AS task_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'rag.top' || o_orderkey % 7 || '.k' END AS setting_key FROM orders""",
    "eval_retrieval": f"WITH {_eval(6)} SELECT case_id, len(retrieved)::INT AS n, md5(array_to_string(retrieved, '|')) AS retrieved_md5 FROM rr",
    "eval_metrics": f"WITH {_METRICS} SELECT case_id, faithfulness, answer_relevance, context_precision, context_recall FROM me",
    "eval_aggregate": f"""WITH {_METRICS} SELECT count(*) AS cases, count(*) FILTER (cr >= 0.5 AND a >= 0.3) AS passed,
  round(avg(f), 6) AS faithfulness, round(avg(a), 6) AS answer_relevance, round(avg(cp), 6) AS context_precision,
  round(avg(cr), 6) AS context_recall FROM me""",
    "passage_similarity": f"""WITH p AS (SELECT a.item_id AS a, {_words('a.text')} AS wa, {_words('b.text')} AS wb
  FROM benchmark a JOIN benchmark b ON a.item_id = b.item_id + 1)
SELECT a, round({_JACCARD}, 6) AS jaccard FROM p""",
    "question_keywords": f"""WITH k AS (SELECT doc_id, {_KEYS.format(t='text')} AS k FROM documents)
SELECT doc_id, len(k)::INT AS n, md5(array_to_string(list_sort(k), ' ')) AS words_md5 FROM k""",
    "query_mapping": """WITH RECURSIVE m AS (SELECT conv_id || ':' || turn AS message_id, text AS t, 0 AS k FROM conversations WHERE role IN ('user', 'assistant')
  UNION ALL SELECT message_id, regexp_replace(t, p, r, 'g'), k + 1 FROM m JOIN (VALUES (0, '\\bthe\\b', 'the-term'), (1, '\\bTHE\\b', 'THE-TERM'),
    (2, '\\b(?:The|tHe|thE|THe|ThE|tHE)\\b', 'THE-Term'), (3, '\\b(?:of|Of|oF)\\b', 'from'), (4, '\\bOF\\b', 'FROM')) AS v(n, p, r) ON n = k)
SELECT message_id, md5(t) AS text_md5 FROM m WHERE k = 5""",
}
