"""Operators on small tables with known results."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.operators import bm25, chunking, conversation, filters, indexing, knn, planning, ranking, tasks, views
from quern.sources import parsers
from quern.sources.stores import TableStore, ndjson, project_task, stream_pieces

# --- search ------------------------------------------------------------------------------


def scores(spark, texts, query, titles=None):
    rows = [(f"c{k}", titles[k] if titles else "", t) for k, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id string, title string, text string")
    queries = spark.createDataFrame([("q", query)], "query_id string, query string")
    columns = bm25.Columns(title="title") if titles else bm25.Columns()
    return {r.chunk_id: r.score for r in bm25.bm25_scores(chunks, queries, columns).collect()}


def test_bm25_properties(spark):
    got = scores(spark, ["rare common", "common other", "common", "common thing"], "rare common")
    assert got["c0"] == max(got.values())
    short = scores(spark, ["term", "term with many other words here", "zzz"], "term")
    assert short["c0"] > short["c1"] and "c2" not in short
    assert scores(spark, ["same " * 50, "same"], "same")["c0"] == pytest.approx(scores(spark, ["same", "same"], "same")["c0"])


def test_chinese_search_and_title_boost(spark):
    got = scores(spark, ["休假政策：员工请假需要提前申请", "打卡规则：每天九点", "薪资发放日期"], "请假流程怎么走")
    assert max(got, key=got.get) == "c0" and all(s > 0 for s in got.values())
    titled = scores(spark, ["same body", "same body"], "rollback", ["rollback", "other"])
    assert set(titled) == {"c0"}


def test_bm25_statistics(spark):
    terms = bm25.terms_of(spark.createDataFrame([("1", "aa bb"), ("2", "bb cc"), ("3", "")], "chunk_id string, text string"))
    assert {r.term: r.df for r in bm25.document_frequency(terms).collect()} == {"aa": 1, "bb": 2, "cc": 1}
    assert tuple(bm25.corpus_statistics(terms).first()) == (0, 3, pytest.approx(4 / 3))


def test_ranking(spark):
    rows = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 3.0), ("p", "x", 2.0)], "query_id string, chunk_id string, score double")
    top = {(r.query_id, r.chunk_id): r["rank"] for r in ranking.top_k(rows, 2).collect()}
    assert top == {("q", "c"): 1, ("q", "a"): 2, ("p", "x"): 1}
    scaled = {r.chunk_id: r.normalized for r in ranking.min_max(rows).collect()}
    assert scaled == {"a": 0.0, "b": 0.0, "c": 1.0, "x": 0.5}
    fused = {r.chunk_id: r.score for r in ranking.reciprocal_rank_fusion([rows, rows.filter("chunk_id = 'a'")]).collect()}
    assert fused["a"] == pytest.approx(1 / 62 + 1 / 61)
    both = ranking.with_fallback(rows.filter("query_id = 'p'"), rows.filter("chunk_id <> 'b'"))
    assert sorted((r.query_id, r.chunk_id, r.source) for r in both.collect()) == [
        ("p", "x", "primary"), ("q", "a", "fallback"), ("q", "c", "fallback"),
    ]
    clamped = spark.createDataFrame([(0,), (-1,), (None,), (5,), (99,)], "k int").select(ranking.clamp_top_k(F.col("k")))
    assert [r[0] for r in clamped.collect()] == [6, 6, 6, 5, 20]


@pytest.mark.parametrize("block", [1000, 2])
def test_nearest(spark, block):
    rng = random.Random(3)
    vectors = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(40)] + [(50, []), (51, [1.0])]
    records = spark.createDataFrame(vectors, "record_id int, vector array<float>")
    queries = records.filter("record_id % 8 = 0 and size(vector) = 4").select(F.col("record_id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = knn.nearest(records, queries, 3, block=block).collect()
    firsts = {r.query_id: r.record_id for r in got if r["rank"] == 1}
    assert firsts == {q: q for q in range(0, 40, 8)} and all(r.score >= 0.3 for r in got)
    assert tuple(knn.dimension_report(records, 4).first()) == (40, 1, 1)


# --- filters -----------------------------------------------------------------------------


def test_metadata_filters(spark):
    rows = spark.createDataFrame(
        [(1, "d1", {"section": " Policy ", "n": "7"}), (2, "d2", {"section": "ops"}), (3, "d1", None)],
        "id int, document_id string, metadata map<string,string>",
    )

    def ids(wanted):
        return [r.id for r in rows.filter(filters.metadata_matches(wanted, F.col("metadata"))).collect()]

    assert ids({"section": "policy"}) == [1] and ids({"n": 7, "section": "POLICY"}) == [1]
    assert ids({"documentId": "d1"}) == [1, 3] and ids({"documentId": " "}) == [1, 2, 3]
    assert ids({"missing": "x"}) == [] and ids({}) == [1, 2, 3]
    asked = rows.withColumn("f", F.create_map(F.lit("section"), F.lit("OPS"), F.lit("documentId"), F.lit("d2")))
    found = asked.filter(filters.metadata_column_matches(F.col("f"), F.col("metadata"), {"documentId": F.col("document_id")}))
    assert [r.id for r in found.collect()] == [2]
    exact = rows.filter(filters.exact_metadata_matches({"section": "ops"}, F.col("metadata")))
    assert [r.id for r in exact.collect()] == [2]


def test_scopes_and_guards(spark):
    rows = spark.createDataFrame([("t", "o"), ("t", None), ("u", "o")], "t string, o string")

    def n(condition):
        return rows.filter(condition).count()

    assert n(filters.in_scope(F.lit("t"), F.lit(""), F.col("t"), F.col("o"))) == 2
    assert n(filters.in_control_scope(F.lit("t"), F.lit("o"), F.col("t"), F.col("o"))) == 1
    assert n(filters.in_control_scope(F.lit("t"), F.lit(None), F.col("t"), F.col("o"))) == 2
    actor = F.struct(F.lit("u1").alias("user_id"), F.lit("admin").alias("role"), F.col("t").alias("tenant_id"), F.col("o").alias("org_id"))
    assert [n(filters.guard(actor, g)) for g in ("public", "signed-in", "tenant", "org", "admin")] == [3, 3, 3, 2, 3]
    assert n(filters.in_knowledge_bases(F.array().cast("array<string>"), F.col("t"))) == 3
    assert n(filters.in_knowledge_bases(F.array(F.lit("u")), F.col("t"))) == 1


# --- chunking ----------------------------------------------------------------------------


def plain_windows(text, target, overlap):
    out, cursor = [], 0
    while cursor < len(text):
        end = min(cursor + target, len(text))
        part = text[cursor:end].strip(" \n\t")
        if part:
            at = cursor + text[cursor:end].index(part)
            out.append((part, at, at + len(part)))
        if end == len(text):
            break
        cursor = end - overlap
    return out


def test_windows(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab  \n", k=rng.randint(1, 120))) for _ in range(60)] + ["x" * 30]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", chunking.window_segments(F.col("t"), 20, 6).alias("s")).orderBy("k").collect()
    assert [[(s.text, s.start, s.stop) for s in r.s] for r in got] == [plain_windows(t, 20, 6) for t in texts]


def test_chunk_parameters():
    assert chunking.chunk_parameters(0, -3) == (1200, 0)
    assert chunking.chunk_parameters(100, 100) == (100, 25)
    assert chunking.chunk_parameters(None, None) == (1200, 0)


def test_byte_windows_and_sections(spark):
    df = spark.createDataFrame([("d", "ééé abc", [("s1", "", 0, 4), ("s2", "T", 4, 10)])], "document_id string, text string, sections array<struct<section_id:string,title:string,start_offset:int,end_offset:int>>")
    rows = chunking.chunk_documents(df, "recursive", target=4, sections="sections", unit="byte").collect()
    assert [(r.text, r.start, r.stop, r.section_path) for r in rows] == [("éé", 0, 4, ["s1"]), ("é a", 4, 8, ["T"]), ("bc", 8, 10, ["T"])]
    assert chunking.chunk_documents(df.withColumn("text", F.lit("  ")), "paragraph").count() == 0


def plain_blocks(text):
    """The splitter line by line."""
    import re

    tests = (("heading", chunking.HEADING), ("qa", chunking.QUESTION), ("divider", chunking.DIVIDER), ("list", chunking.NUMBERED), ("list", chunking.BULLET))
    blocks, held, kind, code = [], [], "paragraph", False

    def flush():
        body = "\n".join(held).strip()
        if body:
            blocks.append((kind, body))
        held.clear()

    for line in text.split("\n"):
        t = line.strip()
        if t.startswith("```"):
            if not code:
                flush()
                code, kind = True, "code"
                held.append(line)
            else:
                held.append(line)
                flush()
                code, kind = False, "paragraph"
            continue
        if code:
            held.append(line)
            continue
        if not t:
            if kind == "paragraph" and held:
                flush()
            elif held:
                held.append(line)
            continue
        own = next((k for k, p in tests if re.match(p, t)), "paragraph")
        if own == kind and own not in ("heading", "divider"):
            held.append(line)
            continue
        if held:
            flush()
        kind = own
        held.append(line)
    flush()
    return blocks


def test_structural_blocks(spark):
    rng = random.Random(11)
    pool = ["# Head", "- item", "1. one", "text line", "more text", "", "  ", "---", "Q: why", "```", "code()", "一、项目", "FAQ：x"]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(300)]
    df = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "document_id string, text string")
    got = {}
    for r in chunking.structural_blocks(df).orderBy("document_id", "block").collect():
        got.setdefault(r.document_id, []).append((r.type, r.text))
        data = texts[int(r.document_id[1:])].encode()[r.start : r.stop].decode()
        assert data.strip() == r.text
    for k, t in enumerate(texts):
        assert got.get(f"d{k}", []) == plain_blocks(t), t


def test_merge_and_breakpoints(spark):
    spans = [("A。", 0, 4), ("B。", 4, 8), ("C。", 8, 12)]
    df = spark.createDataFrame([(spans,)], "s array<struct<text:string,start:int,stop:int>>")

    def merged(breaks, target=100):
        array = F.array(*map(F.lit, breaks)).cast("array<int>")
        return [(x.text, x.start, x.stop) for x in df.select(chunking.merge_sentences(F.col("s"), array, target)).first()[0]]

    assert merged([]) == [("A。B。C。", 0, 12)]
    assert merged([2]) == [("A。B。", 0, 8), ("C。", 8, 12)]
    assert merged([], target=4) == [("A。B。", 0, 8), ("C。", 8, 12)]
    vectors = [("d", 0, [1.0, 0.0, 0.0]), ("d", 1, [0.9, 0.1, 0.0]), ("d", 2, [0.0, 1.0, 0.0]), ("d", 3, [0.0, 0.9, 0.1])]
    points = chunking.semantic_breakpoints(spark.createDataFrame(vectors, "d string, i int, vector array<double>"), "d", "i")
    assert [r.i for r in points.filter("breaks").collect()] == [2]


def test_split_list():
    text = "- one\n- two is long\n- three"
    assert chunking.split_list(text, 10, 40, 12) == [("- one", 10, 16), ("- two is long", 16, 30), ("- three", 30, 40)]
    assert chunking.split_list("- single", 0, 8, 3) is None


# --- index -------------------------------------------------------------------------------

RECORD = "record_id string, knowledge_base_id string, document_id string, chunk_id string, chunk_index int, title string, content string"


def test_upsert(spark):
    old = spark.createDataFrame([("r1", "k", "d", "c1", 0, "t", "a"), ("r2", "k", "d", "c2", 1, "t", "b"), ("", "k", "d", "c3", 2, "t", "c")], RECORD)
    new = spark.createDataFrame(
        [("r1", "k", "d", "c1", 0, "t", "a"), ("r2", "k", "d", "c2", 1, "t", "B"), (" ", "k", "d", "c3", 2, "t", "C"), ("r4", "k", "d", "c4", 3, "t", "d")], RECORD
    )
    got = {r.chunk_id: (r.action, r.content) for r in indexing.classify_upsert(old, new).collect()}
    assert got == {"c1": ("skipped", "a"), "c2": ("replaced", "B"), "c3": ("replaced", "C"), "c4": ("inserted", "d")}
    assert tuple(indexing.write_summary(indexing.classify_upsert(old, new)).first()) == (3, 1, 2, 4)
    rest, counts = indexing.delete_records(old, "k", "d")
    assert rest.count() == 0 and counts.first().deleted == 3


def test_embedding_fallback_and_hits(spark):
    chunks = spark.createDataFrame([("d", f"d_chunk_{k}", k, f"text {k}", 6) for k in range(4)], "document_id string, chunk_id string, chunk_index int, text string, char_count int")
    inputs = indexing.embedding_inputs(chunks)

    def flaky(rows):
        made = indexing.deterministic_provider(rows, "other")
        return made.withColumn("vector", F.when(F.endswith("chunk_id", F.lit("1")), F.array().cast("array<float>")).otherwise(F.col("vector")))

    got = {r.chunk_id: (r.embedding_source, len(r.vector)) for r in indexing.embed(inputs, flaky).collect()}
    assert got["d_chunk_1"] == ("deterministic-fallback", 8) and got["d_chunk_0"] == ("provider", 8) and len(got) == 4
    records = spark.createDataFrame([("r", " ", "k", "d", "t", None, {"a": "b"})], "record_id string, chunk_id string, knowledge_base_id string, document_id string, tenant_id string, org_id string, metadata map<string,string>")
    hit = indexing.annotate_hits(indexing.record_chunks(records), "go", "local", "timeout").first()
    assert hit.chunk_id == "r" and hit.metadata["fallbackReason"] == "timeout" and "orgId" not in hit.metadata
    back = indexing.from_payload(indexing.payload(records.withColumn("vector", F.array(F.lit(1.0)))))
    assert back.first().metadata == {"a": "b"}


# --- tasks -------------------------------------------------------------------------------

TASK = "task_id string, status string, attempt_count int, max_attempts int, next_run_at timestamp, lease_expires_at timestamp, updated_at timestamp"


def test_claim_and_fail(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    rows = spark.createDataFrame([("a", "pending", 0, 3), ("b", "running", 1, 3), ("c", "running", 3, 3), ("d", "succeeded", 1, 3), ("e", "pending", 0, 3), ("f", "running", 1, 3)], "task_id string, status string, attempt_count int, max_attempts int")
    early, late = F.lit("2024-01-01 11:00:00").cast("timestamp"), F.lit("2024-01-01 13:00:00").cast("timestamp")
    rows = rows.withColumns({
        "next_run_at": F.when(F.col("task_id") == "e", late), "lease_expires_at": F.when(F.col("task_id") == "f", late).when(F.col("task_id") == "b", early),
        "updated_at": early,
    })
    claimed = {r.task_id: (r.claim, r.status, r.attempt_count) for r in tasks.claim(rows, now).collect()}
    assert claimed == {
        "a": ("claimed", "running", 1), "b": ("claimed", "running", 2), "c": ("dead-letter", "failed", 3),
        "d": ("not-claimable", "succeeded", 1), "e": ("not-claimable", "pending", 0), "f": ("not-claimable", "running", 1),
    }
    assert tasks.claim(rows, now, limit=1).filter("claim = 'claimed'").count() == 1
    failed = spark.createDataFrame([("x", 1, 3, True), ("y", 3, 3, True), ("z", 1, 3, False)], "task_id string, attempt_count int, max_attempts int, retryable boolean").withColumns(
        {"failure_stage": F.lit("parsing"), "failure_reason": F.lit("bad"), "error_source": F.lit("worker")}
    )
    got = {r.task_id: (r.status, r.terminal_state, r.dead_letter, r.retry_after_seconds) for r in tasks.fail(failed, now).collect()}
    assert got == {"x": ("pending", None, False, 5), "y": ("failed", "dead-letter", True, 0), "z": ("failed", "terminal-failure", False, 0)}


def test_idempotent_creation(spark):
    old = spark.createDataFrame([("k1", "t1", "running"), ("k2", "t2", "failed")], "idempotency_key string, task_id string, status string").withColumn("updated_at", F.current_timestamp())
    new = spark.createDataFrame([("k1", "n1"), ("k2", "n2"), ("k3", "n3"), ("k3", "n4")], "idempotency_key string, task_id string")
    got = sorted(tuple(r) for r in tasks.create_tasks(old, new).collect())
    assert got == [("k1", "t1", "reused"), ("k2", "t2", "failed-needs-retry"), ("k3", "n3", "created"), ("k3", "n3", "reused")]


def test_token_bucket(spark):
    requests = spark.createDataFrame([("a", 0.0)] * 25 + [("a", 0.25)] * 3 + [("b", 0.0)], "client string, at_seconds double")
    rows = tasks.token_bucket(requests).collect()
    assert sum(r.allowed for r in rows if r.client == "a" and r.at_seconds == 0) == 20
    assert sum(r.allowed for r in rows if r.client == "a" and r.at_seconds > 0) == 2
    assert [r.allowed for r in rows if r.client == "b"] == [True]


# --- views, planning, conversation ---------------------------------------------------------


def test_trace_rollup(spark):
    events = spark.createDataFrame([("t", None, "chat", "succeeded"), ("t", None, "generation", "failed"), ("u", "r2", "chat", "running")], "trace_id string, run_id string, stage string, status string")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    events = events.withColumns({"conversation_id": F.lit("c"), "started_at": at, "finished_at": at + F.expr("interval 5 seconds")})
    runs = {r.run_id: (r.status, r.duration_ms, r.n_nodes) for r in views.trace_runs(views.trace_nodes(events, F.lit("s"))).collect()}
    assert runs == {"run:t": ("failed", 5000, 2), "r2": ("running", 5000, 1)}
    assert views.percent(F.lit(1), F.lit(0)) is not None


def test_intents_and_routing(spark):
    assert planning.intent_matches("/a+b/i") == ("(?i)a+b", True) and planning.intent_matches("/docs/path") == ("/docs/path", False)
    assert planning.intent_matches("/(/") == ("", True)
    rows = spark.createDataFrame([("请假流程怎么走",), ("Deploy the SERVER",), ("hello",)], "q string")
    assert [r[0] for r in rows.select(planning.keyword_bases(F.col("q"))).collect()] == [["kb_policy"], ["kb_ops"], []]
    arguments = spark.createDataFrame([("see TASK_ab12x and rag.top.k",), ("none",)], "m string").select(planning.tool_arguments(F.col("m")).alias("a"))
    assert [tuple(r.a) for r in arguments.collect()] == [("TASK_ab12x", "rag.top.k"), (None, None)]


def test_mappings_keep_case(spark):
    rewrite = planning.apply_mappings([("vpn", "Virtual Net"), ("假", "休假"), (" ", "x")])
    rows = spark.createDataFrame([("VPN vpn Vpn vpnx",), ("请假",), (None,)], "q string")
    assert [r[0] for r in rows.select(rewrite("q")).collect()] == ["VIRTUAL NET virtual net Virtual Net vpnx", "请休假", None]


def test_rewrite_strategies(spark):
    rows = spark.createDataFrame([("And the cost?", "what is leave"), ("a b? c d", None), ("plain", None), ("it works", None)], "message string, last_user_turn string")
    got = [(r.strategy, r.rewritten) for r in planning.rewrite_plan(rows).collect()]
    assert got == [("followup-merge", "what is leave. And the cost?"), ("multi-query", "a b ; c d"), ("passthrough", "plain"), ("passthrough", "it works")]


def test_conversation(spark):
    said = [("c", 0, "user", "u0"), ("c", 1, "assistant", "a1"), ("c", 2, "user", "u2"), ("c", 3, "user", "u3"), ("c", 4, "assistant", "a4")]
    messages = spark.createDataFrame([(f"m{p}", c, p, r, t) for c, p, r, t in said], "message_id string, conversation_id string, position int, role string, content string")
    assert [r.text for r in conversation.message_pairs(messages).orderBy("position").collect()] == ["u0\na1", "u2", "u3\na4"]
    marks = spark.createDataFrame([("c", "m2")], "conversation_id string, message_id string")
    assert conversation.after_summary(messages, marks).count() == 2
    assert conversation.after_summary(messages, marks.withColumn("message_id", F.lit("?"))).count() == 5
    row = spark.range(1).select(conversation.prompt(F.lit("kb text"), F.lit(""), F.lit("m"), F.lit("r")).alias("p")).first().p
    assert row.scene == "kb" and row.sections == ["Rewrite query: r", "Knowledge context:\nkb text"]


def plain_trim(costs, budget):
    kept = list(range(len(costs)))
    while sum(costs[k] for k in kept) > budget and len(kept) > 3:
        kept.pop(1)
    return kept


def test_trim_history(spark):
    rng = random.Random(5)
    for trial in range(6):
        lengths = [4 * rng.randint(1, 40) for _ in range(rng.randint(1, 9))]
        rows = [("c", k, "x" * n) for k, n in enumerate(lengths)]
        df = spark.createDataFrame(rows, "conversation_id string, position int, content string")
        got = sorted(r.position for r in conversation.trim_history(df, budget=60).collect())
        assert got == plain_trim([n // 4 for n in lengths], 60), trial


# --- sources -------------------------------------------------------------------------------


def docx(paragraphs, title):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t><w:tab/><w:t>x</w:t></w:r></w:p>" for p in paragraphs)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
        z.writestr("docProps/core.xml", f'<c:p xmlns:c="c" xmlns:dc="dc"><dc:title>{title}</dc:title></c:p>')
    return held.getvalue()


def test_parsers(spark):
    files = spark.createDataFrame([("a", bytearray(docx(["one", "two"], " T "))), ("b", bytearray(b"no zip"))], "source_uri string, content binary")
    got = {r.source_uri: (r.title, r.text, r.error) for r in parsers.parse_docx(files).collect()}
    assert got == {"a": ("T", "one\tx\n\ntwo\tx", None), "b": (None, None, "bad-archive")}
    uris = spark.createDataFrame([("data:text/plain;base64,aGk=",), ("data:text/plain,a+b%21",), ("file:///x",), ("data:none",)], "u string")
    assert [r[0] and bytes(r[0]) for r in uris.select(parsers.data_uri_bytes(F.col("u"))).collect()] == [b"hi", b"a b!", None, None]
    titles = spark.createDataFrame([("/a/b/report.v2.pdf",), ("",), (None,)], "f string").select(parsers.fallback_title(F.col("f"), F.lit("none")))
    assert [r[0] for r in titles.collect()] == ["report.v2", "none", "none"]
    meta = spark.range(1).select(parsers.server_metadata(F.lit('[{"dc:title": "T", "xmpTPg:NPages": "3"}]')).alias("m")).first().m
    assert (meta.title, meta.language, meta.page_count) == ("T", None, 3)
    pdf = parsers.parse_pdf(files).collect()
    assert all(r.error in ("dependency-missing", "file-read-failed") for r in pdf)


def test_markdown(spark):
    text = "intro\r\n# One\nbody\n## Two é\nend"
    rows = spark.createDataFrame([("d", parsers.MARKDOWN, "f.md", text), ("e", parsers.PLAIN, "", "\n first\nline")], "document_id string, kind string, filename string, content string")
    got = {r.document_id: r for r in parsers.parse_text(rows).collect()}
    assert got["d"].title == "One" and [(s.title, s.level, s.start_offset, s.end_offset) for s in got["d"].sections] == [("One", 1, 6, 17), ("Two é", 2, 17, 30)]
    assert got["e"].title == "first" and got["e"].sections[0].end_offset == 10


def test_store(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    assert store.read("settings").count() == 0
    row = spark.createDataFrame([("k", "v", None, None)], "key string, value string, description string, updated_at timestamp")
    store.append("settings", row)
    store.overwrite("settings", store.read("settings").withColumn("value", F.lit("w")))
    assert [(r.key, r.value) for r in store.read("settings").collect()] == [("k", "w")]
    assert store.bootstrap("settings", "file:///nowhere", "key") is False
    assert ndjson(row).first().value == '{"key":"k","value":"v"}'
    assert spark.createDataFrame([("a" * 50 + "\nb",)], "text string").select(stream_pieces()).first()[0] == ["a" * 48, "aa", "b"]
    task = spark.createDataFrame([("t", 5, 0)], "task_id string, attempt_count int, max_attempts int")
    assert tuple(project_task(task).first())[:4] == ("t", 5, 3, 0)
