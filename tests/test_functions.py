"""Functions against plain Python models and known facts."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import metrics, rules, text, vector


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.r for r in rows.select("k", expression(F.col("v")).alias("r")).orderBy("k").collect()]


def is_cjk(c):
    return "一" <= c <= "鿿" or "㐀" <= c <= "䶿" or "豈" <= c <= "﫿"


def plain_terms(value):
    s, out, i = (value or "").lower().strip(), [], 0
    while i < len(s):
        j = i
        if is_cjk(s[i]):
            while j < len(s) and is_cjk(s[j]):
                j += 1
            block = s[i:j]
            out += list(block) + [block[k : k + 2] for k in range(len(block) - 1)] + ([block] if len(block) >= 3 else [])
        elif s[i].isalpha() or s[i].isdecimal():
            while j < len(s) and (s[j].isalpha() or s[j].isdecimal()):
                j += 1
            if len(s[i:j].encode()) >= 2:
                out.append(s[i:j])
        else:
            j = i + 1
        i = j
    return list(dict.fromkeys(out))


SAMPLES = [
    None, "", "  ", "Hello, World hello", "请假流程怎么走", "a bc é 日 abc请假 请abc", "V2 rollback-checklist 3.14", "x　y 㐀豈",
]


def test_tokenize_terms(spark):
    got = column(spark, SAMPLES, text.tokenize_terms)
    assert [sorted(t) for t in got] == [sorted(plain_terms(v)) for v in SAMPLES]
    assert "请假" in got[4]


def test_extract_and_eval_terms(spark):
    assert column(spark, ["The the A x1 请假!流程", None], text.extract_terms) == [["the", "the", "x1", "请假", "流程"], []]
    assert column(spark, ["The the A x1 请假"], text.eval_terms) == [["the", "x1"]]


def test_estimate_tokens(spark):
    def plain(value):
        total = 0.0
        for unit in memoryview((value or "").encode("utf-16-le")).cast("H"):
            if 0x4E00 <= unit <= 0x9FFF or 0x3400 <= unit <= 0x4DBF or 0xF900 <= unit <= 0xFAFF:
                total += 0.5
            elif unit > 32:
                total += 0.25
        return math.ceil(total)

    values = SAMPLES + ["😀😀😀 x", "a" * 401, "\t\n  b"]
    assert column(spark, values, text.estimate_tokens) == [plain(v) for v in values]


def test_sentences(spark):
    got = column(spark, ["今天天气很好。我们出去走走吧！你同意吗？\n新的一段。", "a\n\nb"], text.sentences)
    assert [s.text for s in got[0]] == ["今天天气很好。", "我们出去走走吧！", "你同意吗？", "新的一段。"]
    assert [(s.text, s.start, s.stop) for s in got[1]] == [("a", 0, 2), ("b", 3, 4)]


def test_follow_ups_and_sub_queries(spark):
    assert column(spark, ["  That one", "android", "what", "继续说"], text.looks_like_follow_up) == [True, True, False, True]
    assert column(spark, ["a? b and c ; d also e\nf"], text.sub_queries) == [["a", "b", "c"]]


def test_keywords(spark):
    got = column(spark, ["What is the leave policy of a VPN?", "the of in", "a请b 请 x假期"], text.keywords)
    assert got[0] == ["leave", "policy", "vpn"] and got[1] == []


def test_keywords_look_stop_words_up_and_keep_the_order(spark):
    texts = [None, "", "the_cat and_ dog", "什么 x什么y 的the and的 b", "Tree the TREE do does_ doing é the é", "zz 的的 a的b_c的the1 yy zz"]
    edge = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    stop = re.compile(f"{edge}(?:{'|'.join(text.STOP_WORDS)}){edge}")
    plain = [t if t is None else list(dict.fromkeys(w for w in re.split("[^a-z0-9\u4e00-\u9fff]+", stop.sub(" ", t.lower())) if len(w) > 1)) for t in texts]
    assert column(spark, texts, text.keywords) == plain
    plan = spark.createDataFrame([("x",)], "t string").select(text.keywords(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" in plan  # no alternation of all stop words at every place of a text



def test_trims(spark):
    value = "\u0085  x 　﻿"
    assert column(spark, [value], text.unicode_trim) == ["x 　﻿"]
    assert column(spark, [value], text.script_trim) == ["\u0085  x"]


def test_cosine(spark):
    rng = random.Random(1)
    pairs = [([rng.gauss(0, 1) for _ in range(5)], [rng.gauss(0, 1) for _ in range(5)]) for _ in range(20)]
    pairs += [([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [])]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a array<double>, b array<double>")
    got = [r.c for r in rows.select("k", vector.cosine(F.col("a"), F.col("b")).alias("c")).orderBy("k").collect()]
    for (a, b), c in list(zip(pairs, got))[:20]:
        want = sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
        assert c == pytest.approx(want)
    assert got[20] is None and got[21] == 0.0 and got[22] is None


def test_hashes(spark):
    def fnv(value):
        h = 2166136261
        for b in value.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    values = ["", "a", "请假", "hello"]
    assert column(spark, values, vector.fnv1a32) == [fnv(v) for v in values]
    ids = column(spark, values, vector.point_id)
    assert [int(i) for i in ids] == [int(hashlib.sha256(v.encode()).hexdigest()[:16], 16) for v in values]


def test_deterministic_vector(spark):
    got = column(spark, ["c1"], lambda v: vector.deterministic_vector(F.lit("m"), v, F.lit("h"), F.lit(7)))[0]
    digest = hashlib.sha256(b"m|c1|h|7").digest()
    want = [int.from_bytes(digest[4 * k : 4 * k + 4], "big") % 10000 / 10000 for k in range(8)]
    assert got == pytest.approx(want)


def test_retry_rules(spark):
    rows = [
        ("parsing", True, "Qdrant store", "x", 3), ("parsing", True, "file", "timeout", 20), ("parsing", True, "w", "Timeout!", 40),
        ("embedding", True, "w", "x", 0), ("parsing", True, "w", "x", 30), ("parsing", False, "tika", "x", 1),
    ]
    df = spark.createDataFrame(rows, "stage string, can boolean, source string, reason string, n int")
    kind = rules.retry_class(F.col("stage"), F.col("can"), F.col("source"), F.col("reason"))
    tier = rules.retry_tier(kind, F.col("can"))
    got = [tuple(r) for r in df.select(kind, tier, rules.retry_delay_seconds(F.col("n"), tier)).collect()]
    assert got == [
        ("dependency-transient", "dependency-backoff", 45), ("store-transient", "fast-backoff", 30),
        ("dependency-transient", "dependency-backoff", 300), ("dependency-transient", "dependency-backoff", 15),
        ("transient", "standard-backoff", 90), ("non-retryable", "none", 5),
    ]


def test_trace_rules(spark):
    stages = ["chat", "rewrite.plan", "tool.runtime.x", "ingestion:parsing", "ingestion", "ingestion:task-created", "generation.x", "?"]
    kinds = column(spark, stages, rules.node_type)
    assert kinds == ["chat", "rewrite", "tool.runtime", "parser", "ingestion", "ingestion", "generation", "other"]
    ids = column(spark, stages, lambda s: rules.node_id(F.lit("t"), s, F.lit("7")))
    assert ids == [
        "node:t:chat:root", "node:t:rewrite:single", "node:t:tool.runtime:7", "node:t:parsing:single", "node:t:ingestion:root",
        "node:t:ingestion:root", "node:t:generation:7", "node:t:other:7",
    ]
    parents = column(spark, stages, lambda s: rules.parent_node_id(F.lit("t"), s))
    assert parents == [
        None, "node:t:chat:root", "node:t:tool.plan:single", "node:t:ingestion:root", None, None, "node:t:chat:root", None,
    ]


def plain_jaccard(a, b):
    x, y = ({w for w in re.split(r"\s+", t.lower()) if len(w) >= 2} for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def test_context_metrics(spark):
    retrieved = ["alpha beta gamma delta", "nothing here at all", "short"]
    truths = ["beta gamma", "alpha beta gamma epsilon zeta", "unseen truth text"]
    df = spark.createDataFrame([(retrieved, truths)], "r array<string>, t array<string>")

    def same(c, t):
        return t in c or c[:200] in t or plain_jaccard(c, t) >= 0.3

    row = df.select(metrics.context_precision(F.col("r"), F.col("t")), metrics.context_recall(F.col("r"), F.col("t"))).first()
    assert row[0] == pytest.approx(sum(any(same(c, t) for t in truths) for c in retrieved) / 3)
    assert row[1] == pytest.approx(sum(any(same(c, t) for c in retrieved) for t in truths) / 3)
    empty = spark.createDataFrame([([], truths), (retrieved, [])], "r array<string>, t array<string>")
    got = empty.select(metrics.context_precision(F.col("r"), F.col("t")), metrics.context_recall(F.col("r"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (0.0, 0.0)]


def test_answers(spark):
    df = spark.createDataFrame(
        [("What is leave policy", "The leave policy says 12 days. Unknown claim about Mars rockets here.", ["leave policy says 12 days"])],
        "q string, a string, e array<string>",
    )
    row = df.select(
        metrics.answer_relevance(F.col("q"), F.col("a")), metrics.answer_relevance(F.lit("the of"), F.col("a")),
        metrics.answer_relevance(F.lit(" "), F.col("a")), metrics.faithfulness(F.col("a"), F.col("e")),
        metrics.faithfulness(F.lit(""), F.col("e")),
    ).first()
    assert tuple(row) == (1.0, 0.5, 0.0, 0.5, 0.0)
