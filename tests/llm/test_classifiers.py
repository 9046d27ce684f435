from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quality, toxicity
from tests.llm.conftest import awkward_rows, documents, words


def good(seed):
    rng = random.Random(seed)
    lines = [words(seed * 100 + k, rng.randint(6, 14)).capitalize() + "." for k in range(rng.randint(2, 12))]
    return "\n".join(" ".join(lines[k : k + 3]) for k in range(0, len(lines), 3))


def junk(seed):
    rng = random.Random(seed)
    marks = rng.choice(["$$$", "!!", "###", " |"])
    return " ".join(w.upper() + marks for w in words(seed, rng.randint(10, 120)).split())


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for k in range(600):
        is_junk = k % 5 == 0
        text = junk(k) if is_junk else good(k)
        if k % 7 == 0:
            text += " you idiot are a worthless moron" if k % 2 else " zorkelan zorkelba zorkelix"
        rows.append((k, text))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, int(not is_junk), int(k % 7 == 0)))
    docs = documents(spark, rows)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scores, labels, column):
    rows = scores.join(labels, "doc_id").filter("held_out").select("predicted", column).collect()
    return np.mean([r[0] == r[1] for r in rows])


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    scores = quality.quality_scores(docs, labels).cache()
    assert accuracy(scores, labels, "quality") >= 0.97
    assert scores.count() == 600 and scores.filter("score < 0 or score > 1 or score is null").count() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scores.collect())


def test_held_out_labels_and_other_columns_change_nothing(labelled):
    docs, labels = labelled
    flipped = labels.withColumn(
        "quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    first = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    again = quality.quality_scores(docs.repartition(5).withColumn("lang", F.lit("xx")), flipped)
    assert {r.doc_id: r.score for r in again.collect()} == pytest.approx(first)


def test_keep_good_agrees_with_the_scores(labelled):
    docs, labels = labelled
    kept = quality.keep_good(docs, labels)
    want = {r.doc_id for r in quality.quality_scores(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns


def test_statistics_are_those_of_all_rows(spark, labelled, monkeypatch):
    docs, labels = labelled
    table = quality.measured(docs, "doc_id", "text").cache()
    web = np.array([r._x for r in quality.rows_to_learn(table).collect()])
    scorer = quality.train(table, labels, sample=100)
    assert scorer.mean == pytest.approx(web.mean(axis=0)) and scorer.scale == pytest.approx(web.std(axis=0) + 1e-9)
    label = {r.doc_id: r.quality for r in labels.collect()}
    raw = {r._id: scorer.raw(np.array([r._x]))[0] for r in table.collect()}
    good, bad = ([raw[i] for i in label if label[i] == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95

    models = []
    fit = toxicity.fit_model
    monkeypatch.setattr(toxicity, "fit_model", lambda *a: models.append((fit(*a), a[0])) or models[-1][0])
    toxicity.toxicity_scores(docs, labels, sample=100)
    model, patterns = models[0]
    count = patterns.counter()
    rows = [count(r.text) for r in docs.filter(~quality.held_out(F.col("doc_id"))).collect()]
    n, h, c = (np.array(x, float) for x in zip(*rows))
    assert model.scorer.mean == pytest.approx(toxicity.features_of(n, h, c).mean(axis=0))


def test_one_labelled_row_per_id(spark):
    table = spark.createDataFrame([(1, [1.0])] * 50 + [(1, [0.5]), (4, [2.0])], "_id long, _x array<double>")
    chosen = spark.createDataFrame([(1, 1), (4, 0)], "_id long, _label int")
    assert not any(quality.is_held_out(i) for i in (1, 4))
    assert sorted(tuple(r) for r in quality.labelled_rows(table, chosen).collect()) == [(0, [2.0]), (1, [0.5])]


def test_risk_is_not_negative_and_uses_no_negatives():
    rng = np.random.default_rng(1)
    positive = rng.normal(1.5, 1, (300, 3))
    unlabelled = np.concatenate([rng.normal(1.5, 1, (300, 3)), rng.normal(-1.5, 1, (300, 3))])
    scorer = quality.fit_pu(positive, unlabelled, 0.5)
    right = (scorer.raw(unlabelled) > 0) == (np.arange(600) < 300)
    assert right.mean() > 0.93


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    scores = toxicity.toxicity_scores(docs, labels).cache()
    assert accuracy(scores, labels, "toxic") >= 0.97  # the mined word beginning as well as the lexicon
    assert scores.filter("score < 0 or score > 1 or score is null").count() == 0


def test_mined_patterns(spark):
    rows = [(f"{words(k, 30)} zorkel{'abcdef'[k % 6]}n", 1) for k in range(40)] + [(words(k + 99, 30), 0) for k in range(300)]
    found = toxicity.mine_patterns(spark.createDataFrame(rows, "_text string, _label int"))
    mined = [t for t in found.terms if t not in toxicity.LEXICON]
    assert mined and mined[0].startswith("zork")
    n, hits, counts = found.counter()("An IDIOT, zorkelan idiots")
    assert (n, hits) == (4, 2) and sum(counts) >= 2


@pytest.mark.parametrize("mark", ["qx", "z", "donau" * 6])
def test_whole_words_of_any_length_vote(mark):
    terms = [t for t in toxicity.beginnings([mark]) if t.endswith("$")]
    assert toxicity.Patterns(tuple(terms)).counter()(f"a {mark} b {mark}s")[1:] == (1, [1])


def test_label_model_counts_repeating_voters_once():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.2

    def voter(right, wrong):
        p = np.where(truth, right, wrong)
        return (rng.random(4000) < p).astype(np.int8)

    repeated = voter(0.6, 0.1)
    votes = np.stack([voter(0.8, 0.05), voter(0.7, 0.05), voter(0.75, 0.05), repeated, repeated, repeated], axis=1)
    model = toxicity.fit_label_model(votes)
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.9
    # of the three equal voters one speaks and two repeat it: their evidence is that of one
    tree = {frozenset(x) for x in enumerate(model.parent.tolist())}
    assert len(tree & {frozenset(x) for x in ((3, 4), (3, 5), (4, 5))}) == 2
    evidence = np.log(model.given[:, 1] / model.given[:, 0]).reshape(6, 9)
    states = toxicity._states(np.array([[0, 0, 0, 1, 1, 1]]), model.parent)[0]
    spoken = sorted(abs(evidence[j, states[j]]) for j in (3, 4, 5))
    assert spoken[1] < 0.05 < 1 < spoken[2]
    assert model.table[:3, 1, 2] == pytest.approx([0.8, 0.7, 0.75], abs=0.05)  # the accuracies


def test_tree_of_greatest_information():
    rng = np.random.default_rng(3)
    x = rng.random((7, 7))
    x = x + x.T
    edges, label = [], list(range(7))
    for i, j in sorted(((i, j) for i in range(7) for j in range(i)), key=lambda e: -x[e]):
        if label[i] != label[j]:
            edges.append({i, j})
            label = [label[i] if v == label[j] else v for v in label]
    parent = toxicity.spanning_tree(x)
    assert parent[0] == -1 and all({j, int(parent[j])} in edges for j in range(1, 7))
    assert toxicity.spanning_tree(np.zeros((3, 3))).tolist() == [-1, 0, 0]


@pytest.mark.parametrize("module, run", [(quality, quality.quality_scores), (toxicity, toxicity.toxicity_scores)])
def test_awkward_tables(spark, awkward, empty, module, run):
    column = "quality" if module is quality else "toxic"
    schema = f"doc_id long, {column} int, text string"
    odd = spark.createDataFrame([(1, None, "x"), (None, 1, "x"), (4, 1, None), (4, 0, None), (5, 7, ""), (8, 0, "")], schema)
    for labels in (odd, odd.limit(0), odd.filter(f"{column} = 1")):
        rows = run(awkward, labels).collect()
        assert len(rows) == len(awkward_rows())
        assert all(0 <= r.score <= 1 for r in rows)
        same = {r.score for r in rows if r.doc_id in (4, 5)}
        assert len(same) == 1
    assert run(empty, odd).count() == 0


def test_measures():
    assert quality.measures(None) == quality.measures("  ") == [0.0] * len(quality.NAMES)
    assert all(np.isfinite(quality.measures("x" * 10**6)))


def test_long_words_and_repeated_labelled_rows(spark):
    """A mined word is the whole word, and an id's repeats count once."""
    from quern.llm import toxicity

    assert toxicity.Patterns(("a" * 30 + "$",)).counter()("a" * 40 + " " + "a" * 30)[2] == [1]
    bundled = toxicity.Patterns(tuple(f"{c}word$" for c in "abcdefghijklmnop"), 4)
    assert bundled.width == 12 and bundled.voters == [0, 1, 2, 3, 4, 4, 5, 6, 6, 7, 8, 8, 9, 10, 10, 11]
    assert bundled.counter()("aword eword fword fword")[1:] == (4, [1, 0, 0, 0, 3, *[0] * 7])
    seen = []
    mine = toxicity.mine_patterns

    def counted(labelled, **options):
        seen.append(labelled.count())
        return mine(labelled, **options)

    rows = [(k, "idiot word" if k % 2 else "plain words here", None) for k in range(40)] + [(1, "idiot word", None)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    toxicity.mine_patterns = counted
    try:
        got = toxicity.toxicity_scores(docs, labels)
        assert got.count() == 70 and seen[0] <= 40
    finally:
        toxicity.mine_patterns = mine
