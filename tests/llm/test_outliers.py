"""Quality rules: base statistics against plain Python, estimates against numpy."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import outliers as O
from tests.llm.conftest import awkward_rows, words


def plain(text):
    text = text or ""
    w = [x for x in re.split("[ \t-\r]+", text) if x]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(1)
    some = [t for _, t in awkward_rows()] + ["a b c d e f g h " * 9, "a b c d e f g h a b c d e f g h", "# | <x>\n\n# | <x>\n \n", "x y \x0b z\x1c", "a " * 8]
    for _ in range(60):
        base = [words(k, 12) for k in range(6)]
        some.append("".join(rng.choice(base) + rng.choice([" ", "\n", "  ", "\t", " $ "]) for _ in range(rng.randint(1, 9))))
    return some


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"_group": F.lit("x"), "n_words": F.lit(1), "_x0": F.lit(2), "distance": F.lit(3)})


def test_base_statistics_are_those_of_plain_python(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(texts())]
    got = {r.doc_id: tuple(r)[1:7] for r in O.quality_verdicts(docs(spark, rows)).collect()}
    assert got == {k: plain(t) for k, t, *_ in rows}


def usual(rng, n):
    return [" ".join("".join(rng.choices("abcdefghij", k=max(1, round(rng.gauss(6, 1.5))))) for _ in range(rng.randint(60, 400))) for _ in range(n)]


def test_outliers_go_and_usual_texts_stay(spark):
    rng = random.Random(2)
    rows = [(k, t, "en", "s1") for k, t in enumerate(usual(rng, 300))]
    rows += [(1000 + k, re.sub(" ", "$$$ ", t), "en", "s1") for k, t in enumerate(usual(rng, 60))]
    rows += [(2000 + k, t, "fr", f"rare{k % 4}") for k, t in enumerate(usual(rng, 40))]  # too few of their own, enough together? no: 40
    rows += [(3000 + k, t.upper(), None, None) for k, t in enumerate(usual(rng, 100))] + [(3000, "x " * 30, None, None)]
    got = O.quality_verdicts(docs(spark, rows)).select("doc_id", "kept", "distance").collect()
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[k] for k in range(300)) and not any(kept[1000 + k] for k in range(60))
    assert all(kept[2000 + k] for k in range(40)) and all(r.distance is None for r in got if 2000 <= r.doc_id < 3000)
    assert all(kept[3000 + k] for k in range(1, 100))  # capitals are usual there
    assert len(got) == len(rows)


def test_small_sources_are_taken_together(spark):
    rng = random.Random(3)
    rows = [(k, t, "fr", f"rare{k % 5}") for k, t in enumerate(usual(rng, 100))] + [(500, "### $$$ " * 40, "fr", "rare9")]
    rows[-1] = (500, " ".join(f"{w}###" for w in words(5, 90).split()), "fr", "rare9")
    got = {r.doc_id: r.kept for r in O.quality_verdicts(docs(spark, rows)).collect()}
    assert not got.pop(500) and all(got.values())


def test_estimates_are_those_of_numpy(spark):
    """The same concentration steps over one group, in numpy."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.multivariate_normal([1, 2], [[0.04, 0.03], [0.03, 0.09]], 500) * O.UNIT + 0.5).astype(int)
    x[:60] += 20_000
    floors = [0.01, 0.01]
    frame = spark.createDataFrame([("g", int(a), int(b)) for a, b in x], "_group string, _x0 long, _x1 long").repartition(3)
    found = O.group_estimates(frame, floors, covered=0.75, steps=3).first()

    def cells(centre, inverse):
        away = x - centre
        return np.minimum(np.floor(np.sqrt(np.einsum("ij,jk,ik->i", away, inverse, away)) * O.CELLS), O.LAST_CELL)

    def limit(values, share):
        return np.sort(values)[math.ceil(share * len(values)) - 1]

    least = (np.array(floors) * O.UNIT) ** 2
    coarse = np.floor(x / O.COARSE)
    a, b, c = (np.array([limit(coarse[:, j], q) for j in range(2)]) for q in (0.25, 0.5, 0.75))
    centre, inverse = (b + 0.5) * O.COARSE, np.diag(1 / (((c - a) * O.COARSE / 1.349) ** 2 + least))
    for _ in range(3):
        near = x[(d := cells(centre, inverse)) <= limit(d, 0.75)]
        centre, inverse = near.mean(0), np.linalg.inv(np.cov(near.T, bias=True) + np.diag(least))
    w = np.array([[found["_w0_0"], 0], [found["_w1_0"], found["_w1_1"]]])
    assert np.allclose([found["_m0"], found["_m1"]], centre) and np.allclose(w.T @ w, inverse)
    middle = (limit(cells(centre, inverse), 0.5) + 0.5) / O.CELLS
    assert found["_scale"] == pytest.approx(min(1, O.chi_square_quantile(0.5, 2) / middle**2))
    assert abs(np.array(centre) / O.UNIT - [1, 2]).max() < 0.05  # the far rows do not move it


def test_chi_square():
    assert O.chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2), abs=1e-5)
    assert O.chi_square_quantile(0.95, 6) == pytest.approx(12.591587, abs=1e-5)


def test_verdicts_do_not_depend_on_partitions_and_no_python_runs(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = (O.quality_verdicts(table.repartition(n)) for n in (1, 7))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    plan = many._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables_and_other_names(spark):
    assert O.quality_verdicts(docs(spark, [])).collect() == []
    named = docs(spark, [(1, "a b", "en", "s")]).selectExpr("doc_id as key", "text as body", "lang as l", "source as s")
    assert O.quality_verdicts(named, "key", "body", ("l", "s")).first().key == 1
