"""Collocations against plain counting, and the parts of a counting pass."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import collocations as C
from tests.llm.conftest import awkward_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, top=2000):
    """(lang, text) -> the result, with all phrases in one dict."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, w), a in candidates.items():
        longer = [b for (x, v), b in candidates.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 100 * a for b in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return [
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])
    ]


def table(spark, rows):
    data = [(k, text, lang, "x", None) for k, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, phrase string, n long")


def random_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "new", "york", "é", "日本", "x"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    return rows + [("en", None), (None, ""), ("en", "new york new york new york"), ("en", "a a a a a a")] + [("en", t) for _, t in awkward_rows()]


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_are_those_of_plain_counting(spark, seed):
    rows = random_rows(seed)
    got = C.collocations(table(spark, rows).repartition(3), least=8)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 8))


def test_full_bitmaps_and_small_blocks_lose_nothing(spark, monkeypatch):
    rows = random_rows(3)
    monkeypatch.setattr(C, "SLICE", 500)
    monkeypatch.setattr(C, "FAN_IN", 2)
    got = C.collocations(table(spark, rows).repartition(7), least=8, n_buckets=64)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 8))


def test_top_and_lengths_are_parameters(spark):
    rows = random_rows(4)
    got = C.collocations(table(spark, rows), least=5, longest=3, top=4)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 5, 3, 4))


def test_scores_beyond_64_bits(spark):
    row = "CAST({} AS DECIMAL(19, 0))"
    a, n = row.format(10**15), row.format(10**16)
    assert spark.sql(f"SELECT (CAST(1000 AS DECIMAL(4, 0)) * ({a} * {n})) div ({a} * {a}) AS s").first().s == 1000 * 10**16 // 10**15


def test_nothing_frequent_and_empty_tables(spark, empty):
    assert C.collocations(empty.withColumnRenamed("g", "lang")).collect() == []
    assert C.collocations(table(spark, [("en", "a b c")])).collect() == []


def test_words_of_sliced_batches_and_touching_texts():
    texts = pa.array(["zz", "a B", "c", None, " d", "e.f g", ".", "h"])[1:]
    words = C.Words("en", texts)
    spelled = [words.spelled[int(i)].as_py().decode() for i in words.number]
    assert spelled == ["a", "b", "c", "d", "e", "f", "g", "h"]
    assert words.followed.tolist() == [True, False, False, False, False, True, False, False]
    kept = np.array([True, True, False, False, True, True, False, True])
    assert words.trimmed(kept) == b"a b\ne\nf\nh\n"
    assert [(x, y.to_pylist()) for x, y in C.by_language(pa.RecordBatch.from_arrays([pa.array(["x", None, "x"]), pa.array(["a", "b", None])], ["l", "t"]))] == [
        ("x", ["a", None]), ("und", ["b"]),
    ]


def test_bitmap_has_what_was_marked():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    marks = np.zeros(1 << 12, bool)
    for at in C.places(hashes, 1 << 12, 2):
        marks[at] = True
    assert C.Bitmap(np.packbits(marks), 2).has(hashes).all()
