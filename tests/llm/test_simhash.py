from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.simhash import drop_near_copies, fingerprint, forest, links, near_duplicates, part_balls
from tests.llm.conftest import awkward_rows, words


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, pairs):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "a b c", "a b c d", "A É b\x0bc d e\x1cf", words(4, 500)])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("hot", [4096, 5])
def test_links_lose_no_pair(spark, hot):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for base in fps[:20]:
        now = base
        for _ in range(12):  # chains and clusters of near fingerprints
            for b in rng.sample(range(64), rng.randint(1, 5)):
                now ^= 1 << b
            fps.append(now)
            fps.append(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = list(dict.fromkeys(fps))
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    points = spark.createDataFrame(list(zip(signed, range(len(fps)))), "_fp long, _rep long")
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    found = [(r.a, r.b) for r in links(points, 4, hot).collect()]
    assert all(a > b for a, b in found)
    assert classes(len(fps), found) == classes(len(fps), pairs)
    assert len(found) < 40 * len(fps)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(a, rng.randrange(max(0, a - 30), a)) for a in range(1, 300) if rng.random() < 0.8] + [(500, 499), (501, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = classes(502, pairs)
    assert got == {n: want[n] for n in range(502) if want[n] != n}


def test_components_of_a_long_chain(spark):
    links_ = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.root for r in components(links_).collect()} == {0}


def test_forest_of_all_pairs():
    a, b = zip(*[(i, j) for i in range(30) for j in range(i)])
    x, y = forest(np.array(a), np.array(b))
    assert sorted(x) == list(range(1, 30)) and set(y) == {0}


def test_near_duplicates_match_brute_force(make):
    base = words(9, 400).split()
    rows = []
    for k in range(30):
        text = list(base) if k % 2 else words(k, 300).split()
        for j in range(k % 5):
            text[(37 * k + j) % len(text)] = f"w{k}x{j}"
        rows.append((k, " ".join(text)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(make(rows)).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(30) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = classes(30, pairs)
    assert got == {k: (format(fps[k], "016x"), want[k]) for k in range(30)}


def test_awkward_rows(awkward, empty):
    rows = near_duplicates(awkward).collect()
    assert len(rows) == len(awkward_rows())
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {1}
    assert near_duplicates(empty).count() == 0
    kept = drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    assert {1, 8}.issubset({r.doc_id for r in kept.select("doc_id").collect()})
    assert kept.filter("doc_id = 11").count() == 0  # the same text as document 10


def test_drop_tells_texts_of_one_id_apart_and_keeps_one_row_of_each(make):
    a, b, c, d = (words(k, 200) for k in range(4))
    rows = [(1, a), (2, a.upper()), (2, b), (3, c), (3, c), (3, c.upper()), (None, a), (None, d), (None, d)]
    kept = drop_near_copies(make(rows))
    got = sorted((r.doc_id or 0, r.text.lower()) for r in kept.collect())
    assert got == sorted([(1, a), (2, b), (3, c), (0, d)]) and kept.columns == make([]).columns


@pytest.mark.parametrize("radius, parts", [(4, 2), (4, 3), (2, 3), (6, 4), (8, 3)])
def test_near_pairs_share_a_variant(radius, parts):
    rng = random.Random(radius * 10 + parts)
    balls = part_balls(radius, parts)
    for _ in range(60):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), radius):
            b ^= 1 << bit
        met = 0
        for ball in balls:
            x, y = (set(ball.variants(np.full(len(ball.flips), f, np.uint64), np.arange(len(ball.flips))).tolist()) for f in (a, b))
            met += bool(x & y)
        assert met


def test_rows_of_one_id_join_no_components(make):
    a, b, c = (words(k, 200) for k in range(3))
    got = near_duplicates(make([(5, a), (5, b), (7, b), (6, c), (None, a)])).collect()
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(x) == 1 for x in by.values())
    kept = drop_near_copies(make([(5, a), (5, b), (7, b), (6, c), (None, a)]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, a), (5, b), (6, c)])


def test_fingerprints_at_the_hot_boundary(spark):
    """A variant with one member more than ``hot`` takes the other way; both find the same classes."""
    fps = [1 << k for k in range(7)] + [0]
    points = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "_fp long, _rep long")
    for hot in (len(fps) - 1, len(fps)):
        found = [(r.a, r.b) for r in links(points, 4, hot).collect()]
        assert classes(len(fps), found) == [0] * len(fps)
