from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from quern.llm.suffix_dedup import _PIECE, Q, SEGMENT, anchors, numbered, pieces, refined_buckets, remove_repeats
from tests.llm.conftest import awkward_rows, words


def brute(rows, length):
    """rows in order of their ids."""
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        rest = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(data), len(data) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


def result(df, **options):
    return [
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, **options).collect()
    ]


@pytest.mark.parametrize("hot, fan_in", [(1000, 1 << 16), (2, 1 << 16), (2, 2), (0, 3)])
def test_repeats_match_brute_force(make, hot, fan_in):
    rng = random.Random(5)
    shared = [words(1000 + k, 60) for k in range(4)]
    rows = []
    for k in range(40):
        parts = [words(k, rng.randint(3, 40))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a : a + rng.randint(50, 300)], words(rng.randint(0, 9999), rng.randint(1, 20))]
        rows.append((k, "é".join(parts)))
    rows += [(50, None), (51, ""), (52, "z" * 700), (53, "ab" * 400), (54, "z" * 99), (55, "z" * 100)]
    assert sorted(result(make(rows), hot=hot, group_bytes=2000, fan_in=fan_in)) == brute(rows, 100)


def test_awkward_rows(awkward):
    ordered = sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = brute(ordered, 100)
    assert sorted(result(awkward), key=str) == sorted(want, key=str)


def test_empty_and_clean(empty, make):
    assert result(empty) == []
    row = remove_repeats(make([(1, "x" * 40), (2, "x" * 40)])).collect()
    assert [bytes(r.kept) for r in row] == [b"x" * 40] * 2 and all(r.spans == [] for r in row)


def test_anchor_of_every_window_is_found():
    data = np.frombuffer((words(3, 300) + "a" * 200).encode(), np.uint8)
    bounds = np.array([0, 500, 700, len(data)])
    _, place, first, last = anchors(data, bounds, 100)
    covered = np.zeros(len(data), int)
    for p, a, b in zip(place, first, last):
        covered[a : b + 1] += 1
        assert a <= b <= p and p + Q <= a + 100
    inside = [any(lo <= p and p + 100 <= hi for lo, hi in zip(bounds, bounds[1:])) for p in range(len(data))]
    assert covered.tolist() == [int(x) for x in inside]


def test_refined_buckets_are_a_partial_suffix_array():
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.choices(b"ab", k=600)) * 2, np.uint8)
    ends = np.full(len(data), len(data))
    for length in (40, 100):
        pointer = refined_buckets(data, ends, length)
        places = [p for p in range(len(data) - length + 1)]
        keys = {p: data[p : p + length].tobytes() for p in places}
        for p, q in zip(places, places[1:]):
            assert (pointer[p] == pointer[q]) == (keys[p] == keys[q])
            assert (pointer[p] < pointer[q]) == (keys[p] < keys[q])


def test_rows_without_ids_are_dealt_like_others(spark, make):
    """A third of the rows have no id and some repeat one: no group holds them all."""
    passage = words(7, 40)
    rows = [(None if k % 3 == 0 else k // 2, f"{words(k, 30)} {passage}") for k in range(300)]
    df = make(rows)
    keyed = numbered(df.selectExpr("doc_id _id", "text _text")).collect()
    assert len({r._key for r in keyed}) == 300
    in_order = [r._id for r in sorted(keyed, key=lambda r: r._key)]
    assert in_order == sorted(in_order, key=lambda i: (i is not None, i or 0))
    kept = result(df, group_bytes=1000)
    assert sum(n > 0 for _, _, n, _, _ in kept) == 299 and len(kept) == 300


def test_pieces_of_equal_windows_share_their_bytes():
    text = np.frombuffer(words(3, 400).encode(), np.uint8)
    h, place, first, last = anchors(text, np.array([0, len(text)]), 100)
    meta = np.zeros(len(h), SEGMENT)
    meta["h"], meta["anchor"], meta["start"], meta["size"] = h, place - first, first, last - first + 100
    segment = np.repeat(np.arange(len(h)), last - first + 1)
    rng = np.random.default_rng(1)
    chosen = rng.random(len(segment)) < 0.9
    found, shared = pieces(meta, segment, chosen, 100)
    assert int((found["size"].astype(int) - 99).sum()) == int(chosen.sum()) and found["size"].max() <= 100 + _PIECE - 1
    for piece, at in zip(found, shared):
        start, n = int(piece["start"]), int(piece["size"]) - 99
        assert start + n - 1 <= at and at + 100 - _PIECE + 1 <= start + 100
