from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from quern.llm._latin import byte_level, is_latin, word_level
from quern.llm.packing import encoder, pack_documents, pack_pieces, sequences, sum_of_squares
from quern.llm.queries import tokenizer_path
from quern.llm.token_counts import STABLE_CHARACTERS, count_tokens, token_counter, whole_tokens
from tests.llm.conftest import awkward_rows, words

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = [
    "", " ", "a<|endoftext|>b  c", "<|endoftext|>", "  \n\n x<|endoftext|>  ", "emoji 😀 x", "\x1c\x1d a\x85 b\xa0c  d",
    "日本語テスト 한국어", "don't I'll 'S DON'T", "É́x ŠŸ²½a1b22", "İ x", "Σας ΣΑΣ", "a<|startoftext|>B", "x" * 5000,
    " a b", "nul\x00l", "tab\tand\r\nline",
]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library():
    texts = ODD + [words(k, 200).title() + "!? " + str(k) for k in range(30)]
    assert token_counter(tokenizer_path(BYTES)).counts(texts) == [len(i) for i in library(BYTES)(texts)]


@pytest.mark.parametrize("name", [WORDS, "piece_bpe_32k.model"])
def test_counts_of_other_tokenizers(name):
    texts = [t for t in ODD if "<|" not in t]
    counts = token_counter(tokenizer_path(name)).counts(texts)
    if name == WORDS:
        assert counts == [len(i) for i in library(name)(texts)]
    assert all(n >= 0 for n in counts) and counts[0] == 0


def test_shortcut_is_proved():
    from tokenizers import Tokenizer

    proved = whole_tokens(Tokenizer.from_file(tokenizer_path(BYTES)))
    sample = random.Random(1).sample(sorted(proved), 2000)
    assert all(len(i) == 1 for s, i in zip(sample, library(BYTES)(sample)) if byte_level(s) == [s])
    assert len(proved) > 40_000


def test_fast_patterns_split_as_the_tokenizer_does():
    import regex
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    stable = regex.compile(f"[{STABLE_CHARACTERS}]")
    for code in [*range(1, 0x2100), *range(0x3000, 0xD7A4, 97)]:
        c = chr(code)
        text = f"a{c}{c}b 1{c} .{c}"
        want = [text[a:b] for _, (a, b) in split(text)]
        if is_latin(text):
            assert byte_level(text) == want, hex(code)
        elif stable.fullmatch(c):
            found = token_counter(tokenizer_path(BYTES))._find(text)
            assert found == want, hex(code)


def test_word_level_ids_equal_the_library():
    encode = encoder(tokenizer_path(WORDS)).encode
    chars = [f"a{chr(c)}B {chr(c)}1" for c in range(1, 0x0260)]
    texts = ODD + chars + [words(k, 100).title() for k in range(10)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == library(WORDS)(texts)
    assert word_level("it's") == ["it", "'s"]


def test_count_tokens_of_awkward_rows(awkward, empty):
    rows = count_tokens(awkward, tokenizer_path(BYTES), limit=512).collect()
    assert len(rows) == len(awkward_rows())
    ids = library(BYTES)
    for r in rows:
        texts = [t or "" for i, t in awkward_rows() if i == r.doc_id]
        assert (r.n_bytes, r.n_tokens) in [(len(t.encode()), len(ids([t])[0])) for t in texts]
        assert r.over_limit == (r.n_tokens > 512)
    assert count_tokens(empty, tokenizer_path(BYTES)).count() == 0


def check_packing(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_round_trip(awkward, empty):
    path = tokenizer_path(WORDS)
    packed = pack_documents(awkward, path, capacity=64, group_size=10, with_ids=True).cache()
    rows = packed.collect()
    check_packing(rows, 64)
    ids = library(WORDS)
    for i, t in awkward_rows():
        want = ids([t or ""])[0] + [1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        pieces = [r for r in own if r.ids == want[r.start : r.start + r.length]]
        assert {r.piece for r in pieces} >= set(range(-(-len(want) // 64)))
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.start == 64 * r.piece
    whole = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    assert all(whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in rows)
    assert pack_documents(empty, path).count() == 0


def plain_sum_of_squares(lengths, capacity):
    """The rule by definition: try every choice and sum the squares."""
    gaps, bins = [], []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        size = lengths[k]

        def cost(changed):
            counts = np.bincount([g for g in changed if g], minlength=capacity + 1)
            return int((counts**2).sum())

        choices = []
        for g in sorted({g for g in gaps if g >= size}):
            trial = list(gaps)
            trial[trial.index(g)] = g - size
            choices.append((cost(trial), 0, g))
        choices.append((cost([*gaps, capacity - size]), 1, capacity))
        _, new, g = min(choices)
        if new:
            gaps.append(capacity - size)
        else:
            gaps[gaps.index(g)] = g - size
        bins.append(g)
    return len(gaps), sorted(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_sum_of_squares_is_the_rule(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 33, 60)
    sequence, offset = sum_of_squares(lengths, 32)
    used = np.bincount(sequence, weights=lengths).astype(int)
    n, gaps = plain_sum_of_squares(lengths.tolist(), 32)
    assert (len(used), sorted(32 - used)) == (n, gaps)


def test_packing_is_near_the_lower_bound(make):
    rows = [(k, words(k, 5 + k % 90)) for k in range(600)]
    packed = pack_documents(make(rows), tokenizer_path(WORDS), capacity=512).collect()
    total = sum(r.length for r in packed)
    assert check_packing(packed, 512) <= -(-total // 512) + 1


def test_repeated_rows_are_dealt_over_the_groups(spark, monkeypatch):
    """Pieces that agree in everything: no group gets far more than its share."""
    pieces = spark.createDataFrame([(None, 0, 0, 7)] * 4000, "doc_id long, piece int, start long, length long")
    packed = pack_pieces(pieces, capacity=70, group_size=500)
    sizes = [r["count"] for r in packed.groupBy((packed.sequence_id % 8).alias("g")).count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 4000 and max(sizes) < 700
    assert packed.select("sequence_id").distinct().count() <= 408


def test_ids_of_any_type_are_counted(spark):
    rows = [("a", "x y"), (None, None), ("a", "")]
    got = count_tokens(spark.createDataFrame(rows, "doc_id string, text string"), tokenizer_path(BYTES)).collect()
    assert sorted(((r.doc_id or ""), r.n_bytes) for r in got) == [("", 0), ("a", 0), ("a", 3)]
