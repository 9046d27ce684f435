"""Token alignment against a plain walk over both libraries' tokens."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from quern.llm._latin import byte_characters
from quern.llm.alignment import Bits, align_tokens, side
from quern.llm.queries import tokenizer_path
from tests.llm.conftest import awkward_rows, documents, words

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
STRANGE = [
    "a<|endoftext|>b <s> <unk> </s> <0x0A>", "  two  spaces\n\n   and lines \n", "▁ marks ▁", "\t tab\x0b\x0c\r\n x", "ﬁ Å é \xa0　x",
    "naïve façade 中文文本 和 日本語 😀😀", " ", "\n", "\x00\x1c", "don't we'll I'M 12345 3.14", "word" * 3000, "᭄ᬓ ꩜ \U0001e900",
]


def plain(rows):
    """(id, text) -> the result, by loops over token pairs."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    to_byte = {c: b for b, c in byte_characters().items()}

    def b_bytes(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for key, text in rows:
        a, b = [], []
        if text:
            data = b" " + text.encode()
            ids = tokenizer.encode(" " + text, add_special_tokens=False).ids
            a = [(i, bytes(to_byte[c] for c in tokenizer.id_to_token(i))) for i in ids]
            b = [(i, b_bytes(i)) for i in model.encode(text)]
            if b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
                a = b = []
        links, groups, i, j, at_a, at_b, open_a, open_b = [], [], 0, 0, 0, 0, [], []
        while i < len(a):  # every overlap of the two, by the ends
            stop_a, stop_b = at_a + len(a[i][1]), at_b + len(b[j][1])
            links.append((a[i][0], b[j][0]))
            if stop_a <= stop_b:
                open_a.append(a[i][0])
                i, at_a = i + 1, stop_a
            if stop_b <= stop_a:
                open_b.append(b[j][0])
                j, at_b = j + 1, stop_b
            if stop_a == stop_b:
                groups.append((open_a, open_b))
                open_a, open_b = [], []
        found.append((key, len(a), len(b), groups, links))
    count = Counter(pair for *_, links in found for pair in set(links))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for key, n_a, n_b, groups, links in found:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if n_a else ""
        best = sum(count[p] == most[p[0]] for p in links)
        out.append((key, n_a, n_b, len(groups), len(links), best, sum(count[p] for p in links), digest))
    return Counter(out)


def result(df):
    return Counter(tuple(r) for r in df.collect())


def test_alignment_is_that_of_plain_loops(spark, make):
    rows = awkward_rows() + [(100 + k, x) for k, x in enumerate(STRANGE)] + [(200 + k, words(k % 7, 50)) for k in range(40)]
    assert result(align_tokens(make(rows).repartition(3), A, B)) == plain(rows)


def test_alignment_over_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(align_tokens(docs, A, B)) == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_small_blocks_give_the_same(spark, make, monkeypatch):
    rows = [(k, words(k % 5, 30)) for k in range(60)]
    whole = result(align_tokens(make(rows), A, B))
    monkeypatch.setattr("quern.llm.alignment.BLOCK", 300)
    monkeypatch.setattr("quern.llm.alignment.SLICE", 200)
    assert result(align_tokens(make(rows).repartition(4), A, B)) == whole


@pytest.mark.parametrize("path", [A, B])
def test_fast_paths_are_proved(path):
    encoder = side(path).encode.__self__
    assert encoder._fast


def test_ids_of_any_type_and_empty_tables(spark, empty):
    assert align_tokens(empty, A, B).collect() == []
    named = documents(spark, [(1, "a b")]).selectExpr("cast(doc_id as string) as key", "text as body")
    assert align_tokens(named, A, B, "key", "body").first().key == "1"


def test_ranks_of_a_bitset():
    import numpy as np

    marks = np.random.default_rng(1).random(1000) < 0.3
    bits = Bits.of(np.flatnonzero(marks), len(marks))
    assert np.array_equal(bits.places(), np.flatnonzero(marks))
    assert np.array_equal(bits.rank(np.arange(1001)), np.r_[0, np.cumsum(marks)])
