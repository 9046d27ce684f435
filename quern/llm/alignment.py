"""Alignment of two tokenizers' tokens, by bitsets over the bytes of the texts.

Both tokenizers cut the same bytes. The ends of each one's tokens are marked in a packed
bitset (a bit per byte of a block of texts, 64 to a word). The AND of the two bitsets is
where both end a token: these cuts part the text into groups. The OR marks where either
ends one: every stretch between two such marks lies in one token of each, and is one link
between them. Ranks, by the number of set bits up to a place (a running sum over words and
a population count within one), turn byte places into token numbers, so groups and links
come out of a few vector operations per block.

How often a pair of ids is linked is counted in documents over the whole corpus. A block's
documents are aligned once; what is kept of them, in one written row per block, is the
block's distinct pairs and, per document, which of them it holds and how often. The pairs
of all blocks are counted; each block then gets back the counts of its own pairs (at most
one row per block and pair, joined by pair and gathered by block) and sums them up for its
documents. Texts are read and tokenized once and never shuffled, no id pair meets more rows
than there are blocks, and nothing is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._arrow import runs, text_slices, texts_of
from quern.llm._latin import byte_characters, is_latin
from quern.llm.token_counts import BYTE_LEVEL_PATTERN, STABLE_CHARACTERS
from quern.session import materialize, ship_package

#: Remembered stretches of text per worker; beyond it the memory starts anew.
MEMORY = 400_000
#: Bytes of text that are aligned together, and that make a block's row.
SLICE, BLOCK = 2 << 20, 16 << 20
#: How pieces show a space, and how they show a byte.
SPACE_MARK, BYTE_PIECES = "▁", {f"<0x{b:02X}>": bytes([b]) for b in range(256)}

_GROUPS = "_part long, _at int, _id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _codes binary"


def _spelled(ids: list[int], bytes_of: list[bytes], text: str) -> np.ndarray | None:
    """The ids, if their bytes are those of space and text."""
    whole = b"".join(map(bytes_of.__getitem__, ids))
    return np.array(ids, "<u4") if whole == b" " + text.encode() else None


class ByteLevelSide:
    """Ids of ``space + text`` by a byte-level BPE (``tokenizers``), special strings as plain
    text.

    Where the vocabulary's merges are in the order of their ids, as its file proves, the ids
    are ranks and ``tiktoken`` merges by them in the same way. Texts on whose characters the
    two libraries' splitting may disagree go to the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = True
        self._library = lambda text: tokenizer.encode(" " + text, add_special_tokens=False).ids
        config = json.loads(tokenizer.to_str())
        split, vocabulary = config.get("pre_tokenizer") or {}, config["model"]["vocab"]
        to_byte = {c: b for b, c in byte_characters().items()}
        self.bytes_of = [b""] * (max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
        for piece, number in vocabulary.items():
            self.bytes_of[number] = bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in config["model"].get("merges", [])]
        made = [vocabulary[c] for c in to_byte if c in vocabulary] + [vocabulary[m] for m in merges]
        self._fast = (
            config["model"]["type"] == "BPE" and not config.get("normalizer") and split.get("type") == "ByteLevel"
            and split.get("use_regex") and not split.get("add_prefix_space")
            and not config["model"].get("end_of_word_suffix") and not config["model"].get("continuing_subword_prefix")
            and len(made) == 256 + len(merges) and max(made[:256]) < made[256] and np.all(np.diff(made[256:]) > 0)
        )
        if self._fast:
            ranks = {self.bytes_of[i]: i for i in made}
            self._encode = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self._unusual = regex.compile(f"[^{STABLE_CHARACTERS}]").search

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        out = []
        for text in texts:
            if self._fast and (is_latin(text) or not self._unusual(text)):
                out.append(self._encode(" " + text, disallowed_special=()))
            else:
                out.append(_spelled(self._library(text), self.bytes_of, text))
        return out


class PieceSide:
    """Ids by a ``sentencepiece`` model, which adds the space itself.

    If the model leaves texts as they are and has no piece with a space after another
    character nor one with a line end, as its vocabulary proves, no merge ever crosses a line
    end or the start of a run of spaces. Texts are then cut there; the stretches that are not
    remembered are encoded together, with line ends between them. Else, and where the tokens
    do not spell their stretch, texts go to the library whole.
    """

    def __init__(self, path: str):
        import re

        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._encode = lambda text: model.encode(text, num_threads=1)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(len(pieces))]
        self.bytes_of = [
            b"" if out else BYTE_PIECES.get(x) or x.replace(SPACE_MARK, " ").encode() for x, out in zip(pieces, special)
        ]
        probe = "\ufb01  \u212b e\u0301 \xa0\u3000x "
        self._line = model.piece_to_id("<0x0A>")
        self._fast = (
            model.normalize(probe) == SPACE_MARK + probe.replace(" ", SPACE_MARK)
            and not any(SPACE_MARK in x.lstrip(SPACE_MARK) or "\n" in x for x in pieces)
            and model.encode("\n") == [model.piece_to_id(SPACE_MARK), self._line]
        )
        self._known: dict[str, bytes | None] = {}
        self._find = re.compile(r"\n| *[^ \n]+| +").findall

    def _learn(self, stretches: list[str]) -> None:
        text = "".join("\n" + x for x in stretches)
        ids = self._encode(text)
        spelled = b"".join(map(self.bytes_of.__getitem__, ids)) == b" " + text.encode()
        if not spelled and len(stretches) > 1:
            for x in stretches:
                self._learn([x])
            return
        found = np.array(ids, "<u4")
        starts = np.flatnonzero(found == self._line) + 1
        data = found.tobytes()
        for x, start, stop in zip(stretches, (4 * starts).tolist(), (4 * np.r_[starts[1:] - 1, len(found)]).tolist()):
            self._known[x] = data[start:stop] if spelled else None

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        if not self._fast:
            return [_spelled(self._encode(x), self.bytes_of, x) for x in texts]
        stretches = [self._find(" " + x) for x in texts]
        wanted = set().union(*stretches)
        if len(self._known) + len(wanted) > MEMORY:
            self._known = {}
        self._known["\n"] = np.array([self._line], "<u4").tobytes()
        new = list(wanted - self._known.keys())
        for k in range(0, len(new), 10_000):
            self._learn(new[k : k + 10_000])
        out = []
        for text, parts in zip(texts, stretches):
            try:
                out.append(np.frombuffer(b"".join(map(self._known.__getitem__, parts)), "<u4"))
            except TypeError:  # a stretch that its tokens do not spell
                out.append(_spelled(self._encode(text), self.bytes_of, text))
        return out


class Side:
    """One tokenizer with the byte length, and the decimal digits, of each id."""

    def __init__(self, path: str):
        encoder = (PieceSide if path.endswith(".model") else ByteLevelSide)(path)
        self.encode = encoder.encode
        self.size = len(encoder.bytes_of)
        self.lengths = np.array([len(x) for x in encoder.bytes_of], np.int64)
        #: Decimal digits and what follows them in eight bytes, filled up with zeros.
        self.digits = {e: np.array([str(i).encode() + e for i in range(self.size)], "S8").view("<u8") for e in (b",", b"|", b";")}
        self.n_digits = np.array([len(str(i)) for i in range(self.size)])


@lru_cache(maxsize=4)
def side(path: str) -> Side:
    return Side(path)


class Bits:
    """A packed bitset with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self._before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-size // 64) * 64, np.uint8)
        marks[places] = 1
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = places >> 6
        below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        inside = np.bitwise_count(self.words[np.minimum(word, len(self.words) - 1)] & below) if len(self.words) else 0
        return self._before[word] + np.where(word < len(self.words), inside, 0)

    def places(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def align(a: Side, b: Side, texts: list[str]):
    """Per text: tokens of each side, groups, links, the groups' digest; and of all links the
    number of their text and their pair (id of a * size of b + id of b)."""
    n, none = len(texts), np.zeros(0, "<u4")
    ids_a, ids_b = a.encode(texts), b.encode(texts)
    for k, text in enumerate(texts):
        if not text or ids_a[k] is None or ids_b[k] is None:
            ids_a[k] = ids_b[k] = none
    sizes = np.array([len(text.encode("utf-8")) + 1 if len(ids) else 0 for text, ids in zip(texts, ids_a)], np.int64)
    count_a, count_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    ids_a, ids_b = (np.concatenate([none, *ids]).astype(np.int64) for ids in (ids_a, ids_b))
    total, stops = int(sizes.sum()), np.cumsum(sizes)
    ends_a = Bits.of(np.cumsum(a.lengths[ids_a]) - 1, total)
    ends_b = Bits.of(np.cumsum(b.lengths[ids_b]) - 1, total)
    shared, either = Bits(ends_a.words & ends_b.words), Bits(ends_a.words | ends_b.words)
    per_text = lambda bits: np.diff(np.r_[0, bits.rank(stops)])
    n_groups, n_links = per_text(shared), per_text(either)
    cuts = shared.places()
    digests = _digests(a, b, ids_a, ids_b, ends_a.rank(cuts + 1), ends_b.rank(cuts + 1), count_a, count_b)
    at = either.places()
    pairs = ids_a[ends_a.rank(at)] * b.size + ids_b[ends_b.rank(at)]
    return count_a, count_b, n_groups, n_links, digests, np.repeat(np.arange(n), n_links), pairs


def _digests(a: Side, b: Side, ids_a, ids_b, stops_a, stops_b, count_a, count_b) -> list[str]:
    """Digests of ``a1,a2|b1;a3|b2,b3`` per text: all texts are written into one array, eight
    bytes per token, whose zero bytes are then taken out."""
    starts_a, starts_b = np.r_[0, stops_a[:-1]], np.r_[0, stops_b[:-1]]
    group_a, group_b = np.repeat(np.arange(len(stops_a)), stops_a - starts_a), np.repeat(np.arange(len(stops_b)), stops_b - starts_b)
    shown, lengths = np.zeros(len(ids_a) + len(ids_b), "<u8"), np.zeros(len(ids_a) + len(ids_b), np.int64)
    at_a, at_b = np.arange(len(ids_a)) + starts_b[group_a], np.arange(len(ids_b)) + stops_a[group_b]
    for tokens, ids, at, last, end in ((a, ids_a, at_a, stops_a - 1, b"|"), (b, ids_b, at_b, stops_b - 1, b";")):
        shown[at], lengths[at] = tokens.digits[b","][ids], tokens.n_digits[ids] + 1
        shown[at[last]] = tokens.digits[end][ids[last]]
    data = shown.tobytes().translate(None, b"\0")
    stops = np.r_[0, np.cumsum(lengths)][np.cumsum(count_a + count_b)].tolist() if len(count_a) else []
    out, start = [], 0
    for stop in stops:
        out.append(hashlib.sha256(data[start : stop - 1]).hexdigest() if stop > start else "")
        start = stop
    return out


def _squeezed(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending codes and how often each occurs, as compressed differences."""
    planes = np.stack([np.diff(codes, prepend=0), counts]).astype("<u4").view(np.uint8).reshape(-1, 4)
    return zlib.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def _restored(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").reshape(2, -1).astype(np.int64)
    return np.cumsum(both[0]), both[1]


class _Part:
    """What a block of documents leaves: a row per document, and a row with its pairs."""

    def __init__(self):
        self.rows, self.pairs, self.owners, self.counts, self.bytes, self.n = [], [], [], [], 0, 0

    def add(self, ids: pa.Array, aligned, size: int) -> None:
        count_a, count_b, n_groups, n_links, digests, owner, pairs = aligned
        key, times = np.unique(owner * (1 << 40) + pairs, return_counts=True)
        self.pairs.append(key & ((1 << 40) - 1))
        self.owners.append((key >> 40) + self.n)
        self.counts.append(times)
        self.rows.append((ids, count_a, count_b, n_groups, n_links, digests))
        self.n += len(count_a)
        self.bytes += size

    def batches(self, number: int, schema: pa.Schema):
        """The block's documents; the first carries the block's pairs and in how many of its
        documents each occurs. Frequent pairs have small codes."""
        known, codes, documents = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        order = np.argsort(-documents, kind="stable")
        code_of = np.empty(len(order), np.int64)
        code_of[order] = np.arange(len(order))
        codes, owners, counts = code_of[codes], np.concatenate(self.owners), np.concatenate(self.counts)
        by_owner = np.lexsort((codes, owners))
        codes, counts = codes[by_owner], counts[by_owner]
        held: list[bytes | None] = [None] * self.n
        for start, stop in zip(*runs(owners[by_owner])):
            held[int(owners[by_owner[start]])] = _squeezed(codes[start:stop], counts[start:stop])
        ids = pa.concat_arrays([x[0] for x in self.rows])
        columns = [np.concatenate([x[k] for x in self.rows]) for k in range(1, 5)]
        digests = [d for x in self.rows for d in x[5]]
        empty = [[]] * (self.n - 1)
        arrays = [
            pa.array(np.full(self.n, number), pa.int64()), pa.array(np.arange(self.n), pa.int32()), ids, *(pa.array(c, pa.int64()) for c in columns),
            pa.array(digests, pa.string()), pa.array(held, pa.binary()),
            pa.array([known[order], *empty], pa.list_(pa.int64())), pa.array([documents[order], *empty], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Aligned documents in blocks: each row's counts and digest, its pairs as codes within
    its block, and in a block's first row the pairs that the codes stand for."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        a, b, task, number, part, schema = side(a_path), side(b_path), TaskContext.get().partitionId(), 0, _Part(), None
        for batch in text_slices(batches, 1, SLICE):
            if schema is None:
                names = "_part _at _id n_a n_b n_groups n_links groups_sha256 _codes _pairs _documents".split()
                types = [pa.int64(), pa.int32(), batch.schema.field(0).type, *[pa.int64()] * 4, pa.string(), pa.binary(), *[pa.list_(pa.int64())] * 2]
                schema = pa.schema(list(zip(names, types)))
            texts = texts_of(batch.column(1))
            part.add(batch.column(0), align(a, b, texts), sum(map(len, texts)))
            if part.bytes >= BLOCK:
                yield from part.batches((task << 32) + number, schema)
                number, part = number + 1, _Part()
        if part.n:
            yield from part.batches((task << 32) + number, schema)

    return rows.mapInArrow(run, _GROUPS.format(kind=kind) + ", _pairs array<long>, _documents array<long>")


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row.

    ``a_path`` is a ``tokenizers`` file of a byte-level BPE, ``b_path`` a ``sentencepiece``
    model. ``count_sum`` adds up, over a row's links, in how many rows of the corpus their
    pair is linked; ``n_best`` counts the links whose pair has the most of all pairs of its
    id of ``a``.

    Defined results: null and empty texts, and texts whose tokens do not spell them, have no
    tokens, zeros and an empty digest; repeated rows and null ids count as rows of their own;
    an empty table gives an empty table; other columns are ignored. A text is never cut.
    """
    blocks = materialize(aligned_blocks(docs, a_path, b_path, id_col, text_col), "aligned")
    held = blocks.filter("size(_pairs) > 0").select("_part", F.posexplode(F.arrays_zip("_pairs", "_documents")).alias("_code", "_x"))
    held = held.select("_part", "_code", F.col("_x._pairs").alias("_pair"), F.col("_x._documents").alias("_n"))
    counts = held.groupBy("_pair").agg(F.sum("_n").alias("_count"))
    width = _b_size(b_path)
    counts = materialize(counts.withColumn("_a", F.expr(f"_pair div {width}")), "pairs")
    most = counts.groupBy("_a").agg(F.max("_count").alias("_most"))
    known = counts.join(most, "_a").select("_pair", "_count", (F.col("_count") == F.col("_most")).alias("_best"))
    asked = held.select("_part", "_code", "_pair").join(materialize(known, "known"), "_pair")
    answers = asked.select(F.col("_part").alias("_of"), "_code", F.when(F.col("_best"), -F.col("_count")).otherwise(F.col("_count")).alias("_count"))
    schema = blocks.select("_part", "_at", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_codes")

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        count = np.zeros(right.num_rows, np.int64)
        count[right.column("_code").to_numpy()] = right.column("_count").to_numpy()
        value, best = np.abs(count), count < 0
        n_best, total = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
        for k, data in enumerate(left.column("_codes")):
            if data.is_valid:
                codes, times = _restored(data.as_py())
                n_best[k], total[k] = times[best[codes]].sum(), (times * value[codes]).sum()
        kept = left.select(["_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return kept.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(total))

    kind = blocks.schema["_id"].dataType.simpleString()
    out = f"_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    summed = schema.groupBy("_part").cogroup(answers.groupBy("_of")).applyInArrow(sums, out)
    return summed.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _b_size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
