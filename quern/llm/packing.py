"""Best-fit packing of tokenized documents by the sum-of-squares rule.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens. Pieces are
then packed into sequences: with N(g) the number of open sequences that have a gap of g
tokens left, a piece goes where the sum of N(g) squared over all gaps becomes smallest
(an open sequence with a large enough gap, or a new one; ties take the smallest gap).
Long pieces come first, which leaves the many short ones to fill the gaps exactly.

The rule needs only lengths, so packing moves a few numbers per piece and no text. Pieces
are dealt at random over groups of about ``group_size`` pieces and every group packs on
its own: a task's memory is bounded, no source or length is hot, and the share of tokens
lost is about one partly filled sequence per group.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._arrow import text_slices, texts_of
from quern.llm._latin import Memory, byte_characters, is_latin, word_level
from quern.session import materialize, ship_package

#: Remembered pre-tokens per worker; beyond it the memory starts anew.
MEMORY = 400_000


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    For tokenizers with word ends (lower case, white space dropped) Latin texts are
    split into pre-tokens here and each distinct one is merged once; all other texts and
    tokenizers go to the library as they are.
    """

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._encode = lambda texts: [
            np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)
        ]
        config = json.loads(tokenizer.to_str())
        steps = [x.get("type") for x in (config.get("normalizer") or {}).get("normalizers", [])]
        split = (config.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        #: Fixed value: the pre-token pattern of this kind of vocabulary.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self._fast = (
            steps == ["NFC", "Replace", "Lowercase"]
            and (split.get("pattern") or {}).get("Regex") == pattern
            and split.get("behavior") == "Removed"
            and config["model"]["type"] == "BPE"
        )
        self._specials = [t["content"] for t in config.get("added_tokens", [])]
        shown, merge = byte_characters(), tokenizer.model.tokenize

        def ids(pre_token: str) -> bytes:
            pieces = merge("".join(map(shown.__getitem__, pre_token.encode("utf-8"))))
            return np.array([t.id for t in pieces], "<u4").tobytes()

        self._ids = Memory({}, ids, MEMORY)

    def _pre_tokens(self, text: str) -> list[str] | None:
        """The pre-tokens, or None where only the library is known to be exact. U+0130 is
        the one character here whose lower case is not one character."""
        lowered = text.lower()
        if not is_latin(text) or not is_latin(lowered) or "\u0130" in text or any(s in text for s in self._specials):
            return None
        return word_level(lowered)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self._fast:
            return self._encode(texts)
        get = self._ids.__getitem__
        out: list[bytes | None] = []
        for text in texts:
            found = self._pre_tokens(text)
            out.append(None if found is None else b"".join(map(get, found)))
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self._encode([texts[k] for k in rest])):
            out[k] = x
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    capacity: int = 4096,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and ``ids`` if asked) per piece.

    A document is its token ids and then ``end_id``; only longer ones are cut. Null text
    counts as empty (one piece, the end alone). Repeated rows give repeated pieces, rows
    with a null id are cut like any other, an empty table gives an empty table, and other
    columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def cut(batches):
        encode = encoder(tokenizer_path).encode
        for batch in text_slices(batches, 1):
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, data in enumerate(encode(texts_of(batch.column(1)))):
                data += end
                for n, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    owner.append(k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(owner, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)),
            ]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(cut, schema + ", ids array<int>" * with_ids).withColumnRenamed("_id", id_col)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, longest pieces first."""
    open_with = np.zeros(capacity + 1, np.int64)  # N(g)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        new = 2 * int(open_with[capacity - size]) + 1 if size < capacity else 0
        best = new + 1
        if size < capacity:
            gaps = open_with[size:]
            change = 2 * (open_with[: capacity + 1 - size] - gaps) + 2
            change[0] = 1 - 2 * int(gaps[0])  # a filled sequence is no longer open
            change[gaps == 0] = np.iinfo(np.int64).max
            at = int(change.argmin())
            best = int(change[at])
        if best <= new:
            gap = size + at
            number = stacks[gap].pop()
            open_with[gap] -= 1
        else:
            gap, number, made = capacity, made, made + 1
        sequence[k], offset[k] = number, capacity - gap
        if gap > size:
            stacks[gap - size].append(number)
            open_with[gap - size] += 1
    return sequence, offset


def pack_pieces(
    pieces: DataFrame,
    id_col: str = "doc_id",
    *,
    capacity: int = 4096,
    group_size: int = 16_384,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; all columns stay.

    Lengths must be from 1 to ``capacity``. A sequence's pieces lie one after another
    from offset 0. ``pieces`` is read twice (to count and to pack), so give a
    materialized table. Groups go by the rows' numbers, so repeated rows and null ids are
    dealt like any others. An empty table gives an empty table.
    """
    ship_package(pieces.sparkSession)
    groups = max(1, round(pieces.count() / group_size))
    length_at = pieces.columns.index("length")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        order = table.sort_by([(id_col, "ascending"), ("piece", "ascending")])
        sequence, offset = sum_of_squares(order.column(length_at).to_numpy(), capacity)
        sequence = sequence * groups + order.column("_group")[0].as_py()
        return (
            order.drop_columns(["_group"])
            .append_column("sequence_id", pa.array(sequence, pa.int64()))
            .append_column("offset", pa.array(offset, pa.int64()))
        )

    return dealt.groupBy("_group").applyInArrow(pack, f"{fields}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    capacity: int = 4096,
    end_id: int = 1,
    group_size: int = 16_384,
    with_ids: bool = False,
) -> DataFrame:
    """Tokenize, cut and pack: one row per piece with its place. See ``token_pieces`` and
    ``pack_pieces``; the pieces are written to the shared folder between the two."""
    pieces = token_pieces(
        docs, tokenizer_path, id_col, text_col, capacity=capacity, end_id=end_id, with_ids=with_ids
    )
    return pack_pieces(materialize(pieces, "pieces"), id_col, capacity=capacity, group_size=group_size)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id, n_tokens, ids``, from pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids")
    )
