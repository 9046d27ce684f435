"""Token counts with the whole-token shortcut.

A byte-level BPE splits a text into pre-tokens and merges each on its own, so the count
of a text is the sum over its pre-tokens. Offline, before any text is read, every string
of the vocabulary is given to the merge procedure alone: those that come out as one
token are *proved* to count 1 wherever they stand as a pre-token. A text is then split
by the tokenizer's own pattern, proved strings are counted directly, and only the rest
goes through the merges (with a bounded memory of earlier results).

Counts equal the library's for every text: special strings inside a text count as their
special token (the library's default), and texts with characters on which the two
regular-expression engines may disagree are handed to the library as a whole, as are all
texts of tokenizers that are not byte-level BPE.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._arrow import text_slices, texts_of
from quern.llm._latin import Memory, byte_characters, byte_level, is_latin
from quern.session import ship_package

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose letter, number and space classes have been stable for long, so that
#: every engine agrees on them (checked over all of them in the tests).
STABLE_CHARACTERS = r"\x00-\u0557\u2000-\u208e\u20a0-\u20bf\u3000-\u9fef\uac00-\ud7a3"
#: Remembered merge results per worker; beyond it the memory starts anew.
MEMORY = 600_000


def whole_tokens(tokenizer) -> dict[str, int]:
    """The proof: vocabulary strings that the merges leave as one token, as plain text."""
    to_byte = {c: b for b, c in byte_characters().items()}
    proved = {}
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(to_byte[c] for c in piece).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if len(tokenizer.model.tokenize(piece)) == 1:
            proved[text] = 1
    return proved


class TokenCounter:
    """Counts tokens of texts with one tokenizer file."""

    def __init__(self, path: str):
        self._fast = False
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self._library = lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._library = lambda texts: [
            len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)
        ]
        config = json.loads(tokenizer.to_str())
        split = config.get("pre_tokenizer") or {}
        added = config.get("added_tokens", [])
        self._fast = (
            config["model"]["type"] == "BPE"
            and not config["model"].get("end_of_word_suffix")
            and not config["model"].get("continuing_subword_prefix")
            and not config.get("normalizer")
            and split.get("type") == "ByteLevel"
            and split.get("use_regex")
            and not split.get("add_prefix_space")
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        )
        if not self._fast:
            return
        import regex

        shown = byte_characters()
        merge = tokenizer.model.tokenize
        self._counts = Memory(
            whole_tokens(tokenizer),
            lambda s: len(merge("".join(map(shown.__getitem__, s.encode("utf-8"))))),
            MEMORY,
        )
        self._find = regex.compile(BYTE_LEVEL_PATTERN).findall
        self._unusual = regex.compile(f"[^{STABLE_CHARACTERS}]").search
        specials = sorted((t["content"] for t in added), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def _count(self, text: str) -> int:
        counts, find = self._counts, byte_level if is_latin(text) else self._find
        if self._special is None or not self._special.search(text):
            return sum(map(counts.__getitem__, find(text)))
        parts = self._special.split(text)
        return len(parts) - 1 + sum(sum(map(counts.__getitem__, find(part))) for part in parts if part)

    def counts(self, texts: list[str]) -> list[int]:
        if not self._fast:
            return self._library(texts)
        out = [self._count(x) if is_latin(x) or not self._unusual(x) else None for x in texts]
        rest = [k for k, n in enumerate(out) if n is None]
        for k, n in zip(rest, self._library([texts[k] for k in rest])):
            out[k] = n
        return out


@lru_cache(maxsize=4)
def token_counter(path: str) -> TokenCounter:
    """One counter per worker process and file."""
    return TokenCounter(path)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    limit: int | None = None,
) -> DataFrame:
    """``id, n_bytes, n_tokens`` (and ``over_limit`` if ``limit`` is given) per row.

    One map over the rows, without a shuffle. Null text counts as empty (0 bytes and
    tokens); ids may be of any type; null ids and repeated rows pass through; an empty
    table gives an empty table; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def count(batches):
        counter = token_counter(tokenizer_path)
        for batch in text_slices(batches, 1):
            texts = texts_of(batch.column(1))
            n_bytes = pa.array([len(x.encode("utf-8")) for x in texts], pa.int64())
            n_tokens = pa.array(counter.counts(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], ["_id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, f"_id {kind}, n_bytes long, n_tokens long")
    columns = [F.col("_id").alias(id_col), "n_bytes", "n_tokens"]
    if limit is not None:
        columns.append((F.col("n_tokens") > limit).alias("over_limit"))
    return counted.select(*columns)
