"""The chunker as a table function of SQL: ``SELECT * FROM chunk(TABLE(docs), 'recursive', 500, 50)``.

The function is polymorphic: its result has the input table's columns, but for the text, and
the chunk's own, so it stands wherever a table does. It has the paragraph and the recursive
strategy with the results of ``chunking.chunk_documents``, which is the faster form where no
SQL is asked for: that one stays inside the engine, this one runs in Python workers.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quern.functions.text import GO_SPACE
from quern.operators.chunking import chunk_parameters
from quern.session import ship_package

OWN = (("chunk_index", IntegerType()), ("chunk", StringType()), ("start", IntegerType()), ("stop", IntegerType()))
STRATEGIES = ("paragraph", "recursive")

Segment = tuple[str, int, int]


def trimmed(part: str, start: int) -> Segment:
    """The trimmed text and its places, in characters."""
    inner = part.strip(GO_SPACE)
    at = start + len(part) - len(part.lstrip(GO_SPACE))
    return inner, at, at + len(inner)


def windows(text: str, target: int, overlap: int, base: int = 0) -> list[Segment]:
    """Windows of ``target`` stepping by ``target - overlap``; the last ends with the text."""
    step = target - overlap
    last = 0 if len(text) <= target else -(-(len(text) - target) // step)
    found = (trimmed(text[i * step : i * step + target], base + i * step) for i in range(last + 1))
    return [s for s in found if s[0]]


def paragraphs(text: str) -> list[Segment]:
    """Trimmed parts between blank lines; the whole trimmed text if there is none."""
    out, at = [], 0
    for part in text.split("\n\n"):
        out.append(trimmed(part, at))
        at += len(part) + 2
    whole = text.strip(GO_SPACE)
    return [s for s in out if s[0]] or [(whole, 0, len(whole))]


def chunks(text: str | None, strategy: str, target: int, overlap: int) -> Iterator[Segment]:
    if not text or not text.strip(GO_SPACE):
        return
    for s in windows(text, target, overlap) if strategy == "recursive" else paragraphs(text):
        yield from [s] if len(s[0]) <= target else windows(s[0], target, overlap, s[1])


class Chunk:
    """``chunk(TABLE(t) [PARTITION BY (...)], strategy, target, overlap, text => 'text')``."""

    @staticmethod
    def analyze(
        table: AnalyzeArgument, strategy: AnalyzeArgument, target: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, text: AnalyzeArgument | None = None
    ) -> AnalyzeResult:
        """The result's columns; wrong arguments are errors before anything runs."""
        if not table.isTable:
            raise ValueError("the first argument is a table: chunk(TABLE(docs), ...)")
        if not strategy.isConstantExpression or str(strategy.value).strip().lower() not in STRATEGIES:
            raise ValueError(f"the strategy is one of {', '.join(STRATEGIES)}")
        name = "text" if text is None else text.value
        if name not in table.dataType.names:
            raise ValueError(f"the table has no column {name}")
        schema = StructType([f for f in table.dataType.fields if f.name != name])
        taken = set(schema.names) & {c for c, _ in OWN}
        if taken:
            raise ValueError(f"the table has columns of the result's own names: {', '.join(sorted(taken))}")
        for column, kind in OWN:
            schema = schema.add(column, kind)
        return AnalyzeResult(schema=schema)

    def eval(self, row: Row, strategy: str, target: int | None = None, overlap: int | None = None, text: str = "text"):
        target, overlap = chunk_parameters(target, overlap)
        kept = [row[c] for c in row.__fields__ if c != text]
        for k, (chunk, start, stop) in enumerate(chunks(row[text], strategy.strip().lower(), target, overlap)):
            yield (*kept, k, chunk, start, stop)


def register(spark: SparkSession, name: str = "chunk") -> None:
    """Make the function known to the session's SQL."""
    ship_package(spark)
    spark.udtf.register(name, udtf(Chunk))
