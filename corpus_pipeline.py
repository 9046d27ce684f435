"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept and all but the last return the columns
of ``documents``: rows the quality classifier rejects go, of equal texts the row of the
largest id stays, of each group of near-duplicates the row of the smallest id stays,
documents that hold benchmark passages go, and the rest is tokenized and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.decontaminate import drop_contaminated
from quern.llm.exact_dedup import drop_exact_copies
from quern.llm.packing import pack_documents
from quern.llm.quality import keep_good
from quern.llm.queries import tokenizer_path
from quern.llm.simhash import drop_near_copies
from quern.session import materialize, spread

#: The near-duplicate and packing stages are not SQL; the tests compare the pipeline with
#: a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written and read again."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
