"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Toxic documents go, then low-quality ones, then all but one document of each group of near
duplicates (five words, similarity 0.8); the rest is mixed to the target weights of its
sources (a document comes as often as the mix takes it, down to not at all), and encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor, extra columns
included, whatever their names.  Defined cases are those of the operators; rows with null or
repeated ids go through all stages as rows of their own.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, mixing, neardup, quality, toxicity
from quillspark.llm.common import table, written

#: SQL can't express trained models, MinHash or merges; the stages are tested one by one.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.filtered(docs, model, lambda toxic: ~toxic)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.filtered(docs, model, lambda good: good)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, by row and not by id: null and repeated ids make no difference."""
    return neardup.deduplicated(docs, shingle_words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole passes, and one more by chance for a part of a pass."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, Path(path).read_bytes(), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
