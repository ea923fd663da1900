"""Labelled training rows, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Labelled rows that a classifier is fitted on at most.
SAMPLE = 20_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """text and label (0 or 1) of a sample: the ``limit`` labelled rows of smallest hash that aren't held out.

    Rows without id, with a null label, or with both labels for an id count for nothing.
    The sample's ids are broadcast: at most ``limit`` pairs of numbers.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).where("_id is not null and label is not null")
    own = own.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("_max")).where("label = _max").drop("_max")
    own = own.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return written(texts.join(F.broadcast(own), "_id").select("text", F.when(F.col("label") > 0, 1).otherwise(0).alias("label")), f"train-{label}")
