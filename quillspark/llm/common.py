"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space that separates words: the complement of ``[^\\x20\\x09-\\x0D]``.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_OWN_DIR: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and the master is
    local (tests on one machine) a folder of our own is made and remembered.
    """
    global _OWN_DIR
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="quillspark-")
    return _OWN_DIR


def written(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that survive the loss of executors.
    """
    path = f"{shared_dir(df.sparkSession)}/quillspark/{name}-{uuid.uuid4().hex}"
    writer = df.write
    parts = list(partition_by)
    if parts:
        writer = writer.partitionBy(*parts)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A table of a few rows that the driver holds, as one literal of the plan (no Python RDD)."""
    names = [c.split()[0] for c in schema.split(", ")]
    kind = "array<struct<" + ", ".join(c.replace(" ", ": ", 1) for c in schema.split(", ")) + ">>"
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows], ensure_ascii=False)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def arrow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Skip the empty batches that Spark may hand to a worker."""
    return (b for b in batches if b.num_rows)


def bucketed_prefix(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, buckets: Column, seed: int = 7) -> DataFrame:
    """Exclusive prefix sum of ``value`` within ``keys``, in two levels.

    Rows of a key are dealt to its ``buckets`` hash buckets (about the root of its rows makes
    both levels equally small), so a hot key spreads over many tasks; the order inside a key is
    (bucket, ``order``).  Only the bucket totals of a key meet in one task.  Adds ``out`` and the
    columns ``_bucket`` and ``_seq``, which with ``keys`` identify a row.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), *order), buckets))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    df = df.withColumn("_seq", F.row_number().over(local)).withColumn(
        "_local", F.sum(value).over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    )
    totals = df.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_total"))
    totals = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), "_total")
    before = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket") == F.col("_b")]
    joined = df.join(totals, on, "left")
    return joined.withColumn(out, F.col("_base") + F.col("_local")).drop("_base", "_local", "_b", *[f"_k_{k}" for k in keys])


def text_hash(text: Column) -> Column:
    """By this and its id a row is found again when its table is read once more; null for a null text."""
    text = text.cast("string")
    return F.when(text.isNotNull(), F.xxhash64(text))


def taken_rows(docs: DataFrame, keys: dict[str, Column], wanted: DataFrame, times: str = "times", rows: str = "rows") -> DataFrame:
    """The rows of docs, all columns as they are, that ``wanted`` names by the keys (nulls are equal), each ``times`` times.

    ``wanted`` has one row for each key; where ``rows`` (how many rows of docs have the key) is
    more than one, one of them stands for all.  The input's columns travel in a struct, so none
    of their names can clash.
    """
    held = docs.select(F.struct("*").alias("row"), *[c.alias(f"k_{k}") for k, c in keys.items()])
    named = wanted.select(*[F.col(k).alias(f"w_{k}") for k in keys], F.col(times).alias("times"), F.col(rows).alias("rows"))
    on = [F.col(f"k_{k}").eqNullSafe(F.col(f"w_{k}")) for k in keys]
    # both sides grow with the input: a small one isn't gathered in the driver either
    found = held.join(named.hint("merge"), on).select("row", "times", "rows", *[f"k_{k}" for k in keys])
    once = found.where("rows = 1").select("row", "times")
    # repeated rows are combined before their shuffle
    several = found.where("rows > 1").groupBy(*[f"k_{k}" for k in keys]).agg(F.min_by("row", F.to_json("row")).alias("row"), F.max("times").alias("times"))
    each = once.unionByName(several.select("row", "times")).where("times > 0")
    return each.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long")))).select("row.*")
