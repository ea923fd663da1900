"""Page vectors in their binary exchange format; inside the engine, vectors live in Parquet.

A file holds: the magic ``ADVE``, version (one byte), dim (u32), model and body hash (u16
length and UTF-8 each), number of chunks (u32), and per chunk index, start and end (u32 each)
and dim 32-bit floats; all little-endian.  The page's name is the file's.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION = b"ADVE", 1
ROWS = "slug string, dim int, model string, body_hash string, index int, start int, end int, vector array<float>"


def encode(dim: int, model: str, body_hash: str, chunks: list[tuple[int, int, int, list[float]]]) -> bytes:
    text = lambda s: struct.pack("<H", len(b := s.encode())) + b
    head = MAGIC + struct.pack("<BI", VERSION, dim) + text(model) + text(body_hash) + struct.pack("<I", len(chunks))
    return head + b"".join(struct.pack("<III", i, a, b) + np.asarray(v[:dim], "<f4").tobytes() for i, a, b, v in chunks)


def decode(data: bytes) -> tuple[int, str, str, list[tuple[int, int, int, list[float]]]]:
    """dim, model, hash and chunks; ValueError for other data."""
    if data[:4] != MAGIC or data[4:5] != bytes([VERSION]):
        raise ValueError("no vector file of this version")
    try:
        (dim,), at, words = struct.unpack_from("<I", data, 5), 9, []
        for _ in range(2):
            (n,) = struct.unpack_from("<H", data, at)
            words.append(data[at + 2 : at + 2 + n].decode())
            at += 2 + n
        (count,), at = struct.unpack_from("<I", data, at), at + 4
        chunks = []
        for _ in range(count):
            head = struct.unpack_from("<III", data, at)
            chunks.append((*head, list(struct.unpack_from(f"<{dim}f", data, at + 12))))
            at += 12 + 4 * dim
    except (struct.error, UnicodeDecodeError) as e:
        raise ValueError("a vector file that is cut off") from e
    return dim, words[0], words[1], chunks


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per chunk of all ``*.bin`` files; files that can't be read are passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["slug"], batch["content"], strict=True):
                try:
                    dim, model, digest, chunks = decode(bytes(content))
                except ValueError:
                    continue
                rows += [(name, dim, model, digest, *c) for c in chunks]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)\.bin$", 1).alias("slug"), "content").mapInPandas(run, ROWS)


def encoded(rows: DataFrame) -> DataFrame:
    """slug and file content of each page's vectors."""

    @F.pandas_udf("binary")
    def pack(dim: pd.Series, model: pd.Series, digest: pd.Series, chunks: pd.Series) -> pd.Series:
        return pd.Series([encode(d, m, h, [(c["index"], c["start"], c["end"], list(c["vector"])) for c in cs]) for d, m, h, cs in zip(dim, model, digest, chunks, strict=True)])

    grouped = rows.groupBy("slug").agg(F.first("dim").alias("dim"), F.first("model").alias("model"), F.first("body_hash").alias("h"), F.sort_array(F.collect_list(F.struct("index", "start", "end", "vector"))).alias("chunks"))
    return grouped.select("slug", pack("dim", "model", "h", "chunks").alias("content"))
