"""Vector retrieval: cosine, best chunk per page, top-k, and embedding providers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import slices


class Provider(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ByteHistogram:
    """A deterministic provider without a network: counts of byte mod dim, unit length."""

    def __init__(self, dim: int = 64) -> None:
        self.dim, self.model = dim, f"bytes-{dim}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.bincount(np.frombuffer(t.encode(), np.uint8) % self.dim, minlength=self.dim).astype(np.float64)
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out


class Transient(Exception):
    """An error that a later attempt may not meet."""


def embedder(provider: Provider, attempts: int = 3, backoff_s: float = 0.5):
    """An Arrow UDF that embeds a batch's slices, and tries again after transient errors."""

    def call(texts: list[str]) -> list[list[float]]:
        import time

        for i in range(attempts):
            try:
                return provider.embed(texts)
            except Transient:
                if i + 1 == attempts:
                    raise
                time.sleep(backoff_s * 2**i)
        return []

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for (texts,) in slices((batch,)):
                yield pa.array(call([x or "" for x in texts]), pa.list_(pa.float32()))

    return embed


def _literal(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 for different lengths, empty or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine to one query vector, whose own norm is a constant of the plan."""
    q = np.asarray(query, np.float64)
    size = float(np.sqrt((q * q).sum()))
    if not size:
        return F.lit(0.0)
    dot = F.aggregate(F.zip_with(vector, _literal(query), lambda p, r: p.cast("double") * r), F.lit(0.0), lambda s, v: s + v)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when((F.size(vector) == len(query)) & (own > 0), dot / (own * size)).otherwise(0.0)


def best_chunks(chunks: DataFrame, query: list[float], page: str = "slug", vector: str = "vector", index: str = "index") -> DataFrame:
    """page, score and best_index: the chunk of highest cosine, the first on ties."""
    scored = chunks.select(page, index, cosine_to(F.col(vector), query).alias("score"))
    return scored.groupBy(page).agg(F.max("score").alias("score"), F.max_by(F.col(index), F.struct("score", -F.col(index))).alias("best_index"))


def semantic_search(chunks: DataFrame, query: list[float], k: int, page: str = "slug", vector: str = "vector", index: str = "index") -> DataFrame:
    """The k best pages; ties by name."""
    return best_chunks(chunks, query, page, vector, index).orderBy(F.desc("score"), page).limit(k)


def stale_pages(pages: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Pages (but the index) without vectors, with another body, or of another model."""
    held = embeddings.select("slug", "body_hash", "model").distinct()
    joined = pages.where("slug <> 'index'").withColumn("hash", F.md5("body")).join(held, "slug", "left")
    return joined.where(F.col("body_hash").isNull() | (F.col("body_hash") != F.col("hash")) | (F.col("model") != model)).select("slug", "hash")
