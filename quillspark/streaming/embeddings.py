"""Upkeep of page vectors by a stream of page changes: gate, chunk, embed, keep, drop.

A folder holds what the batches have written, each under its own number: ``vectors`` (a row a
chunk), ``failed`` (pages whose embedding met an error, with their body) and, written last, ``pages``
(a row a page that got vectors or went).  The last row of a page counts, so a batch replaces or
drops nothing that older batches wrote, and a batch that runs again writes the same rows over
its own.  A page is embedded if it has no vectors, other ones (by the body's MD5 or the model),
or failed before by a transient error; pages that failed for good wait for another body.  A
failed page keeps its old vectors.

Defined cases: front matter doesn't count, a page without body holds no chunk and is still
kept; null slugs and the page ``index`` are passed over; of several changes of a page in a batch
the last (by ``order``) counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, frontmatter, slices
from ..operators.mutation import latest
from ..operators.vectors import Provider, Transient
from ..session import batch_bytes

PAGES = "slug string, body_hash string, model string, held boolean, chunks long, batch long"
VECTORS = "slug string, dim int, model string, body_hash string, index int, start int, end int, vector array<float>, batch long"
FAILED = "slug string, body string, body_hash string, error string, transient boolean, batch long"


def page_chunks(content: Column) -> Column:
    """Chunks of a page: byte spans of its body, as it stands without front matter."""
    return chunking.chunked(frontmatter.body(content))


def checked_embedder(provider: Provider, attempts: int = 3, backoff_s: float = 0.5) -> Callable[[Column], Column]:
    """An Arrow UDF: vector, error and transient of each text.  A slice that fails is asked row by row, so one bad text fails alone."""

    def asked(texts: list[str]) -> list[list[float]]:
        import time

        for i in range(attempts):
            try:
                return provider.embed(texts)
            except Transient:
                if i + 1 == attempts:
                    raise
                time.sleep(backoff_s * 2**i)
        raise AssertionError("no attempt")

    kind = pa.struct([("vector", pa.list_(pa.float32())), ("error", pa.string()), ("transient", pa.bool_())])

    @F.arrow_udf("vector array<float>, error string, transient boolean")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in (v for batch in batches for (v,) in slices((batch,))):
            texts, rows = [x or "" for x in values], []
            try:
                rows = [(v, None, None) for v in asked(texts)]
            except Exception:  # noqa: BLE001  the error is kept with its row below
                for t in texts:
                    try:
                        rows.append((asked([t])[0], None, None))
                    except Exception as e:  # noqa: BLE001
                        rows.append((None, f"{type(e).__name__}: {e}", isinstance(e, Transient)))
            yield pa.array([dict(zip(("vector", "error", "transient"), r, strict=True)) for r in rows], kind)

    return embed


class Upkeep:
    """Keeps the vectors of a folder; ``apply`` is a foreachBatch function."""

    def __init__(self, root: str, provider: Provider, **retries: float) -> None:
        self.root, self.provider, self.retries = root.rstrip("/"), provider, retries

    def _read(self, spark: SparkSession, name: str, schema: str, before: int | None = None) -> DataFrame:
        try:
            found = spark.read.schema(schema).parquet(f"{self.root}/{name}")
            return found if before is None else found.where(F.col("batch") < before)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def pages(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The last row of each page."""
        return latest(self._read(spark, "pages", PAGES, before), ["slug"], "batch")

    def vectors(self, spark: SparkSession) -> DataFrame:
        """The vectors that count now."""
        held = self.pages(spark).where("held").select("slug", "batch")
        return self._read(spark, "vectors", VECTORS).join(held, ["slug", "batch"], "left_semi").drop("batch")

    def failed(self, spark: SparkSession, before: int | None = None, bodies: bool = True) -> DataFrame:
        """Pages whose last attempt met an error, with or without their bodies."""
        rows = self._read(spark, "failed", FAILED, before)
        last = latest(rows if bodies else rows.drop("body"), ["slug"], "batch")
        done = self.pages(spark, before).select("slug", F.col("batch").alias("done"))
        return last.join(done, "slug", "left").where("done is null or done < batch").drop("done")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Changes (slug, content, order, deleted) of one batch."""
        spark, model = batch.sparkSession, self.provider.model

        def put(df: DataFrame, name: str) -> DataFrame:
            """The rows written under the batch's number and read back: joins go by their real size."""
            path = f"{self.root}/{name}/batch={batch_id}"
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        body = frontmatter.body(F.coalesce("content", F.lit("")))
        turn = lambda new, order: F.struct(F.lit(new).alias("new"), order.alias("order")).alias("turn")
        rows = batch.where("slug is not null and slug <> 'index'").select("slug", body.alias("body"), F.coalesce("deleted", F.lit(False)).alias("deleted"), turn(1, F.col("order")))
        # a page that may fare better now stands before all changes of the batch
        again = self.failed(spark, batch_id).where("transient").select("slug", "body", F.lit(False).alias("deleted"), turn(0, F.lit(None).cast(batch.schema["order"].dataType)))
        now = latest(rows.unionByName(again), ["slug"], "turn").select("slug", "body", "deleted", F.md5("body").alias("body_hash"))
        held = self.pages(spark, batch_id).where("held").select("slug", F.col("body_hash").alias("old"), F.col("model").alias("old_model"))
        broken = self.failed(spark, batch_id, bodies=False).where("not transient").select("slug", F.col("body_hash").alias("bad"))
        gate = now.join(held, "slug", "left").join(broken, "slug", "left")
        stale = F.col("old").isNull() | (F.col("old") != F.col("body_hash")) | (F.col("old_model") != model)
        gate = gate.where(F.col("deleted") | stale & ~F.col("bad").eqNullSafe(F.col("body_hash")))
        now = put(gate.select("slug", F.when(~F.col("deleted"), F.col("body")).alias("body"), "body_hash", "deleted"), "changes")
        wanted = now.where("not deleted").select("slug", "body", "body_hash")
        spans = wanted.select("slug", "body_hash", "body", F.explode(chunking.chunked("body")).alias("c")).select("slug", "body_hash", "c.*", chunking.piece(F.col("body"), F.col("c.start"), F.col("c.end")).alias("piece"))
        embed = checked_embedder(self.provider, **self.retries)
        with batch_bytes(spark):  # a task's two workers, chunks and vectors, run at once
            tried = put(spans.select("slug", "body_hash", "index", "start", "end", embed("piece").alias("e")).select("slug", "body_hash", "index", "start", "end", "e.*"), "tried")
        # an error that may pass makes the page's failure one that may pass
        bad = put(tried.where("error is not null").groupBy("slug").agg(F.min("error").alias("error"), F.bool_or("transient").alias("transient")), "bad")
        good = tried.join(bad, "slug", "left_anti")
        put(good.select("slug", F.size("vector").alias("dim"), F.lit(model).alias("model"), "body_hash", "index", "start", "end", "vector"), "vectors")
        put(wanted.join(bad, "slug").select("slug", "body", "body_hash", "error", "transient"), "failed")
        counts = good.groupBy("slug").agg(F.count("*").alias("chunks"))
        kept = wanted.join(bad, "slug", "left_anti").join(counts, "slug", "left").select("slug", "body_hash", F.lit(model).alias("model"), F.lit(True).alias("held"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
        gone = now.where("deleted").select("slug", F.lit(None).cast("string").alias("body_hash"), F.lit(None).cast("string").alias("model"), F.lit(False).alias("held"), F.lit(0).cast("long").alias("chunks"))
        put(kept.unionByName(gone), "pages")  # last: now the batch counts


def coverage(pages: DataFrame, kept: DataFrame, model: str) -> DataFrame:
    """slug and status of every page but the index: ``current``, ``stale`` (another body or model) or ``missing``.

    pages: slug, content; kept: ``Upkeep.pages``.
    """
    held = kept.where("held").select("slug", F.col("body_hash").alias("old"), F.col("model").alias("old_model"))
    now = pages.where("slug <> 'index'").select("slug", F.md5(frontmatter.body(F.col("content"))).alias("now")).join(held, "slug", "left")
    fresh = (F.col("old") == F.col("now")) & (F.col("old_model") == model)
    return now.select("slug", F.when(F.col("old").isNull(), "missing").when(fresh, "current").otherwise("stale").alias("status"))
