"""Keyed writes, proposals with conflict detection, ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, keys: list[str], order: str, tie: str | None = None) -> DataFrame:
    """The last row of each key: an aggregate, so it combines before its shuffle."""
    by = F.struct(order, *([tie] if tie else []))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), by).alias("_r")).select(*keys, "_r.*")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with its rows replaced by, or extended with, the changes (one row per key)."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


def apply_changes(table: DataFrame, changes: DataFrame, keys: list[str], order: str, deleted: str) -> DataFrame:
    """Upserts and deletions of one batch: only the last change of a key counts."""
    last = latest(changes, keys, order)
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last.where(~F.col(deleted)).select(*table.columns))


def judge_proposals(proposals: DataFrame, pages: DataFrame, force: bool = False) -> DataFrame:
    """Adds ``outcome``: applied, conflict, or closed; a conflict is another base than the one proposed against."""
    now = pages.select("slug", F.md5("content").alias("_hash"))
    rows = proposals.join(now, "slug", "left")
    same = (F.col("base_page_exists") == F.col("_hash").isNotNull()) & F.col("base_hash").eqNullSafe(F.col("_hash"))
    outcome = F.when(F.col("status") != "pending", "closed").when(same | F.lit(force), "applied").otherwise("conflict")
    return rows.withColumn("outcome", outcome).drop("_hash")


def apply_proposals(proposals: DataFrame, pages: DataFrame, force: bool = False) -> DataFrame:
    """Pages with the content of all proposals that apply; the last one of a page wins."""
    applied = judge_proposals(proposals, pages, force).where("outcome = 'applied'")
    changes = latest(applied.select("slug", F.col("proposed_content").alias("content"), "created_at", "proposal_id"), ["slug"], "created_at", "proposal_id").select("slug", "content")
    return upsert(pages.select("slug", "content"), changes, ["slug"])


def ingest(incoming: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Raw sources (uri, content, type) as rows with ids; those that exist are refused unless forced."""
    mime = F.coalesce(F.col("mime"), F.create_map(*[F.lit(x) for p in (("markdown", "text/markdown"), ("md", "text/markdown"), ("html", "text/html"), ("json", "application/json")) for x in p])[F.col("type")], F.lit("text/plain"))
    rows = incoming.select(F.md5("uri").alias("source_id"), F.col("uri").alias("original_path"), mime.alias("mime_type"), F.octet_length("content").alias("size_bytes"), F.array("type").alias("tags"), "content")
    return rows if force else rows.join(existing.select("source_id"), "source_id", "left_anti")


def ingest_extracted(incoming: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Extracted texts (uri, content, type, title); the id is what follows raw://source/."""
    rows = incoming.where(F.col("uri").startswith("raw://source/"))
    mime = F.when(F.col("type") == "pdf", "application/pdf").when(F.col("type") == "markdown", "text/markdown").otherwise("text/plain")
    rows = rows.select(F.regexp_extract("uri", "^raw://source/(.*)$", 1).alias("source_id"), F.col("uri").alias("original_path"), mime.alias("mime_type"), F.octet_length("content").alias("size_bytes"), F.array("type", "title").alias("tags"), "content")
    return rows if force else rows.join(existing.select("source_id"), "source_id", "left_anti")


def raw_index(entries: DataFrame) -> DataFrame:
    """One row per source id, the last extracted."""
    return latest(entries, ["source_id"], "extracted_at")


def renumbered(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """A rank from 1 over groups in display order; for top-k lists."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*group, *order)))
