"""Writes as tables: page edits with dates and log entries, proposals made from edits, metadata edits, best-chunk snippets."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import claims, frontmatter, row_function, sections, struct_of
from ..functions.chunking import piece
from ..functions.text import proposal_id, valid_slug

RESULT = struct_of(content=T.StringType(), error=T.StringType())


def pairs_of(text: str | None) -> dict[str, str]:
    """The name and value pairs of a JSON object: numbers and truth values as text, others refused; null or blank gives none."""
    found = json.loads(text) if text and text.strip() else {}
    if not isinstance(found, dict):
        raise ValueError("arguments are a JSON object")
    out = {}
    for k, v in found.items():
        if not isinstance(v, str | int | float | bool):
            raise ValueError(f"{k} has no plain value")
        out[k] = v if isinstance(v, str) else json.dumps(v)
    return out


def _edit(old: str | None, mode: str, section: str | None, new: str, today: str) -> str:
    if mode not in ("overwrite", "append"):
        raise ValueError(f"no mode {mode!r}: overwrite or append")
    if section is not None:
        if old is None:
            raise ValueError(f"no page, so no section {section!r}")
        return frontmatter.with_dates(sections.edit(old, section, new, mode == "append"), today, False)
    text = f"{old}\n\n{new}" if mode == "append" and old is not None else new
    return frontmatter.with_dates(text, today, old is None)


def _tried(f: Callable[..., str], *args) -> dict[str, str | None]:
    """``RESULT`` of a call."""
    try:
        return {"content": f(*args), "error": None}
    except ValueError as e:
        return {"content": None, "error": str(e)}


@row_function(RESULT, 5)
def edited(old: str | None, mode: str, section: str | None, new: str | None, today: str) -> dict:
    """The page after an edit, or why there is none."""
    return _tried(_edit, old, mode, section, new or "", today)


def update_pages(pages: DataFrame, edits: DataFrame, today: str) -> DataFrame:
    """slug, content, error, is_new and log_entry (null without a rationale) of edits (slug, mode, section, content, rationale), one a page."""
    joined = edits.withColumnRenamed("content", "_new").join(pages.select("slug", F.col("content").alias("_old")), "slug", "left")
    done = joined.withColumn("_e", edited("_old", "mode", "section", "_new", F.lit(today)))
    bad = F.when(~valid_slug(F.col("slug")), "not a page name")
    scope = F.coalesce(F.concat(F.lit(" section '"), "section", F.lit("'")), F.lit(""))
    entry = F.concat(F.lit("["), "mode", scope, F.lit("] `"), "slug", F.lit("`: "), "rationale")
    error = F.coalesce(bad, F.col("_e.error"))
    return done.select("slug", F.when(error.isNull(), F.col("_e.content")).alias("content"), error.alias("error"), F.col("_old").isNull().alias("is_new"), F.when(error.isNull(), entry).alias("log_entry"))


def propose(pages: DataFrame, edits: DataFrame, today: str, at: Column) -> DataFrame:
    """Proposals from edits: id, base hash, content that the edit would give; the pages stay."""
    done = update_pages(pages, edits, today).where("error is null").join(pages.select("slug", F.md5("content").alias("base_hash")), "slug", "left")
    reasons = edits.select("slug", F.col("rationale").alias("reason"))
    rows = done.join(reasons, "slug", "left")
    return rows.select(proposal_id(F.col("slug"), at).alias("proposal_id"), "slug", "reason", at.cast("string").alias("created_at"), F.col("base_hash").isNotNull().alias("base_page_exists"), "base_hash", F.col("content").alias("proposed_content"), F.lit("pending").alias("status"))


@row_function(RESULT, 3)
def verified(content: str, index: int, date: str) -> dict:
    """The page with the date of one claim (from 0) set, or why there is none."""
    return _tried(claims.set_last_verified, content, int(index), date)


def _with_metadata(content: str | None, set_fields: str | None, add: str | None, remove: str | None) -> str:
    lists = lambda x: {k: v if isinstance(v, list) else [v] for k, v in (json.loads(x) if x else {}).items()}
    return frontmatter.apply_metadata(content or "", pairs_of(set_fields), lists(add), lists(remove))


@row_function(RESULT, 4)
def with_metadata(content: str | None, set_fields: str | None, add: str | None, remove: str | None) -> dict:
    """The page with its front matter edited: JSON objects of scalars to set, and of lists to add to and remove from."""
    return _tried(_with_metadata, content, set_fields, add, remove)


def best_snippets(best: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """slug, score and the text of the best chunk.

    ``best`` (slug, score, best_index) is a top list, so its rows go to the pages and not the texts to them.
    """
    named = F.broadcast(best.join(spans.select("slug", F.col("index").alias("best_index"), "start", "end"), ["slug", "best_index"]))
    return pages.join(named, "slug").select("slug", "score", piece(F.col("content"), F.col("start"), F.col("end")).alias("snippet"))
