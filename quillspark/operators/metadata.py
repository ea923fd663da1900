"""Metadata filters, catalogues, and claims as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter as fm

CLAIMS_HEADING = r"(?i)^\s*## (claims|afirmações|afirmacoes)\s*$"


def with_fields(pages: DataFrame) -> DataFrame:
    """Pages with their typed front matter in columns; lists are empty where there is none."""
    rows = pages.withColumn("_front", fm.block(F.col("content")))
    rows = rows.withColumns({s: fm.scalar(F.col("_front"), s) for s in fm.SCALARS})
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({x: F.when(F.col("_front").isNull(), empty).otherwise(fm.list_field(F.col("_front"), x)) for x in fm.LISTS})
    return rows.withColumn("has_front", F.col("_front").isNotNull()).drop("_front")


def matching(pages: DataFrame, predicate: Column) -> DataFrame:
    """slug of pages with front matter that fit, in order."""
    return _fitting(pages, F.col("has_front") & predicate).orderBy("slug")


def _fitting(pages: DataFrame, condition: Column) -> DataFrame:
    """slug of pages that fit: as a filter, the condition would hold the page's text and front matter anew for each use of a field."""
    return pages.select("slug", condition.alias("fits")).select(F.explode(F.when(F.col("fits"), F.array("slug"))).alias("slug"))


def by_scalar(pages: DataFrame, name: str, value: str) -> DataFrame:
    return matching(pages, F.lower(F.col(name)) == value.lower())


def by_tag(pages: DataFrame, tag: str) -> DataFrame:
    return matching(pages, F.exists("tags", lambda t: F.lower(t) == tag.lower()))


def without_sources(pages: DataFrame) -> DataFrame:
    return _fitting(pages, ~F.col("has_front") | (F.size("sources") == 0)).orderBy("slug")


def catalogue(pages: DataFrame) -> DataFrame:
    """Groups by type ('(untyped)' for none) and by project in one pass: grouping, name, pages, slugs."""
    rows = pages.where("slug <> 'index'").select("slug", F.coalesce("type", F.lit("(untyped)")).alias("type"), "project")
    groups = F.array(F.struct(F.lit("type").alias("grouping"), F.col("type").alias("name")), F.struct(F.lit("project").alias("grouping"), F.col("project").alias("name")))
    long = rows.select("slug", F.explode(groups).alias("g")).select("slug", "g.*").where("name is not null")
    return long.groupBy("grouping", "name").agg(F.count("*").alias("pages"), F.min("slug").alias("first_slug"), F.max("slug").alias("last_slug"))


def claim_rows(pages: DataFrame) -> DataFrame:
    """slug, idx (from 1), text, source, confidence, last_verified: SQL only, line by line.

    Lines after the heading and before the next one are cut into claims at the bullets of
    column 0; fields are the last indented bullet with a known label.
    """
    lines = F.split("content", "\n")
    rows = pages.select("slug", lines.alias("lines")).withColumn("head", F.expr(r"array_position(transform(lines, x -> x rlike '(?i)^\\s*## (claims|afirmações|afirmacoes)\\s*$'), true)")).where("head > 0")
    rows = rows.withColumn("rest", F.slice("lines", F.col("head") + 1, F.size("lines")))
    rows = rows.withColumn("stop", F.array_position(F.transform("rest", lambda x: x.startswith("#")), F.lit(True)))
    part = F.when(F.col("stop") > 0, F.slice("rest", F.lit(1), F.col("stop") - 1)).otherwise(F.col("rest"))
    rows = rows.select("slug", F.concat(F.lit("\n"), F.array_join(part, "\n")).alias("part"))
    rows = rows.select("slug", F.posexplode(F.slice(F.split("part", "\n- "), 2, 1 << 30)).alias("idx", "block"))
    field = lambda names: F.nullif(F.trim(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all("block", F.lit(rf"(?im)^[ \t]+- (?:{names})[ \t]*:(.*)$"), F.lit(1))), -1)), F.lit(""))
    return rows.select(
        "slug", (F.col("idx") + 1).alias("idx"), F.trim(F.regexp_replace(F.get(F.split("block", "\n"), F.lit(0)), "\r$", "")).alias("text"),
        field("source|fonte").alias("source"), field("confidence|confiança|confianca").alias("confidence"), field("last verified|última verificação|ultima verificacao").alias("last_verified"),
    )
