"""The link graph: edges, orphans, broken links, degrees, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import links, page_slug

INDEX = "index"


def body_links(pages: DataFrame) -> DataFrame:
    """src and dst of links in the whole text of a page, front matter and code included."""
    return pages.select(F.col("slug").alias("src"), F.explode(links(F.col("content"))).alias("dst"))


def edges(pages: DataFrame) -> DataFrame:
    """src, dst, kind: body and related links; body wins, self links go.  ``related`` is an array column."""
    body = body_links(pages).withColumn("kind", F.lit("body"))
    related = pages.select(F.col("slug").alias("src"), F.explode("related").alias("dst")).withColumn("dst", page_slug(F.trim("dst"))).where("dst <> ''").withColumn("kind", F.lit("related"))
    return body.unionByName(related).where("src <> dst").groupBy("src", "dst").agg(F.min("kind").alias("kind"))


def orphans(pages: DataFrame, edge: DataFrame) -> DataFrame:
    """Pages (but the index) that no page but the index links."""
    linked = edge.where(F.col("src") != INDEX).select(F.col("dst").alias("slug"))
    return pages.select("slug").where(F.col("slug") != INDEX).join(linked, "slug", "left_anti")


def lint_orphans(pages: DataFrame, links_: DataFrame) -> DataFrame:
    """Pages without body links to them, those of the index and of themselves included."""
    return pages.select("slug").join(links_.select(F.col("dst").alias("slug")), "slug", "left_anti")


def broken(pages: DataFrame, edge: DataFrame) -> DataFrame:
    """Edges whose target is no page."""
    return edge.join(pages.select(F.col("slug").alias("dst")), "dst", "left_anti").select("src", "dst")


def degrees(pages: DataFrame, edge: DataFrame) -> DataFrame:
    """slug, in_degree, out_degree of all pages; edges to missing pages count.  One shuffle by page."""
    ends = edge.select(F.explode(F.array(F.struct(F.col("src").alias("slug"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("slug"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*", F.lit(0).alias("page"))
    own = pages.select("slug", F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(1).alias("page"))
    sums = ends.unionByName(own).groupBy("slug").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.max("page").alias("page"))
    return sums.where("page = 1").drop("page")


def hubs(pages: DataFrame, edge: DataFrame, k: int = 10) -> DataFrame:
    """The best connected pages."""
    return degrees(pages, edge).where("in_degree + out_degree > 0").orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "slug").limit(k)


def backlinks(edge: DataFrame, slug: str) -> DataFrame:
    return edge.where(F.col("dst") == slug).select("src", "kind").orderBy("src")


def related(edge: DataFrame, slug: str) -> DataFrame:
    """Neighbours of a page with the strongest relation; missing pages included."""
    near = edge.where((F.col("src") == slug) | (F.col("dst") == slug))
    outgoing = F.col("src") == slug
    sides = near.select(F.when(outgoing, F.col("dst")).otherwise(F.col("src")).alias("slug"), outgoing.cast("int").alias("o"), (~outgoing).cast("int").alias("i"), (F.col("kind") == "related").cast("int").alias("r"))
    sums = sides.groupBy("slug").agg(F.max("o").alias("o"), F.max("i").alias("i"), F.max("r").alias("r"))
    rank = F.when(F.expr("o = 1 and i = 1"), 0).when(F.expr("r = 1"), 1).when(F.expr("o = 1"), 2).otherwise(3)
    names = F.array(*map(F.lit, ("bidirectional", "declared", "links-to", "linked-from")))
    return sums.select("slug", rank.alias("rank")).withColumn("relation", F.get(names, F.col("rank"))).orderBy("rank", "slug")


def has_edge(edge: DataFrame, a: Column, b: Column) -> Column:
    return ((edge.src == a) & (edge.dst == b)) | ((edge.src == b) & (edge.dst == a))


def summary(pages: DataFrame, edge: DataFrame) -> DataFrame:
    """One row: nodes, edges, orphans and broken links."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [count(pages, "nodes"), count(edge, "edges"), count(orphans(pages, edge), "orphans"), count(broken(pages, edge), "broken_links")]
    rows = None
    for p in parts:  # four one-row frames
        one = p.select(F.lit(p.columns[0]).alias("metric"), F.col(p.columns[0]).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    return rows
