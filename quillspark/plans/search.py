"""The search plan: lexical, semantic or hybrid, and what to do when one side has nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import fusion, lexical, vectors
from ..operators.vectors import Provider
from . import parser

OVER_FETCH = 3


def lexical_search(docs: DataFrame, query: str, limit: int, kind: str | None = None) -> DataFrame:
    """Hits of a query text; blank texts list all documents with score 1."""
    tree = parser.parsed(query)
    matching = parser.predicate(tree) if tree.kind != "all" else None
    return lexical.search(docs, parser.terms(tree), limit, kind, matching=matching)


def hybrid(pages: DataFrame, lexical_hits: DataFrame, semantic_hits: DataFrame, k: int) -> DataFrame:
    """slug, score (cosine if there is one, else BM25), rrf and position of the k best pages.

    Inputs: top lists of slug and score.
    """
    fused = fusion.fused_top(fusion.rrf(fusion.ranked(lexical_hits, "slug"), fusion.ranked(semantic_hits, "slug"), "slug"), k)
    order = Window.orderBy(F.desc("rrf"), F.asc_nulls_last("sem_rank"), F.asc_nulls_last("lex_rank"))
    return fused.select("slug", F.coalesce("sem_score", "lex_score").alias("score"), "rrf", F.row_number().over(order).alias("position"))


def with_raws(top_pages: DataFrame, raw_hits: DataFrame, k: int) -> DataFrame:
    """Raw sources (slug, score) behind the pages, by their lexical rank, with positions that go on."""
    count = top_pages.agg(F.count("*").alias("_n"))  # one row
    order = Window.orderBy(F.desc("score"), "slug")
    raws = raw_hits.orderBy(F.desc("score"), "slug").limit(k).withColumn("_p", F.row_number().over(order)).join(F.broadcast(count))
    raws = raws.select("slug", "score", F.lit(None).cast("double").alias("rrf"), (F.col("_p") + F.col("_n")).cast("int").alias("position"), F.lit("raw").alias("kind"))
    return top_pages.withColumn("kind", F.lit("page")).unionByName(raws)


def query_wiki(docs: DataFrame, chunks: DataFrame | None, query: str, provider: Provider | None = None, mode: str = "auto", k: int = 10, raws: bool = False) -> DataFrame:
    """slug, score, rrf, position, kind.

    ``bm25``, or no vectors or provider: one lexical ranking (of both kinds with ``raws``).
    Else hybrid; without a query vector, or in ``semantic`` mode without hits, lexical again.
    """
    def classic() -> DataFrame:
        found = lexical_search(docs, query, k, None if raws else "page")
        order = Window.orderBy(F.desc("score"), "uri")
        return found.select(_slug(F.col("uri")).alias("slug"), "score", F.lit(None).cast("double").alias("rrf"), F.row_number().over(order).alias("position"), "kind")

    if mode == "bm25" or chunks is None or provider is None:
        return classic()
    try:
        vector = (provider.embed([query]) or [[]])[0]
    except Exception:  # noqa: BLE001  any provider error falls back to words
        vector = []
    if not vector:
        return classic()
    fetch = OVER_FETCH * k
    semantic = vectors.semantic_search(chunks, vector, fetch)
    if mode == "semantic":
        order = Window.orderBy(F.desc("score"), "slug")
        found = semantic.limit(k).select("slug", "score", F.lit(None).cast("double").alias("rrf"), F.row_number().over(order).alias("position"), F.lit("page").alias("kind"))
        return found if found.take(1) else classic()
    words = lexical_search(docs, query, fetch, "page").select(_slug(F.col("uri")).alias("slug"), "score")
    top = hybrid(docs, words, semantic, k)
    if not raws:
        return top.withColumn("kind", F.lit("page"))
    return with_raws(top, lexical_search(docs, query, k, "raw").select(_slug(F.col("uri")).alias("slug"), "score"), k)


def _slug(uri: Column) -> Column:
    return F.regexp_replace(uri, "^(wiki://page/|raw://source/)", "")
