"""Full-text retrieval: postings, BM25 over several fields, phrases, and top-k.

Corpus figures (number of documents, mean field lengths) are one aggregate over all kinds of
documents; a filter on kind applies before the limit, so k hits of that kind come back.
Only the query's terms are broadcast: a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_terms, snippet

K1, B = 1.2, 0.75
FIELDS = ("title", "content")


def postings(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "uri") -> DataFrame:
    """field, term, key, tf: the inverted index."""
    rows = None
    for f in fields:
        part = docs.select(F.col(key), F.lit(f).alias("field"), F.explode(search_terms(F.col(f))).alias("term"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("field", "term", key).agg(F.count("*").alias("tf"))


def field_lengths(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "uri") -> DataFrame:
    """field, key, dl: terms of each field; no shuffle."""
    entries = [F.struct(F.lit(f).alias("field"), F.size(search_terms(F.col(f))).cast("long").alias("dl")) for f in fields]
    return docs.select(key, F.explode(F.array(*entries)).alias("x")).select("x.field", key, "x.dl")


def term_stats(docs: DataFrame, field: str = "content", key: str = "uri") -> DataFrame:
    """term, df and total frequency.

    A document counts its terms where they are split, so counts are combined by term before their only
    shuffle; documents of one key have to meet first, where there are such.
    """
    if not docs.groupBy(key).count().where("count > 1").isEmpty():
        return postings(docs, (field,), key).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    own = docs.select(F.array_sort(search_terms(F.col(field))).alias("terms")).select("terms", F.posexplode("terms").alias("at", "term"))
    first = F.when((F.col("at") == 0) | (F.get("terms", F.col("at") - 1) != F.col("term")), 1)
    return own.select("term", first.alias("first")).groupBy("term").agg(F.count("first").alias("df"), F.count("*").alias("cf"))


def _counted(text: Column, terms: list[str]) -> Column:
    """dl and the frequency of each term of a text that is split once."""
    hits = lambda own: F.struct(F.size(own).cast("double").alias("dl"), F.filter(own, lambda w: w.isin(terms)).alias("hits"))
    count = lambda x: F.struct(x.dl.alias("dl"), F.transform(F.array(*map(F.lit, terms)), lambda t: F.size(F.filter(x.hits, lambda w: w == t)).cast("double")).alias("tf"))
    return F.transform(F.transform(F.array(search_terms(text)), hits), count)[0]


def bm25(docs: DataFrame, terms: list[str], fields: tuple[str, ...] = FIELDS, key: str = "uri", keep: dict[str, Column] | None = None) -> DataFrame:
    """key, score and the ``keep`` expressions of documents that hold any of the terms.

    Two passes over the texts and no inverted index: term counts are taken per document
    where its terms are split, so texts never move; the figures of the query's terms are a
    one-row aggregate.
    """
    keep = keep or {}
    terms = list(dict.fromkeys(terms))
    if not terms:
        return docs.select(key, F.lit(1.0).alias("score"), *[c.alias(n) for n, c in keep.items()])
    split = docs.select(key, *[c.alias(n) for n, c in keep.items()], *[_counted(F.col(f), terms).alias(f"_{f}") for f in fields])
    figures = split.agg(
        F.count("*").cast("double").alias("_n"),
        *[F.avg(f"_{f}.dl").alias(f"_avg_{f}") for f in fields],
        *[F.sum(F.when(F.get(F.col(f"_{f}.tf"), F.lit(i)) > 0, 1.0).otherwise(0.0)).alias(f"_df_{f}_{i}") for f in fields for i in range(len(terms))],
    )
    rows = split.where(" or ".join(f"exists(_{f}.tf, x -> x > 0)" for f in fields)).join(F.broadcast(figures))  # one row
    score = F.lit(0.0)
    for f in fields:
        norm = K1 * (1 - B + B * F.col(f"_{f}.dl") / F.col(f"_avg_{f}"))
        for i in range(len(terms)):
            df, tf = F.col(f"_df_{f}_{i}"), F.get(F.col(f"_{f}.tf"), F.lit(i))
            idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
            score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)
    return rows.select(key, score.alias("score"), *keep)


def phrase_match(text: Column, phrase: list[str]) -> Column:
    """Whether the terms stand in this order, next to each other."""
    joined = F.concat(F.lit(" "), F.array_join(search_terms(text), " "), F.lit(" "))
    return F.contains(joined, F.lit(f" {' '.join(phrase)} "))


def has_term(text: Column, term: str) -> Column:
    return F.array_contains(search_terms(text), term)


def search(docs: DataFrame, terms: list[str], limit: int, kind: str | None = None, fields: tuple[str, ...] = FIELDS, matching: Column | None = None) -> DataFrame:
    """uri, title, kind, score and snippet of the best hits; ties by uri.  No terms: all documents, score 1.

    ``matching`` leaves out hits.  Titles and snippets are taken where a document is scored,
    so no join fetches them and no text is shuffled.
    """
    keep = {"kind": F.col("kind"), "title": F.col("title"), "snippet": snippet(F.col("content"))}
    if matching is not None:
        keep["_matching"] = matching
    found = bm25(docs, terms, fields, keep=keep)
    if matching is not None:
        found = found.where("_matching")
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    return found.select("uri", "kind", "title", "score", "snippet").orderBy(F.desc("score"), "uri").limit(limit)
