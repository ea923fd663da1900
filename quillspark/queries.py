"""The registered queries of the engine: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import chunking, claims, diffing, frontmatter, rewrite, sections, text
from .operators import fusion, graph, lexical, lint, metadata, mutation, similarity, updates, vectors
from .operators.index import Index
from .plans import parser, search
from .session import scratch
from .sources.tables import index_documents, table, wiki
from .streaming import embeddings as upkeep
from .streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TERMS = ["with", "from"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.with_fields(wiki(spark, sf_dir).select("doc_id", "slug", "content"))


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = _pages(spark, sf_dir)
    return pages, graph.edges(pages)


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of smallest id: one row."""
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).first()["embedding"])


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks; the label stands for the page."""
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc-"), F.col("label").cast("string")).alias("slug"), F.col("vec_id").alias("index"), F.col("embedding").alias("vector"))


# --- lexical retrieval ----------------------------------------------------------------------


def _hits(found: DataFrame) -> DataFrame:
    return found.select("uri", "kind", F.round("score", 6).alias("score"))


@query
def bm25_topk(spark, sf_dir):
    docs = index_documents(spark, sf_dir)
    return _hits(lexical.search(docs, TERMS, 20, fields=("content",)))


@query
def bm25_kind_filter(spark, sf_dir):
    return _hits(lexical.search(index_documents(spark, sf_dir), TERMS, 20, kind="raw", fields=("content",)))


@query
def bm25_two_field(spark, sf_dir):
    return _hits(lexical.search(index_documents(spark, sf_dir), TERMS, 20))


@query
def match_all(spark, sf_dir):
    return _hits(search.lexical_search(index_documents(spark, sf_dir), "  ", 20))


@query
def phrase_match(spark, sf_dir):
    docs = index_documents(spark, sf_dir)
    return docs.where(parser.predicate(parser.parsed('"of the"'))).select("uri")


@query
def boolean_must_not(spark, sf_dir):
    docs = index_documents(spark, sf_dir)
    return docs.where(parser.predicate(parser.parsed("+the -content:from"))).select("uri")


@query
def query_fallback(spark, sf_dir):
    """An unbalanced quote is no syntax for the parser; signs become plain characters."""
    return _hits(search.lexical_search(index_documents(spark, sf_dir), 'from "with', 20))


@query
def term_stats(spark, sf_dir):
    return lexical.term_stats(index_documents(spark, sf_dir))


@query
def field_lengths(spark, sf_dir):
    return lexical.field_lengths(index_documents(spark, sf_dir))


@query
def snippets(spark, sf_dir):
    return index_documents(spark, sf_dir).select("uri", text.snippet(F.col("content")).alias("snippet"))


# --- the stored index -----------------------------------------------------------------------

_INDEXES: dict[tuple[str, str], Index] = {}


def _index(spark: SparkSession, sf_dir: str) -> Index:
    """An index of all documents, written once for each session and folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        made = Index(spark, scratch(spark))
        made.upsert(index_documents(spark, sf_dir))
        _INDEXES[key] = made
    return _INDEXES[key]


def _changed_index(spark: SparkSession, sf_dir: str) -> Index:
    """Every tenth document replaced by a longer one, and another tenth deleted."""
    docs = index_documents(spark, sf_dir)
    made = Index(spark, scratch(spark))
    made.upsert(docs)
    made.upsert(docs.where("last_modified % 10 = 3").withColumn("content", F.concat("content", F.lit(" with from with"))))
    made.delete(docs.where("last_modified % 10 = 4").select("uri"))
    return made


@query
def index_search(spark, sf_dir):
    return _hits(_index(spark, sf_dir).top_k(TERMS, 20))


@query
def index_kind(spark, sf_dir):
    return _hits(_index(spark, sf_dir).search("with from", 20, "raw"))


@query
def index_upserted(spark, sf_dir):
    return _hits(_changed_index(spark, sf_dir).search("with from", 20))


@query
def index_compacted(spark, sf_dir):
    changed = _changed_index(spark, sf_dir)
    changed.compact()
    return _hits(changed.search("with from", 20))


@query
def index_phrase(spark, sf_dir):
    return _index(spark, sf_dir).matching('"of the"')


@query
def index_boolean(spark, sf_dir):
    return _index(spark, sf_dir).matching("+the -content:from")


@query
def index_terms(spark, sf_dir):
    return _index(spark, sf_dir).term_frequencies()


# --- vectors and fusion ---------------------------------------------------------------------


@query
def cosine_topk(spark, sf_dir):
    q = _query_vector(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.cosine_to(F.col("embedding"), q), 5).alias("score"))
    return rows.orderBy(F.desc("score"), "vec_id").limit(20)


@query
def maxpool_by_label(spark, sf_dir):
    found = vectors.semantic_search(_chunks(spark, sf_dir), _query_vector(spark, sf_dir), 10)
    return found.select("slug", F.round("score", 5).alias("score"), "best_index")


@query
def rrf_fusion(spark, sf_dir):
    docs = index_documents(spark, sf_dir)
    words = lexical.search(docs, TERMS, 30, kind="page").select(F.regexp_replace("uri", "^wiki://page/", "").alias("slug"), "score")
    fused = fusion.rrf(fusion.ranked(words.withColumn("score", F.round("score", 9)), "slug"), fusion.ranked(vectors.semantic_search(_chunks(spark, sf_dir), _query_vector(spark, sf_dir), 30), "slug"), "slug")
    return fusion.fused_top(fused, 10).select("slug", F.round("rrf", 9).alias("rrf"))


@query
def semantic_mode(spark, sf_dir):
    found = vectors.semantic_search(_chunks(spark, sf_dir), _query_vector(spark, sf_dir), 10)
    ranked = found.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "slug")))
    return ranked.select("position", "slug", F.round("score", 5).alias("score"))


@query
def hybrid_with_raws(spark, sf_dir):
    docs = index_documents(spark, sf_dir)
    slug = F.regexp_replace("uri", "^(wiki://page/|raw://source/)", "").alias("slug")
    rounded = lambda df: df.select(slug, F.round("score", 9).alias("score"))
    semantic = vectors.semantic_search(_chunks(spark, sf_dir), _query_vector(spark, sf_dir), 30)
    top = search.hybrid(docs, rounded(lexical.search(docs, TERMS, 30, kind="page")), semantic, 10)
    out = search.with_raws(top, rounded(lexical.search(docs, TERMS, 10, kind="raw")), 10)
    return out.select("position", "kind", "slug", F.round("score", 5).alias("score"))


@query
def content_hash_gate(spark, sf_dir):
    """Pages whose stored hash (of an older body for every fifth) or model is out of date."""
    pages = wiki(spark, sf_dir).select("doc_id", "slug", frontmatter.body(F.col("content")).alias("body"))
    held = pages.where("doc_id % 4 <> 0").select("slug", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("body", F.lit("x"))).otherwise(F.col("body"))).alias("body_hash"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise("m").alias("model"))
    return vectors.stale_pages(pages, held, "m").select("slug", "hash")


@query
def byte_embeddings(spark, sf_dir):
    """The vector's dimensions above 0."""
    embed = vectors.embedder(vectors.ByteHistogram(16))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(embed("text")).alias("dim", "value"))
    return rows.where("value > 0").select("conv_id", "turn", "dim", F.round(F.col("value").cast("double"), 4).alias("value"))


# --- tokens and similarity ------------------------------------------------------------------


@query
def token_sets(spark, sf_dir):
    rows = similarity.token_sets(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.size("tokens").cast("long").alias("tokens"), F.array_min("tokens").alias("first"), F.array_max("tokens").alias("last"))


@query
def distinct_tokens(spark, sf_dir):
    rows = similarity.token_sets(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.explode("tokens").alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("docs"))


@query
def near_duplicates(spark, sf_dir):
    sets = similarity.token_sets(table(spark, sf_dir, "documents"), "doc_id", "text")
    pairs = similarity.jaccard_pairs(sets, "doc_id", lint.SIMILAR, lint.MIN_TOKENS)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query
def conflicting_claims(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("slug"), F.col("turn").alias("idx"), "text")
    return similarity.conflicting_claims(rows)


@query
def link_suggestions(spark, sf_dir):
    pages = metadata.with_fields(wiki(spark, sf_dir).select("slug", F.concat(F.col("content"), F.lit("")).alias("content")))
    edge = graph.edges(pages)
    return similarity.link_suggestions(pages, edge, limit=20).select("a", "b", "score")


# --- links and graph ------------------------------------------------------------------------


@query
def links_legacy(spark, sf_dir):
    return wiki(spark, sf_dir).select("slug", F.array_join(text.legacy_links(F.col("content")), ",").alias("links"))


@query
def links_wiki(spark, sf_dir):
    return wiki(spark, sf_dir).select("slug", F.array_join(text.wiki_links(F.col("content")), ",").alias("links"))


@query
def edges(spark, sf_dir):
    return _edges(spark, sf_dir)[1]


@query
def edge_kinds(spark, sf_dir):
    return _edges(spark, sf_dir)[1].groupBy("kind").agg(F.count("*").alias("edges"))


@query
def graph_summary(spark, sf_dir):
    return graph.summary(*_edges(spark, sf_dir))


@query
def backlinks(spark, sf_dir):
    return graph.backlinks(_edges(spark, sf_dir)[1], "doc-21")


@query
def orphans_graph(spark, sf_dir):
    return graph.orphans(*_edges(spark, sf_dir))


@query
def orphans_lint(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return graph.lint_orphans(pages, graph.body_links(pages))


@query
def broken_links_graph(spark, sf_dir):
    return graph.broken(*_edges(spark, sf_dir))


@query
def broken_links_lint(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return graph.broken(pages, graph.body_links(pages))


@query
def degrees(spark, sf_dir):
    return graph.degrees(*_edges(spark, sf_dir))


@query
def hubs(spark, sf_dir):
    return graph.hubs(*_edges(spark, sf_dir))


@query
def related_pages(spark, sf_dir):
    return graph.related(_edges(spark, sf_dir)[1], "doc-21").select("rank", "relation", "slug")


@query
def href_graph(spark, sf_dir):
    """Links of the web pages: host, and host with path that it links; a link without host stays on its own."""
    host = lambda c: F.lower(F.regexp_extract(c, "://([^/?#]+)", 1))
    rows = table(spark, sf_dir, "pages").select(host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="((?:https?:/)?/[^"?#]*)'), F.lit(1))).alias("h"))
    dst = F.when(F.col("h").startswith("/"), F.concat("src", "h")).otherwise(F.regexp_extract("h", "://(.*)$", 1))
    return rows.select("src", dst.alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("links"))


# --- metadata and catalogue -----------------------------------------------------------------


@query
def front_matter_fields(spark, sf_dir):
    return _pages(spark, sf_dir).select("slug", "has_front", "type", "project", "status", F.array_join("tags", ",").alias("tags"), F.array_join("sources", ",").alias("sources"), F.array_join("related", ",").alias("related"))


@query
def front_matter_yaml(spark, sf_dir):
    """The whole YAML reader gives the same fields."""
    rows = wiki(spark, sf_dir).select("slug", frontmatter.parsed("content").alias("f"))
    return rows.select("slug", F.col("f.type").alias("type"), F.col("f.project").alias("project"), F.col("f.status").alias("status"), F.array_join("f.tags", ",").alias("tags"))


@query
def front_matter_strip(spark, sf_dir):
    return wiki(spark, sf_dir).select("slug", F.md5(frontmatter.body(F.col("content"))).alias("body_md5"))


@query
def pages_by_type(spark, sf_dir):
    return metadata.by_scalar(_pages(spark, sf_dir), "type", "CONCEPT")


@query
def pages_by_project(spark, sf_dir):
    return metadata.by_scalar(_pages(spark, sf_dir), "project", "SRC3")


@query
def pages_by_tag(spark, sf_dir):
    return metadata.by_tag(_pages(spark, sf_dir), "t3")


@query
def pages_without_sources(spark, sf_dir):
    return metadata.without_sources(_pages(spark, sf_dir))


@query
def catalogue_groups(spark, sf_dir):
    return metadata.catalogue(_pages(spark, sf_dir))


# --- lint -----------------------------------------------------------------------------------


@query
def missing_front_matter(spark, sf_dir):
    return lint.missing_front_matter(_pages(spark, sf_dir)).select("slug")


@query
def large_pages(spark, sf_dir):
    return lint.large_pages(_pages(spark, sf_dir), 10_000).select("slug", F.col("metric").alias("bytes"))


@query
def missing_see_also(spark, sf_dir):
    return lint.missing_see_also(_pages(spark, sf_dir)).select("slug")


@query
def decisions_without_rationale(spark, sf_dir):
    return lint.decisions_without_rationale(_pages(spark, sf_dir)).select("slug")


@query
def stale_pages(spark, sf_dir):
    pages = wiki(spark, sf_dir).select("slug", F.timestamp_seconds(1704067200 + F.col("doc_id") % 200 * 86400).alias("mtime"))
    return lint.stale(pages, F.timestamp_seconds(F.lit(1704067200 + 180 * 86400))).select("slug")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source ids raw-0 to raw-59; pages name those below 50."""
    return spark.range(60).select(F.concat(F.lit("raw-"), F.col("id").cast("string")).alias("source_id"))


@query
def raw_without_pages(spark, sf_dir):
    return lint.raw_without_pages(_sources(spark, sf_dir), _pages(spark, sf_dir)).select(F.col("slug").alias("source_id"))


@query
def lint_all(spark, sf_dir):
    found = lint.lint(_pages(spark, sf_dir), _sources(spark, sf_dir), large=10_000)
    return found.groupBy("check").agg(F.count("*").alias("findings"), F.min("slug").alias("first_slug"))


@query
def index_consistency(spark, sf_dir):
    """Entries of an index against the pages: every tenth is left out, every seventh is of older text, and some have no page."""
    pages = wiki(spark, sf_dir).select("doc_id", "slug", "content")
    held = pages.where("doc_id % 10 <> 4").select(F.when(F.col("doc_id") % 50 == 1, F.concat(F.lit("gone-"), "slug")).otherwise(F.col("slug")).alias("slug"), F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("old"))).otherwise(F.col("content"))).alias("hash"))
    return lint.index_drift(pages, held)


# --- claims, sections, chunks, diffs, links ---------------------------------------------------


@query
def claims_rows(spark, sf_dir):
    rows = metadata.claim_rows(wiki(spark, sf_dir))
    return rows.select("slug", F.col("idx").cast("long").alias("idx"), "text", "source", "confidence", "last_verified")


@query
def claims_parsed(spark, sf_dir):
    """The line-by-line reader: counts of claims and of fields."""
    rows = wiki(spark, sf_dir).select("slug", F.explode(claims.claims("content")).alias("c"))
    return rows.groupBy("slug").agg(F.count("*").alias("claims"), F.count("c.source").alias("sources"), F.count("c.last_verified").alias("verified"))


@query
def claims_without_source(spark, sf_dir):
    return metadata.claim_rows(wiki(spark, sf_dir)).where("source is null").select("slug", F.col("idx").cast("long").alias("idx"))


@query
def claim_verified(spark, sf_dir):
    """The claims of every page after its first one was checked on a date; a page without claims has an error instead."""
    rows = wiki(spark, sf_dir).select("slug", updates.verified("content", F.lit(0), F.lit("2025-05-05")).alias("e")).select("slug", "e.*")
    done = metadata.claim_rows(rows.where("error is null")).select("slug", F.col("idx").cast("long").alias("idx"), "text", "last_verified")
    bare = rows.where("error is not null").select("slug", F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("last_verified"))
    return done.unionByName(bare)


@query
def section_list(spark, sf_dir):
    """All headings, with their line from 0, level and title."""
    return wiki(spark, sf_dir).select("slug", F.inline(sections.sections("content")))


@query
def section_edit(spark, sf_dir):
    """The claims section replaced, and the section of further pages extended; pages without one give an error."""
    edit = lambda title, new, append: sections.edited("content", F.lit(title), F.lit(new), F.lit(append))
    rows = wiki(spark, sf_dir).select("slug", edit("Claims", "- none", False).alias("r"), edit("see also", "- more", True).alias("a"))
    return rows.select("slug", F.col("r.error").isNull().alias("ok"), F.md5("r.content").alias("replaced"), F.md5("a.content").alias("extended"))


@query
def chunk_spans(spark, sf_dir):
    """Chunks of each text: they begin at 0, end at its length, and none is over the target."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("bytes"), chunking.chunked("text").alias("c"))
    return rows.select("doc_id", F.col("bytes").cast("long").alias("bytes"), F.array_min(F.transform("c", lambda x: x.start)).cast("long").alias("first"), F.array_max(F.transform("c", lambda x: x.end)).cast("long").alias("last"), F.forall("c", lambda x: x.end - x.start <= 2000).alias("fits"))


@query
def diff_counts(spark, sf_dir):
    """Every page against itself with one line changed and one more: counts, and the changed lines of the unified diff."""
    new = F.concat(F.replace(F.col("content"), F.lit("\nSee [["), F.lit("\nLook at [[")), F.lit("one more line\n"))
    rows = wiki(spark, sf_dir).select("slug", diffing.compared("content", new).alias("d"))
    changed = F.array_join(F.filter(F.split("d.diff", "\n"), lambda x: x.rlike("^[+-]")), "\n")
    return rows.select("slug", "d.added", "d.removed", changed.alias("changed"))


@query
def diff_hunks(spark, sf_dir):
    """The heads of the hunks of the same change: where they begin in both texts, and their lines with context."""
    new = F.concat(F.replace(F.col("content"), F.lit("\nSee [["), F.lit("\nLook at [[")), F.lit("one more line\n"))
    rows = wiki(spark, sf_dir).select("slug", diffing.compared("content", new).alias("d"))
    return rows.select("slug", F.array_join(F.filter(F.split("d.diff", "\n"), lambda x: x.startswith("@@ ")), "\n").alias("hunks"))


@query
def migrate_links(spark, sf_dir):
    rows = wiki(spark, sf_dir).select("slug", rewrite.rewritten("content").alias("r"))
    return rows.select("slug", F.col("r.links").alias("links"), F.md5("r.content").alias("content_md5"))


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages overwritten, extended and made, and sections replaced."""
    kind = F.col("doc_id") % 5
    rows = wiki(spark, sf_dir).select("doc_id", "slug").where("doc_id % 5 < 4")
    return rows.select(
        F.when(kind == 2, F.concat(F.lit("new-"), "slug")).otherwise(F.col("slug")).alias("slug"), F.when((kind == 1) | (kind == 2), "append").otherwise("overwrite").alias("mode"),
        F.when(kind == 3, "Claims").alias("section"), F.concat(F.lit("New text "), F.col("doc_id").cast("string")).alias("content"), F.when(F.col("doc_id") % 2 == 0, "because").alias("rationale"),
    )


@query
def page_updates(spark, sf_dir):
    """What the edits make of the pages, with dates and log entries."""
    found = updates.update_pages(wiki(spark, sf_dir), _edits(spark, sf_dir), "2025-06-01")
    return found.select("slug", F.md5("content").alias("content_md5"), F.col("error").isNull().alias("ok"), "is_new", "log_entry")


@query
def page_proposals(spark, sf_dir):
    """Proposals made from the same edits."""
    at = F.timestamp_seconds(F.lit(1748779200))
    found = updates.propose(wiki(spark, sf_dir), _edits(spark, sf_dir), "2025-06-01", at)
    return found.select("proposal_id", "slug", "reason", "base_page_exists", "base_hash", "status")


@query
def metadata_edits(spark, sf_dir):
    """Front matter after edits: the status set, one tag added and the language's removed."""
    js = lambda key, value: F.to_json(F.create_map(F.lit(key), value))
    rows = wiki(spark, sf_dir).select("slug", updates.with_metadata("content", F.lit('{"status": "done"}'), F.lit('{"tags": ["new"]}'), js("tags", F.array("lang"))).alias("e"))
    fields = metadata.with_fields(rows.select("slug", F.col("e.content").alias("content")))
    return fields.select("slug", "type", "status", F.array_join("tags", ",").alias("tags"))


def _plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose bytes are characters, for the SQL: other letters become question marks."""
    return wiki(spark, sf_dir).select("slug", F.regexp_replace("content", r"[^\n -~]", "?").alias("content"))


def _page_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the chunks of all pages."""
    rows = _plain_pages(spark, sf_dir).select("slug", frontmatter.body(F.col("content")).alias("body"), F.explode(upkeep.page_chunks(F.col("content"))).alias("c"))
    embed = vectors.embedder(vectors.ByteHistogram(16))
    return rows.select("slug", "c.*", embed(chunking.piece(F.col("body"), F.col("c.start"), F.col("c.end"))).alias("vector"))


@query
def page_chunks(spark, sf_dir):
    """Every border of every chunk of the pages."""
    return _plain_pages(spark, sf_dir).select("slug", F.explode(upkeep.page_chunks(F.col("content"))).alias("c")).select("slug", "c.*")


@query
def semantic_snippets(spark, sf_dir):
    """The text of the best chunk of the best pages, from the pages' real chunks."""
    chunks = _page_vectors(spark, sf_dir)
    best = vectors.semantic_search(chunks, vectors.ByteHistogram(16).embed(["with from"])[0], 10)
    bodies = _plain_pages(spark, sf_dir).select("slug", frontmatter.body(F.col("content")).alias("content"))
    found = updates.best_snippets(best, chunks.select("slug", "index", "start", "end"), bodies)
    return found.select("slug", F.round("score", 5).alias("score"), F.md5("snippet").alias("snippet_md5"))


@query
def embedding_upkeep(spark, sf_dir):
    """Page vectors kept by a stream over the documents: one batch of all pages, one that changes, deletes and leaves some."""
    path = scratch(spark)
    kept = upkeep.Upkeep(path, vectors.ByteHistogram(16))
    pages = wiki(spark, sf_dir).select("doc_id", "slug", "content")
    first = pages.select("slug", "content", F.col("doc_id").alias("order"), F.lit(False).alias("deleted"))
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("more\n"))).otherwise(F.col("content"))
    second = pages.where("doc_id % 5 < 3").select("slug", tail.alias("content"), F.col("doc_id").alias("order"), (F.col("doc_id") % 5 == 1).alias("deleted"))
    for n, batch in enumerate((first, second)):
        batch.write.option("compression", "zstd").parquet(f"{path}/in/{n}")
    rows = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{path}/in/*")
    rows = rows.select("slug", "content", "order", "deleted", F.regexp_extract("_metadata.file_path", "/in/([0-9]+)/", 1).cast("int").alias("n"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        for n in (0, 1):  # the folders of the two batches, in their order
            kept.apply(batch.where(F.col("n") == n).drop("n"), 2 * batch_id + n)

    running = rows.writeStream.foreachBatch(apply).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    running.awaitTermination()
    spans = kept.vectors(spark).groupBy("slug", "body_hash", "model").agg(F.min("start").alias("first"), F.max("end").cast("long").alias("last"), F.max("index").alias("top"), F.count("*").alias("chunks"))
    return spans.select("slug", "body_hash", "model", "first", "last", (F.col("top") + 1 == F.col("chunks")).alias("whole"))


# --- mutation -------------------------------------------------------------------------------


@query
def proposal_conflicts(spark, sf_dir):
    """Proposals against pages of which every third changed meanwhile; some are closed already."""
    pages = wiki(spark, sf_dir).select("doc_id", "slug", "content")
    base = F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    proposals = pages.select("slug", F.concat(F.lit("p-"), F.col("doc_id").cast("string")).alias("proposal_id"), F.lit(True).alias("base_page_exists"), F.md5(base).alias("base_hash"), F.when(F.col("doc_id") % 5 == 0, "applied").otherwise("pending").alias("status"), F.lit("new").alias("proposed_content"), F.lit("2024").alias("created_at"))
    return mutation.judge_proposals(proposals, pages).select("proposal_id", "outcome")


@query
def rawindex_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_id"), F.struct(F.col("ts"), F.col("event_id")).alias("extracted_at"), "event_type")
    return mutation.raw_index(rows).select("source_id", "event_type", F.col("extracted_at.event_id").alias("event_id"))


@query
def page_upsert(spark, sf_dir):
    pages = wiki(spark, sf_dir).select("doc_id", "slug", F.md5("content").alias("hash"))
    changes = pages.where("doc_id % 10 = 3").withColumn("hash", F.lit("changed"))
    return mutation.upsert(pages, changes, ["doc_id", "slug"])


@query
def ingest_sources(spark, sf_dir):
    """One row for each url, that of the last page; every fifth page's url is held already."""
    rows = table(spark, sf_dir, "pages").where("url is not null").groupBy(F.col("url").alias("uri")).agg(F.max_by("html", "page_id").alias("content"), F.max("page_id").alias("page_id"))
    rows = rows.select("uri", "content", F.lit("html").alias("type"), text.mime_of(F.regexp_replace("uri", "[?#].*$", "")).alias("mime"), "page_id")
    held = rows.where("page_id % 5 = 0").select(F.md5("uri").alias("source_id"))
    return mutation.ingest(rows, held).select("source_id", "mime_type", F.col("size_bytes").cast("long").alias("size_bytes"))


# --- names ----------------------------------------------------------------------------------


@query
def slug_validity(spark, sf_dir):
    last = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", last.alias("slug"), text.valid_slug(last).alias("valid"))


@query
def mime_lookup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.mime_of(F.regexp_replace("url", "[?#].*$", "")).alias("mime"))


@query
def uri_parse(spark, sf_dir):
    uri = F.element_at(F.array(F.lit("wiki://log"), F.lit("wiki://index"), F.concat(F.lit("wiki://page/p"), F.col("page_id").cast("string")), F.concat(F.lit("raw://source/s"), F.col("page_id").cast("string")), F.concat(F.lit("raw://sourcemetadata/s"), F.col("page_id").cast("string")), F.lit("raw://sources"), F.col("url")), (F.col("page_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", text.uri_kind(uri).alias("u")).select("page_id", "u.kind", "u.id")


@query
def path_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.path_slug(F.col("url")).alias("slug"))


# --- change stream --------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query
def event_latest_per_key(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    return mutation.latest(rows, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query
def event_sessions(spark, sf_dir):
    return ev.quiet_sessions(_events(spark, sf_dir), "2 hours", "user_id").select("user_id", F.unix_seconds("first_ts").alias("first_s"), "events")


#: Kinds of change that stand for the kinds of the events table.
KINDS = {"signup": "page_created", "view": "page_updated", "error": "page_deleted", "purchase": "raw_updated", "click": "log_changed"}


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for a, b in KINDS.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    return _events(spark, sf_dir).select("ts", F.col("event_id").alias("order"), "user_id", kind.alias("kind"), F.concat(F.lit("p"), (F.col("event_id") % 50).cast("string")).alias("key"))


@query
def commit_batches(spark, sf_dir):
    return ev.commit_batches(_changes(spark, sf_dir), "2 hours", "user_id").select("user_id", F.unix_seconds("first_ts").alias("first_s"), "events", "message")


@query
def event_rename_split(spark, sf_dir):
    name = lambda n: F.concat(F.lit("/w/pages/p"), (F.col("event_id") % n).cast("string"), F.lit(".md"))
    files = _events(spark, sf_dir).select("ts", F.when(F.col("event_type") == "view", "rename").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "click", "access").otherwise("modify").alias("op"), F.when(F.col("event_type") == "view", F.array(name(50), name(70))).otherwise(F.array(name(50))).alias("paths"))
    return ev.domain_events(ev.split_renames(files)).groupBy("kind", "key").agg(F.count("*").alias("events"))


@query
def dirty_index_bursts(spark, sf_dir):
    rows = _changes(spark, sf_dir).where(ev.dirties_index(F.col("kind"), F.col("key")))
    return ev.quiet_sessions(rows, "30 minutes").select(F.unix_seconds("first_ts").alias("first_s"), "events")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = table(spark, sf_dir, "events").schema
    read = spark.readStream.schema(schema)
    rows = read.parquet(f"{sf_dir}/events.parquet") if _is_folder(spark, sf_dir) else read.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_bursts(spark, sf_dir):
    """Bursts that a live stream has closed by its watermark, each sent once."""
    path = scratch(spark)
    found = ev.debounced(_event_stream(spark, sf_dir).withWatermark("ts", "1 hour"), "2 hours", "user_id")
    running = ev.started(found.writeStream.format("parquet").option("path", f"{path}/bursts").option("checkpointLocation", f"{path}/log").trigger(availableNow=True))
    running.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/bursts").select("user_id", F.unix_seconds("first_ts").alias("first_s"), "events")


@query
def stream_sessions(spark, sf_dir):
    """The sessions of ``event_sessions``, by a stream that reads the table's files as they are."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not _is_folder(spark, sf_dir) else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")
    found = ev.quiet_sessions(rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour"), "2 hours", "user_id")
    path = scratch(spark)
    put = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/sessions")  # the last batch has all; none of it comes to the driver
    running = found.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{path}/sessions").select("user_id", F.unix_seconds("first_ts").alias("first_s"), "events")


@query
def stream_maintained(spark, sf_dir):
    """The last event of each user, kept by a stream's batches in a table."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not _is_folder(spark, sf_dir) else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")
    rows = rows.select("user_id", F.col("event_id").alias("last_event"), "event_id", (F.col("event_type") == "error").alias("deleted"))
    path = scratch(spark)
    running = rows.writeStream.foreachBatch(ev.maintain(f"{path}/table", ["user_id"], "event_id")).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    running.awaitTermination()
    last = running.lastProgress["batchId"] if running.lastProgress else 0
    return spark.read.parquet(f"{path}/table/v{last}").select("user_id", "last_event")


def _is_folder(spark: SparkSession, sf_dir: str) -> bool:
    """Whether the events table is a folder of files (Spark's own file system looks)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
