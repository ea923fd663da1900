"""A stored full-text index: segments of postings, tombstones and a log of commits, in any folder that Spark can write.

``docs/segment=`` holds the documents of each commit, numbered by task, kind and length;
``postings/segment=/bucket=`` their postings, bucketed by a hash of the term, a row (block) for
each field, term and window of at most 4096 document numbers: places within the window, frequencies,
field lengths and positions as arrays, with the block's greatest frequency and least length.
``dead/by=`` and ``dead_terms/by=`` hold what a commit has replaced or deleted in older segments,
and how many documents each term lost by that.  ``log`` has one row for each commit, appended by
one Spark job, so a reader sees a commit whole or not at all; segments that no commit names
don't count.  Commits come from one writer at a time; a reader looks at the log anew for each
search.

A search reads the buckets of its terms and nothing of the texts but the snippets of its hits.
Corpus figures come from the log, document frequencies from block heads.  ``top_k`` bounds each
window from its blocks' heads, scores the windows of greatest bound first, and then only those
whose bound reaches the k-th score found: exact, as blocks that are skipped can't hold a hit.
Phrases are found by intersecting shifted positions within each window.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_terms, snippet
from ..plans import parser
from ..session import batch_bytes
from .lexical import FIELDS, B, K1

WINDOW, BUCKETS = 4096, 64
#: Terms that a window holds before it ends.
TOKENS = 1 << 20
#: Rows of a batch whose texts are Python strings at once.
ROWS = 64
#: Windows that a search scores first, at least.
FIRST = 32
LOG = "version long, op string, segment string, added long, docs long, title_docs long, content_docs long, title_len long, content_len long, buckets array<int>, dead_buckets array<int>"
DOCS = "doc long, uri string, kind string, title string, content string, snippet string, last_modified long, segment string"
POSTINGS = "kind string, field string, term string, window long, n int, total long, max_tf int, min_dl int, places array<int>, tfs array<int>, dls array<int>, positions array<int>, segment string, bucket int"
#: A window's blocks on their way to their bucket, in one row, as most terms are rare: a block's data are places, frequencies, lengths and positions.
PACKED = "kind string, field string, window long, bucket int, terms string, ns array<int>, starts array<int>, data array<int>"
DEAD = "segment string, doc long, by string"
DEAD_TERMS = "field string, term string, n long, by string, bucket int"
FIGURES = ("docs", "title_docs", "content_docs", "title_len", "content_len")
#: A bound this much below the k-th score may still be equal to it but for rounding.
SLACK = 1 + 1e-9


@dataclass
class State:
    """What the log says: live segments, which of them hold documents, and the corpus figures."""

    version: int = 0
    segments: list[str] = field(default_factory=list)
    filled: list[str] = field(default_factory=list)
    figures: dict[str, int] = field(default_factory=lambda: dict.fromkeys(FIGURES, 0))
    buckets: dict[str, list[int]] = field(default_factory=dict)  # those that a segment's postings have
    dead_buckets: dict[str, list[int]] = field(default_factory=dict)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def _blocks_of(window: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed blocks of rows (kind, doc, and each field's terms joined by blanks), a window of documents at a time.

    A window ends where the kind changes, at ``window`` numbers, or at ``TOKENS`` terms; it is
    known by its first document's number, so windows of different tasks don't meet.
    """

    def made(field: str, kind: str | None, base: int, places: list[int], texts: list[np.ndarray], names: dict[str, int]) -> pa.RecordBatch:
        lengths = np.array([len(x) for x in texts], np.int64)
        ids = np.concatenate(texts).astype(np.int64)
        bucket = np.fromiter((zlib.crc32(t.encode()) % buckets for t in names), np.int64, len(names))
        by_bucket = np.argsort(bucket, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[by_bucket] = np.arange(len(names))
        ids, words = rank[ids], list(names)  # numbered bucket by bucket
        order = np.argsort(ids, kind="stable")
        row = np.repeat(np.arange(len(texts)), lengths)[order]
        position = (np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[order]
        ids = ids[order]
        posts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])]))
        tf, post_row = np.diff(np.append(posts, len(ids))), row[posts]
        blocks = np.flatnonzero(np.concatenate([[True], ids[posts][1:] != ids[posts][:-1]]))
        n = np.diff(np.append(blocks, len(posts)))
        sizes = 3 * n + np.add.reduceat(tf, blocks)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = np.empty(ends[-1], np.int32)
        inside = np.arange(len(posts)) - np.repeat(blocks, n)
        at = np.repeat(ends[:-1], n) + inside
        for k, values in enumerate((np.array(places)[post_row], tf, lengths[post_row])):
            data[at + k * np.repeat(n, n)] = values
        token_block = np.repeat(np.arange(len(blocks)), sizes - 3 * n)
        data[ends[token_block] + 3 * n[token_block] + np.arange(len(ids)) - posts[blocks][token_block]] = position
        held, counts = np.unique(bucket, return_counts=True)
        groups = np.concatenate([[0], np.cumsum(counts)])
        cut = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, pa.int32()))
        terms = [" ".join(words[i] for i in by_bucket[a:b]) for a, b in zip(groups, groups[1:], strict=False)]
        columns = [
            pa.array([kind] * len(held), pa.string()), pa.array([field] * len(held)), pa.array(np.full(len(held), base), pa.int64()), pa.array(held, pa.int32()),
            pa.array(terms), cut(groups, n), cut(groups, ends[:-1] - np.repeat(ends[groups[:-1]], counts)), cut(ends[groups], data),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PACKED.split(", ")])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, kind, tokens, places = None, None, 0, []
        texts: dict[str, list[np.ndarray]] = {f: [] for f in FIELDS}
        names: dict[str, dict[str, int]] = {f: {} for f in FIELDS}  # a window holds each term once, and its texts as numbers

        def ended() -> Iterator[pa.RecordBatch]:
            for f in FIELDS:
                if any(len(x) for x in texts[f]):
                    yield made(f, kind, base, places, texts[f], names[f])

        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            for own_kind, doc, *fields in zip(*(batch.column(i).to_pylist() for i in range(2 + len(FIELDS))), strict=True):
                if base is not None and (own_kind != kind or not 0 <= doc - base < window or tokens > TOKENS):
                    yield from ended()
                    base, tokens, places, texts, names = None, 0, [], {f: [] for f in FIELDS}, {f: {} for f in FIELDS}
                if base is None:
                    base, kind = doc, own_kind
                places.append(doc - base)
                for f, text in zip(FIELDS, fields, strict=True):
                    words, own = text.split(" ") if text else [], names[f]
                    texts[f].append(np.fromiter((own.setdefault(w, len(own)) for w in words), np.int32, len(words)))
                    tokens += len(texts[f][-1])
        if base is not None:
            yield from ended()

    return make


class Index:
    """An index in a folder.  ``buckets`` and ``window`` belong to the folder and stay as they were at its first commit."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, window: int = WINDOW) -> None:
        self.spark, self.root, self.buckets, self.window = spark, root.rstrip("/"), buckets, window

    # --- the log ------------------------------------------------------------------------------

    def state(self) -> State:
        """As of the last commit: a small table, a row for each commit."""
        out = State()
        try:
            rows = self.spark.read.schema(LOG).parquet(f"{self.root}/log").orderBy("version").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return out
        for r in rows:
            if r.op != "add":  # a cleared index, or one whose segments became a single one
                out = State()
            if r.segment:
                out.segments.append(r.segment)
                out.buckets[r.segment], out.dead_buckets[r.segment] = r.buckets or [], r.dead_buckets or []
            if r.added:
                out.filled.append(r.segment)
            out.figures = {k: out.figures[k] + r[k] for k in FIGURES}
            out.version = r.version
        return out

    def _commit(self, op: str, segment: str | None, added: int, change: dict[str, int]) -> None:
        held = [self._buckets(f"postings/segment={segment}") if added else [], self._buckets(f"dead_terms/by={segment}") if op == "add" and self.state().filled else []]
        row = (self.state().version + 1, op, segment, added, *[change[k] for k in FIGURES], *held)
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def _buckets(self, folder: str) -> list[int]:
        """The buckets that a commit has written there."""
        try:
            rows = self.spark.read.schema("bucket int").parquet(f"{self.root}/{folder}").select("bucket").distinct().collect()
        except AnalysisException as e:  # no term at all
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r.bucket for r in rows)

    def _bucketed(self, table: str, schema: str, part: str, held: dict[str, list[int]], terms: list[str]) -> DataFrame:
        """Rows of the terms, from the folders of their buckets alone."""
        own = {zlib.crc32(t.encode()) % self.buckets for t in terms}
        paths = [f"{self.root}/{table}/{part}={s}/bucket={b}" for s, some in held.items() for b in some if b in own]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths).where(F.col("term").isin(terms))

    def _read(self, table: str, schema: str, part: str, parts: list[str]) -> DataFrame:
        """A table's rows of the named segments."""
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/{part}={p}" for p in parts])

    def _dead(self, state: State) -> DataFrame:
        return self._read("dead", DEAD, "by", state.segments[1:]).select("segment", "doc").where(F.col("segment").isin(state.filled))

    def documents(self, state: State | None = None) -> DataFrame:
        """The live documents."""
        state = state or self.state()
        return self._read("docs", DOCS, "segment", state.filled).join(self._dead(state), ["segment", "doc"], "left_anti")

    # --- commits ------------------------------------------------------------------------------

    def _write_segment(self, docs: DataFrame, segment: str) -> dict[str, int]:
        """Documents and postings of a segment; its figures."""
        rows = docs.select("uri", "kind", "title", "content", snippet(F.col("content")).alias("snippet"), F.col("last_modified").cast("long").alias("last_modified"))
        # within a task short documents stand together, so that blocks have tight bounds; texts aren't shuffled
        rows = rows.sortWithinPartitions("kind", F.octet_length("content"), "uri")
        rows.select(F.monotonically_increasing_id().alias("doc"), "*").write.option("compression", "zstd").parquet(f"{self.root}/docs/segment={segment}")
        held = self._read("docs", DOCS, "segment", [segment])
        joined = [F.array_join(search_terms(F.col(f)), " ").alias(f) for f in FIELDS]  # a term holds no blank
        blocks = held.select("kind", "doc", *joined).mapInArrow(_blocks_of(self.window, self.buckets), PACKED)
        data = F.transform("starts", lambda s, i: F.slice("data", s + 1, F.coalesce(F.get("starts", i + 1), F.size("data")) - s))
        each = F.inline(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("ns").alias("n"), data.alias("data")))
        # a task writes its own part of each bucket: no block is shuffled
        blocks = blocks.select("kind", "field", "window", "bucket", each).toDF("kind", "field", "window", "bucket", "term", "n", "data")
        blocks = blocks.sortWithinPartitions("bucket", "term", "field", "kind", "window")
        part = lambda k: F.slice("data", 1 + k * F.col("n"), F.col("n"))
        total = F.size("data") - 3 * F.col("n")
        blocks = blocks.select(
            "kind", "field", "term", "window", "n", total.cast("long").alias("total"), F.array_max(part(1)).alias("max_tf"),
            F.array_min(part(2)).alias("min_dl"), part(0).alias("places"), part(1).alias("tfs"), part(2).alias("dls"), F.slice("data", 1 + 3 * F.col("n"), total).alias("positions"), "bucket",
        )
        with batch_bytes(self.spark):  # a worker's memory is that of a window, not of a large batch
            blocks.write.option("parquet.writer.version", "v2").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/postings/segment={segment}")
        sums = {r.field: r.n for r in self._read("postings", POSTINGS, "segment", [segment]).groupBy("field").agg(F.sum("total").alias("n")).collect()} if self._buckets(f"postings/segment={segment}") else {}
        return self._counts(held) | {f"{f}_len": sums.get(f, 0) for f in FIELDS}

    @staticmethod
    def _counts(docs: DataFrame, *more: Column) -> dict[str, int]:
        row = docs.agg(F.count("*").alias("docs"), F.count("title").alias("title_docs"), F.count("content").alias("content_docs"), *more).first()
        return {k: v or 0 for k, v in row.asDict().items()}

    def _change(self, docs: DataFrame | None, gone: DataFrame) -> int:
        """One commit: what stands under the uris of ``gone`` goes, then ``docs`` come; older segments aren't touched."""
        state = self.state()
        segment = f"s{state.version + 1}-{uuid.uuid4().hex[:8]}"
        added = dict.fromkeys(FIGURES, 0)
        if docs is not None:
            added = self._write_segment(docs, segment)
        lost = dict.fromkeys(FIGURES, 0)
        if state.filled:
            old = self.documents(state).join(gone.select("uri").distinct(), "uri", "left_semi")
            old.select("segment", "doc").write.parquet(f"{self.root}/dead/by={segment}")
            dead = self.spark.read.schema("segment string, doc long").parquet(f"{self.root}/dead/by={segment}")
            held = self._read("docs", DOCS, "segment", state.filled).join(dead, ["segment", "doc"], "left_semi")
            lost = self._counts(held, *[F.sum(F.size(search_terms(F.col(f)))).alias(f"{f}_len") for f in FIELDS])
            terms = None
            for f in FIELDS:
                one = held.select(F.lit(f).alias("field"), F.explode(F.array_distinct(search_terms(F.col(f)))).alias("term"))
                terms = one if terms is None else terms.unionByName(one)
            counted = terms.groupBy("field", "term").agg(F.count("*").alias("n")).withColumn("bucket", _bucket(F.col("term"), self.buckets))
            counted.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/dead_terms/by={segment}")
        self._commit("add", segment, added["docs"], {k: added[k] - lost[k] for k in FIGURES})
        return added["docs"]

    def upsert(self, docs: DataFrame) -> int:
        """Add or replace documents (uri, kind, title, content, last_modified) in one commit; how many.

        Of rows with one uri the last modified counts.
        """
        columns = [c.split()[0] for c in DOCS.split(", ")[1:7] if not c.startswith("snippet")]
        rows = docs.select(*columns).where("uri is not null")
        if rows.groupBy("uri").count().where("count > 1").isEmpty():  # then no text has to meet another
            return self._change(rows, rows)
        last = rows.groupBy("uri").agg(F.max_by(F.struct(*columns[1:]), F.struct("last_modified", F.xxhash64("kind", "title", "content"))).alias("r")).select("uri", "r.*")
        return self._change(last, last)

    def delete(self, uris: DataFrame) -> None:
        """Documents of these uris go, in one commit."""
        self._change(None, uris)

    def clear(self) -> None:
        self._commit("clear", None, 0, dict.fromkeys(FIGURES, 0))

    def rebuild(self, docs: DataFrame) -> int:
        """All documents anew.  Without any, the index stays as it is."""
        if docs.isEmpty():
            return 0
        self.clear()
        return self.upsert(docs)

    def compact(self) -> None:
        """One segment of the live documents in place of all; results stay the same."""
        state = self.state()
        if not state.filled:
            return
        segment = f"s{state.version + 1}-{uuid.uuid4().hex[:8]}"
        figures = self._write_segment(self.documents(state), segment)
        self._commit("compact", segment, figures["docs"], figures)

    # --- searches -----------------------------------------------------------------------------

    def blocks(self, state: State, terms: list[str]) -> DataFrame:
        """Postings of the terms; other buckets aren't read."""
        return self._bucketed("postings", POSTINGS, "segment", {s: state.buckets[s] for s in state.filled}, terms)

    def _lost(self, state: State, terms: list[str]) -> DataFrame:
        return self._bucketed("dead_terms", DEAD_TERMS, "by", state.dead_buckets, terms)

    def frequencies(self, terms: list[str], state: State | None = None) -> dict[tuple[str, str], int]:
        """Live documents by field and term."""
        state = state or self.state()
        heads = self.blocks(state, terms).select("field", "term", F.col("n").cast("long").alias("n"))
        rows = heads.unionByName(self._lost(state, terms).select("field", "term", (-F.col("n")).alias("n"))).groupBy("field", "term").agg(F.sum("n").alias("n")).collect()
        return {(r.field, r.term): r.n for r in rows}

    def term_frequencies(self) -> DataFrame:
        """field, term and df of all live terms, from block heads."""
        state = self.state()
        heads = self._read("postings", POSTINGS, "segment", state.filled).select("field", "term", F.col("n").cast("long").alias("n"))
        lost = self._read("dead_terms", DEAD_TERMS, "by", [s for s, some in state.dead_buckets.items() if some]).select("field", "term", (-F.col("n")).alias("n"))
        return heads.unionByName(lost).groupBy("field", "term").agg(F.sum("n").alias("df")).where("df > 0")

    def _weights(self, state: State, terms: list[str], fields: tuple[str, ...]) -> list[tuple[str, str, float, float]]:
        """field, term, idf and mean field length, in the order in which scores are summed."""
        df = self.frequencies(terms, state)
        n, out = state.figures["docs"], []
        for f in fields:
            mean = state.figures[f"{f}_len"] / max(1, state.figures[f"{f}_docs"])
            for t in terms:
                if (d := df.get((f, t), 0)) > 0:
                    out.append((f, t, math.log(1 + (n - d + 0.5) / (d + 0.5)), mean))
        return out

    @staticmethod
    def _part(weight: tuple[str, str, float, float], tf: Column, dl: Column) -> Column:
        _, _, idf, mean = weight
        return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean)))

    def _scored(self, blocks: DataFrame, weights: list, state: State) -> DataFrame:
        """segment, kind, doc and score of the live documents of the blocks."""
        posts = blocks.select("segment", "kind", "field", "term", "window", F.explode(F.arrays_zip("places", "tfs", "dls")).alias("p"))
        posts = posts.select("segment", "kind", (F.col("window") + F.col("p.places")).alias("doc"), "field", "term", F.col("p.tfs").cast("double").alias("tf"), F.col("p.dls").cast("double").alias("dl"))
        parts = [F.max(F.when((F.col("field") == w[0]) & (F.col("term") == w[1]), self._part(w, F.col("tf"), F.col("dl")))).alias(f"p{i}") for i, w in enumerate(weights)]
        found = posts.groupBy("segment", "kind", "doc").agg(*parts)
        score = F.lit(0.0)
        for i in range(len(weights)):  # always in this order: equal documents get equal scores
            score = score + F.coalesce(F.col(f"p{i}"), F.lit(0.0))
        return found.select("segment", "kind", "doc", score.alias("score")).join(self._dead(state), ["segment", "doc"], "left_anti")

    def phrase(self, words: list[str], fields: tuple[str, ...] = FIELDS, state: State | None = None) -> DataFrame:
        """segment and doc where the words stand next to each other, in order: windows intersect their shifted positions."""
        state = state or self.state()
        places: dict[str, list[int]] = {}
        for j, w in enumerate(words):
            places.setdefault(w, []).append(j)
        at = F.create_map(*[x for w, js in places.items() for x in (F.lit(w), F.array(*map(F.lit, js)))])
        rows = self.blocks(state, list(places)).where(F.col("field").isin(list(fields))).select("segment", "kind", "field", "window", "places", "tfs", "positions", F.explode(F.element_at(at, F.col("term"))).alias("j"))
        each = F.flatten(F.zip_with("places", "tfs", lambda p, n: F.array_repeat(p, n)))  # a place for each position
        start = lambda p, at: F.when(at >= F.col("j"), p.cast("long") * (1 << 32) + (at - F.col("j")))
        rows = rows.select("segment", "kind", "field", "window", F.filter(F.zip_with(each, "positions", start), lambda s: s.isNotNull()).alias("starts"))
        met = rows.groupBy("segment", "kind", "field", "window").agg(F.collect_list("starts").alias("l")).where(F.size("l") == len(words))
        both = F.aggregate(F.slice("l", 2, len(words)), F.get("l", F.lit(0)), F.array_intersect)
        docs = F.explode(F.array_distinct(F.transform(both, lambda s: F.shiftright(s, 32))))
        return met.select("segment", "window", docs.alias("place")).select("segment", (F.col("window") + F.col("place")).alias("doc")).distinct()

    def _leaf(self, node: parser.Node, state: State) -> DataFrame:
        if node.kind == "phrase":
            return self.phrase(node.words, node.fields, state)
        rows = self.blocks(state, node.words).where(F.col("field").isin(list(node.fields)))
        return rows.select("segment", "window", F.explode("places").alias("place")).select("segment", (F.col("window") + F.col("place")).alias("doc")).distinct()

    def _flags(self, tree: parser.Node, state: State) -> tuple[DataFrame, Column]:
        """segment, doc and the tree's leaves that it has (a bit each), and the tree as a condition on these."""
        leaves: list[parser.Node] = []

        def condition(node: parser.Node) -> Column:
            if node.kind == "all" or node.kind in ("term", "phrase") and not node.words:
                return F.lit(True)
            if node.kind == "not":
                return ~condition(node.parts[0])
            if node.kind in ("and", "or"):
                out = condition(node.parts[0])
                for p in node.parts[1:]:
                    out = out & condition(p) if node.kind == "and" else out | condition(p)
                return out
            leaves.append(node)
            return F.col("bits").bitwiseAND(F.lit(1 << (len(leaves) - 1))) != 0

        wanted = condition(tree)
        if len(leaves) > 62:
            raise ValueError("a query of more than 62 terms and phrases")
        rows = None
        for i, leaf in enumerate(leaves):
            one = self._leaf(leaf, state).withColumn("bits", F.lit(1 << i))
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            rows = self.spark.createDataFrame([], "segment string, doc long, bits long")
        return rows.groupBy("segment", "doc").agg(F.bit_or("bits").alias("bits")), wanted

    def matching(self, query: str) -> DataFrame:
        """uri of the live documents that match a query text."""
        state, tree = self.state(), parser.parsed(query)
        flags, wanted = self._flags(tree, state)
        docs = self.documents(state).select("segment", "doc", "uri")
        return docs.join(flags, ["segment", "doc"], "left").withColumn("bits", F.coalesce("bits", F.lit(0))).where(wanted).select("uri")

    def search(self, query: str, limit: int, kind: str | None = None) -> DataFrame:
        """uri, title, kind, score and snippet of the best hits, as ``search.lexical_search`` over the texts."""
        tree = parser.parsed(query)
        terms = parser.terms(tree)
        if not terms:
            docs = self.documents().where(F.col("kind") == kind) if kind else self.documents()
            if tree.kind != "all":
                docs = docs.join(self.matching(query), "uri", "left_semi")
            return docs.select("uri", "kind", "title", F.lit(1.0).alias("score"), "snippet").orderBy("uri").limit(limit)
        plain = tree.kind == "term" and tree.fields == FIELDS or tree.kind == "or" and all(p.kind == "term" and p.fields == FIELDS for p in tree.parts)
        return self.top_k(terms, limit, kind, tree=None if plain else tree)

    def top_k(self, terms: list[str], limit: int, kind: str | None = None, fields: tuple[str, ...] = FIELDS, tree: parser.Node | None = None, told: dict[str, int] | None = None) -> DataFrame:
        """The best hits, ties by uri; ``told`` gets how many of the terms' blocks there are, and how many were scored.

        The first windows, in order of their bounds, are ``limit`` many, or as many more as hold
        ``limit`` hits; then come all windows whose bound reaches the k-th score of those.
        """
        state = self.state()
        terms = list(dict.fromkeys(terms))
        weights = self._weights(state, terms, fields)
        if not weights or limit < 1:
            return self.spark.createDataFrame([], "uri string, kind string, title string, score double, snippet string")
        used = F.lit(False)
        for f, t, _, _ in weights:
            used = used | (F.col("field") == f) & (F.col("term") == t)
        blocks = self.blocks(state, terms).where(used if kind is None else used & (F.col("kind") == kind))
        bound = F.lit(0.0)
        for w in weights:
            bound = F.when((F.col("field") == w[0]) & (F.col("term") == w[1]), self._part(w, F.col("max_tf").cast("double"), F.col("min_dl").cast("double"))).otherwise(bound)
        windows = blocks.groupBy("segment", "kind", "window").agg((F.sum(bound) * SLACK).alias("bound"), F.count("*").alias("n"))
        flags = self._flags(tree, state) if tree is not None else None

        def scored(some: DataFrame) -> DataFrame:
            found = self._scored(some, weights, state)
            if flags is None:
                return found
            return found.join(flags[0], ["segment", "doc"], "left").withColumn("bits", F.coalesce("bits", F.lit(0))).where(flags[1]).drop("bits")

        first = max(limit, FIRST)
        while True:  # twice as many windows each time
            top = windows.orderBy(F.desc("bound"), "segment", "kind", "window").limit(first).collect()
            if len(top) < first:  # these are all
                hits, some = scored(blocks), top
                break
            places: dict[tuple[str, str], list[int]] = {}
            for r in top:
                places.setdefault((r.segment, r.kind), []).append(r.window)
            inside = F.lit(False)
            for (segment, own_kind), own in places.items():
                inside = inside | (F.col("segment") == segment) & F.col("kind").eqNullSafe(own_kind) & F.col("window").isin(own)
            best = [r.score for r in scored(blocks.where(inside)).select("score").orderBy(F.desc("score")).limit(limit).collect()]
            if len(best) == limit:
                some = windows.where(F.col("bound") >= F.lit(best[-1]))
                near = [blocks[c].eqNullSafe(some[c]) for c in ("segment", "kind", "window")]
                hits = scored(blocks.join(some, near, "left_semi")).where(F.col("score") >= F.lit(best[-1]))  # with all ties of the last
                break
            first *= 2
        if told is not None:
            told["blocks"] = windows.agg(F.sum("n")).first()[0]
            told["scored"] = sum(r.n for r in some) if isinstance(some, list) else some.agg(F.sum("n")).first()[0]
        docs = self._read("docs", DOCS, "segment", state.filled).select("segment", "doc", "uri", "title", "snippet")
        most = 4 * limit + 64
        known = hits.orderBy(F.desc("score")).limit(most).collect()
        if len(known) >= limit and known[-1].score < known[limit - 1].score or len(known) < most:
            # no tie of the last hit is missing: their rows are found by number
            if not known:
                return self.spark.createDataFrame([], "uri string, kind string, title string, score double, snippet string")
            score = F.create_map(*[x for r in known for x in (F.lit(f"{r.segment}:{r.doc}"), F.struct(F.lit(r.kind).cast("string").alias("kind"), F.lit(r.score).alias("score")))])
            found = docs.where(F.col("doc").isin([r.doc for r in known])).withColumn("h", F.try_element_at(score, F.concat("segment", F.lit(":"), F.col("doc").cast("string")))).where("h is not null")
            found = found.select("uri", "h.kind", "title", "h.score", "snippet")
        else:
            found = hits.join(docs, ["segment", "doc"]).select("uri", "kind", "title", "score", "snippet")
        return found.orderBy(F.desc("score"), "uri").limit(limit)
