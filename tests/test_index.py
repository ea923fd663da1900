"""The stored index against searches over the texts."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import lexical
from quillspark.operators.index import Index, _blocks_of
from quillspark.operators.lexical import FIELDS
from quillspark.plans import search
from quillspark.sources.tables import index_documents

SCHEMA = "uri string, kind string, title string, content string, last_modified long"


def shown(df):
    return [(r.uri, r.kind, r.title, round(r.score, 9), r.snippet) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Überall", "x-ray", "naïve"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(f"u{i:03}", rng.choice(["page", "raw"]), rng.choice(words), " ".join(rng.choices(words, weights, k=rng.randint(0, 60))), i) for i in range(300)]
    rows += [(f"t{i}", "page", "same", "w0 w1 same text", i) for i in range(40)]  # ties
    rows += [("nothing", "raw", "", "", 1), ("long", "page", "long", "w3 " * 30_000 + "end", 3)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as doc", "'x' as segment", "2 as term")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    made = Index(spark, str(tmp_path_factory.mktemp("index")), buckets=8, window=16)
    assert made.upsert(docs) == 342
    return made


@pytest.mark.parametrize("query", ["w1 w7", '"w0 w0 w1"', '"x-ray naïve"', "+w3 -w0", "title:w2", "content:same w9", "(w1 OR w5) AND w2", "", "-w0", "nowhere", '"w1'])
def test_searches_equal_those_over_texts(index, docs, query):
    kind = "raw" if len(query) % 2 else None
    assert shown(index.search(query, 15, kind)) == shown(search.lexical_search(docs, query, 15, kind))


def test_block_max_is_exact_and_skips(index, docs, monkeypatch):
    monkeypatch.setattr("quillspark.operators.index.FIRST", 2)
    rng, told = random.Random(9), []
    for _ in range(6):
        terms = [f"w{rng.choice([0, 1, 2, 5, 11, 20, 33, 47])}" for _ in range(rng.randint(1, 3))]
        k = rng.choice([1, 3, 45])
        one = {}
        assert shown(index.top_k(terms, k, told=one)) == shown(lexical.search(docs, terms, k))
        told.append(one)
    assert sum(x["scored"] for x in told) < sum(x["blocks"] for x in told)
    assert all(0 < x["scored"] <= x["blocks"] for x in told)


def test_changes(spark, docs, tmp_path):
    made = Index(spark, str(tmp_path / "ix"), buckets=8, window=16)
    assert made.search("w0", 5).count() == 0 and made.upsert(docs) == 342
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "ix").rglob("*.parquet")}
    before = files()
    changed = docs.where("last_modified % 9 = 4").withColumn("content", F.concat(F.lit("fresh w40 "), "content"))
    added = spark.createDataFrame([("new", "page", "w0", "fresh w1", 7), ("new", "page", "later", "fresh later", 8)], SCHEMA)
    n = made.upsert(changed.select(*[c.split()[0] for c in SCHEMA.split(", ")]).unionByName(added))
    assert n == changed.count() + 1
    made.delete(docs.where("last_modified % 9 = 5").select("uri"))
    assert {p: t for p, t in files().items() if p in before} == before  # no old segment is written again
    now = docs.where("last_modified % 9 not in (4, 5)").unionByName(changed).select(*[c.split()[0] for c in SCHEMA.split(", ")]).unionByName(added.where("last_modified = 8"))

    def same():
        for query in ("fresh w1", "w0", '"fresh later"', "+w2 -fresh"):
            assert shown(made.search(query, 20)) == shown(search.lexical_search(now, query, 20))
        got = {(r.field, r.term, r.df) for r in made.term_frequencies().where("field = 'content'").collect()}
        assert got == {("content", r.term, r.df) for r in lexical.term_stats(now).collect()}

    same()
    made.compact()
    assert len(made.state().segments) == 1
    same()
    assert made.rebuild(docs.limit(0)) == 0  # nothing to index leaves the index
    same()
    reader = Index(spark, str(tmp_path / "ix"), buckets=8, window=16)
    made.clear()
    assert reader.search("w0", 5).count() == 0 and reader.search("", 5).count() == 0  # readers see commits at once
    assert made.rebuild(docs) == 342
    assert shown(reader.search("w1 w7", 15)) == shown(search.lexical_search(docs, "w1 w7", 15))


def test_nulls(spark, tmp_path):
    """Null texts are empty, a row without uri isn't indexed."""
    rows = [("a", None, None, None, None), ("b", "page", None, "w1", 1), (None, "page", "w1", "w1", 2)]
    made = Index(spark, str(tmp_path / "ix"))
    assert made.upsert(spark.createDataFrame(rows, SCHEMA)) == 2
    assert [r.uri for r in made.search("w1", 5).collect()] == ["b"]
    assert [r.uri for r in made.search("-w1", 5).collect()] == ["a"]
    assert [r.uri for r in made.search("", 5).collect()] == ["a", "b"]


def test_uncommitted_segments_do_not_count(spark, docs, index):
    before = shown(index.search("w1", 10))
    index._write_segment(docs.withColumn("uri", F.concat(F.lit("z"), "uri")), "s9-lost")
    assert shown(index.search("w1", 10)) == before


def test_search_reads_its_buckets_alone(index):
    read = index.blocks(index.state(), ["w1"]).inputFiles()
    assert read and {f.split("bucket=")[1].split("/")[0] for f in read} == {str(__import__("zlib").crc32(b"w1") % 8)}


def test_index_over_the_tables(spark, data, tmp_path):
    docs = index_documents(spark, data)
    made = Index(spark, str(tmp_path / "ix"))
    made.upsert(docs)
    for query in ("with from", '"of the"'):
        assert shown(made.search(query, 20)) == shown(search.lexical_search(docs, query, 20))


def test_texts_of_a_batch_are_not_strings_all_at_once():
    """A large Arrow batch takes memory for a few of its texts as words, not for all."""
    text = " ".join(f"w{i % 500}" for i in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array(["page"] * 500), pa.array(range(500), pa.int64()), pa.array([""] * 500), pa.array([text] * 500)], ["kind", "doc", *FIELDS])
    tracemalloc.start()
    made = sum(b.num_rows for b in _blocks_of(4096, 8)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 8 and peak < 100_000_000  # 79 MB; 128 MB with all texts as words


def test_blocks_are_written_without_a_shuffle(spark, docs, tmp_path):
    """A task writes its own part of each bucket: several files in the buckets of common terms."""
    made = Index(spark, str(tmp_path / "parts"))
    made.upsert(docs.repartition(3))
    files = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "parts/postings").glob("segment=*/bucket=*")]
    assert max(files) == 3


def test_workers_get_small_batches(spark, tmp_path, monkeypatch):
    """However many texts a task has, a worker gets a few MB of them at a time, and the session's setting is as before."""

    def checked(window, buckets):
        make = _blocks_of(window, buckets)

        def small(batches):
            def seen():
                for b in batches:
                    if b.nbytes > 8 << 20:
                        raise ValueError(f"a batch of {b.nbytes} bytes")
                    yield b

            yield from make(seen())

        return small

    monkeypatch.setattr("quillspark.operators.index._blocks_of", checked)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 300, 1, 1).select(F.concat(F.lit("u"), "id").alias("uri"), F.lit("page").alias("kind"), F.lit("t").alias("title"), F.repeat(F.lit("word "), 10_000).alias("content"), F.col("id").alias("last_modified"))
    made = Index(spark, str(tmp_path / "small"))
    assert made.upsert(docs) == 300 and made.frequencies(["word"]) == {("content", "word"): 300}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
