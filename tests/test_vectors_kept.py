"""Embedding upkeep by batches, and the vector files' data source."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import chunking, frontmatter
from quillspark.operators.vectors import ByteHistogram, Transient
from quillspark.sources.vectorsource import PageVectors
from quillspark.streaming.embeddings import Upkeep, coverage, page_chunks

CHANGES = "slug string, content string, order long, deleted boolean"


def shaky(down):
    """A provider that fails for texts that ask for it; made here, so it travels to workers as a whole."""

    class Shaky(ByteHistogram):
        def embed(self, texts):
            if any("never" in t for t in texts):
                raise ValueError("no such words")
            if down and any("later" in t for t in texts):
                raise Transient("busy")
            return ByteHistogram.embed(self, texts)

    return Shaky(8)


def state(spark, kept):
    return sorted((r.slug, r["index"], r.start, r.end, r.body_hash, r.model, tuple(r.vector)) for r in kept.vectors(spark).collect())


def wanted(pages, model="bytes-8"):
    import hashlib

    out = []
    for slug, body in pages.items():
        for i, a, b in chunking.chunks(body):
            vector = ByteHistogram(8).embed([body.encode()[a:b].decode()])[0]
            out.append((slug, i, a, b, hashlib.md5(body.encode()).hexdigest(), model, tuple(vector)))
    return sorted(out)


def near(a, b):
    assert [x[:-1] for x in a] == [x[:-1] for x in b]
    assert all(abs(p - q) < 1e-6 for x, y in zip(a, b, strict=True) for p, q in zip(x[-1], y[-1], strict=True))


def test_upkeep(spark, tmp_path):
    long = "Words é of a page. " * 300
    front = "---\ntype: note\n---\n"
    first = [("a", front + long, 1, False), ("b", "short", 1, False), ("b", "shorter", 0, False), ("c", "later please", 1, False), ("d", "never", 1, False), ("e", "", 1, False), ("index", "x", 1, False), (None, "x", 1, False), ("f", None, 1, None)]
    kept = Upkeep(str(tmp_path), shaky(True), attempts=2, backoff_s=0.01)
    kept.apply(spark.createDataFrame(first, CHANGES).selectExpr("*", "'x' as body", "1 as batch"), 0)
    near(state(spark, kept), wanted({"a": long, "b": "short"}))
    assert sorted((r.slug, r.transient) for r in kept.failed(spark).collect()) == [("c", True), ("d", False)]
    kept.apply(spark.createDataFrame(first, CHANGES), 0)  # the same batch once more
    near(state(spark, kept), wanted({"a": long, "b": "short"}))
    up = Upkeep(str(tmp_path), shaky(False), attempts=2, backoff_s=0.01)
    second = [("a", front.replace("note", "other") + long, 2, False), ("b", "", 2, True), ("d", "never", 2, False), ("g", "new", 2, False)]
    before = {p for p in (tmp_path / "vectors/batch=0").glob("*.parquet")}
    for _ in range(2):
        up.apply(spark.createDataFrame(second, CHANGES), 1)
    assert {p for p in (tmp_path / "vectors/batch=0").glob("*.parquet")} == before
    near(state(spark, up), wanted({"a": long, "c": "later please", "g": "new"}))
    tried = spark.read.parquet(str(tmp_path / "tried/batch=1"))
    assert {r.slug for r in tried.collect()} == {"c", "g"}  # another type alone needs no vectors; d failed for good
    up.apply(spark.createDataFrame([("d", "fine now", 3, False), ("g", "never", 3, False)], CHANGES), 2)
    near(state(spark, up), wanted({"a": long, "c": "later please", "d": "fine now", "g": "new"}))  # a failed page keeps its vectors
    assert [r.slug for r in up.failed(spark).collect()] == ["g"]
    pages = spark.createDataFrame([("a", long), ("c", "changed"), ("h", "h"), ("index", "")], "slug string, content string")
    assert sorted((r.slug, r.status) for r in coverage(pages, up.pages(spark), "bytes-8").collect()) == [("a", "current"), ("c", "stale"), ("h", "missing")]
    assert {r.status for r in coverage(pages, up.pages(spark), "other").collect()} == {"stale", "missing"}


def shuffled(spark):
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    jvm = spark.sparkContext._jvm
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_shuffled_once_and_written_if_needed(spark, tmp_path):
    """A batch's bodies meet by page in one shuffle; pieces, failures and unchanged pages send none."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz    \n", k=20_000)) for _ in range(100)]
    rows = [(f"p{i}", t, 1, False) for i, t in enumerate(texts)]
    kept, bytes_of = Upkeep(str(tmp_path), shaky(False)), []
    second = [(s, t + "more" if i == 0 else t, 2, i == 1) for i, (s, t, _, _) in enumerate(rows)]
    for n, changes in enumerate((rows, second)):
        batch, before = spark.createDataFrame(changes, CHANGES), shuffled(spark)
        kept.apply(batch, n)
        bytes_of.append(shuffled(spark) - before)
    assert max(bytes_of) < 1.3 * sum(map(len, texts))
    held = spark.read.parquet(str(tmp_path / "changes/batch=1")).collect()
    assert sorted((r.slug, r.body) for r in held) == [("p0", texts[0] + "more"), ("p1", None)]
    near(state(spark, kept), wanted({f"p{i}": t + "more" if i == 0 else t for i, t in enumerate(texts) if i != 1}))


def test_page_chunks(spark):
    pages = ["---\ntype: x\n---\n" + "A line of text\n" * 400, "no front", "", None, "é" * 3000]
    df = spark.createDataFrame([(p,) for p in pages], "content string")
    got = df.select(page_chunks(F.col("content")).alias("c"), frontmatter.body(F.col("content")).alias("b")).collect()
    assert [[(x["index"], x.start, x.end) for x in r.c] for r in got] == [chunking.chunks(r.b or "") for r in got]


ROWS = "slug string, dim int, model string, body_hash string, chunks array<struct<index:int,start:int,end:int,vector:array<float>>>"


def pages_of(spark, slugs, parts=3):
    rows = [(s, 2, "m", f"h-{s}", [(1, 5, 9, [3.0, 4.0]), (0, 0, 5, [1.0, 2.0])]) for s in slugs]
    return spark.createDataFrame(rows, ROWS).repartition(parts)


def test_vector_source(spark, tmp_path):
    spark.dataSource.register(PageVectors)
    folder = str(tmp_path / "vectors")
    read = lambda: {r.slug: (r.dim, r.model, r.body_hash, [(c["index"], c.start, c.end, list(c.vector)) for c in r.chunks]) for r in spark.read.format("page_vectors").option("path", folder).load().collect()}
    pages_of(spark, [f"p{i}" for i in range(20)]).write.format("page_vectors").option("path", folder).mode("append").save()
    found = read()
    assert set(found) == {f"p{i}" for i in range(20)} and found["p7"] == (2, "m", "h-p7", [(0, 0, 5, [1.0, 2.0]), (1, 5, 9, [3.0, 4.0])])
    (tmp_path / "vectors/bad.bin").write_bytes(b"nope")
    assert read() == found
    with pytest.raises(Exception, match="no vector file"):
        spark.read.format("page_vectors").option("path", folder).option("mode", "failfast").load().collect()
    (tmp_path / "vectors/bad.bin").unlink()
    for bad in (pages_of(spark, ["q1", "q2", "../up"]), pages_of(spark, ["q1", "q1", "q1"], 3)):
        with pytest.raises(Exception, match="no page name|came twice"):
            bad.write.format("page_vectors").option("path", folder).mode("append").save()
        assert read() == found and not list((tmp_path / "vectors/_pending").glob("*"))  # nothing of a failed job shows
    pages_of(spark, ["p1", "new"]).write.format("page_vectors").option("path", folder).mode("overwrite").save()
    assert set(read()) == {"p1", "new"}
