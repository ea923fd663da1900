"""Ids in texts and one-pass lint against brute force; diffs against the whole table of lengths."""

import random
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import diffing
from quillspark.operators import containment, graph, lint, metadata


def whole_table(a, b):
    """The same walk over a table that is held whole."""
    length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            length[i][j] = length[i + 1][j + 1] + 1 if a[i] == b[j] else max(length[i + 1][j], length[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("=", a[i]))
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or length[i + 1][j] >= length[i][j + 1]):
            out.append(("-", a[i]))
            i += 1
        else:
            out.append(("+", b[j]))
            j += 1
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=25), st.lists(st.sampled_from("abcdxyz"), max_size=25))
def test_inner_walk(a, b):
    assert diffing._inner(a, b) == whole_table(a, b)


def test_long_diffs_are_bounded():
    old = [f"a {i}" for i in range(100_000)]
    new = [f"b {i}" if i % 50 else f"a {i}" for i in range(100_000)]
    shared = random.Random(1)
    few, many = ([str(shared.randrange(40)) for _ in range(n)] for n in (3_000, 4_000))
    tracemalloc.start()
    apart = diffing.diff(old, new)
    mixed = diffing.diff(few, many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(m == "=" for m, _ in apart) == 2_000 and peak < 60e6
    for ops, a, b in ((apart, old, new), (mixed, few, many)):
        assert [x for m, x in ops if m != "+"] == a and [x for m, x in ops if m != "-"] == b


def test_ids_in_texts(spark):
    rng = random.Random(7)
    ids = ["", "x", "né", "a.b*c", "\U0001f600" * 3] + [f"source-2024-{i:04d}" for i in range(300)] + ["q" * 90 + str(i) for i in range(20)]
    word = lambda: "".join(rng.choice("abé-\n") for _ in range(rng.randrange(1, 9)))
    texts = [None, "", "né"] + ["".join(rng.choice([word(), rng.choice(ids), rng.choice(ids)[:-1]]) for _ in range(rng.randrange(60))) for _ in range(8)]
    texts.append("-" * 3000 + "source-2024-0299" + "-" * 177 + "q" * 90 + "19")
    want = {i for i in ids if i and any(t and i in t for t in texts)}
    left = spark.createDataFrame([(i,) for i in [*ids, ids[5], None]], "id string")
    right = spark.createDataFrame([(t, 1) for t in texts], "text string, id int")
    assert want and len(want) < len(ids) - 1
    for part_bytes in (containment.PART_BYTES, 1_500):
        assert {r.id for r in containment.occurring(left, right, part_bytes).collect()} == want
    assert containment.occurring(left.where("false"), right).count() == 0 == containment.occurring(left, right.where("false")).count()


def test_many_ids_in_one_pass(spark):
    ids = spark.range(100_000).select(F.format_string("source-%06d", "id").alias("id"))
    texts = spark.range(2000).select(F.format_string("from source-%06d, source-%05d.", F.col("id") * 50, "id").alias("text"))
    assert containment.occurring(ids, texts).select(F.count("*"), F.max("id")).first()[:] == (2000, "source-099950")


def test_lint_in_one_pass(spark):
    rows = [("index", "[[a]] [[gone]]"), ("a", "---\ntype: x\n---\n[[a]] wiki://page/b " + "long " * 30), ("b", "## See also\n[[gone]] [[gone]]"), ("adr-2", ""), ("adr-3", "## Rationale")]
    pages = metadata.with_fields(spark.createDataFrame(rows, "slug string, content string")).withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))
    sources = spark.createDataFrame([("type",), ("absent",)], "source_id string")
    now = F.lit("2024-06-01").cast("timestamp")
    parts = [lint.broken_links(pages), lint.orphan_pages(pages), lint.large_pages(pages, 100), lint.missing_front_matter(pages), lint.missing_see_also(pages), lint.raw_without_pages(sources, pages)]
    full = [*parts, lint.decisions_without_rationale(pages), lint.similar_pages(pages), lint.stale(pages, now)]
    got = lambda frames: sorted(map(str, (r for f in frames for r in f.collect())))
    assert got([lint.lint(pages, sources, now, large=100)]) == got(full)
    assert got([lint.lint(pages, sources, everything=False, large=100)]) == got(parts)
    assert lint.lint(pages.where("false"), sources).count() == 2
    assert {r.slug for r in lint.orphan_pages(pages).collect()} == {r.slug for r in graph.lint_orphans(pages, graph.body_links(pages)).collect()} == {"index", "adr-2", "adr-3"}
