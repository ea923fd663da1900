"""Text functions on the reference cases, and invariants."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import chunking, claims, diffing, frontmatter, rewrite, sections, text
from quillspark.plans import parser


def column(spark, values, make):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(make(F.col("v"))).collect()]


def test_tokens(spark):
    got = column(spark, ["foo,bar.baz:qux", "Hello WORLD", "né de"], text.similarity_tokens)
    assert [sorted(x) for x in got] == [["bar", "baz", "foo", "qux"], ["hello", "world"], ["né"]]


def test_links(spark):
    cases = {"wiki://page/home.": ["home"], "[[a]] [[a|text]] [[  a  |x]]": ["a"], "[[\nhome\n]] [[com espaço]] [[com/barra]]": [], "wiki://log wiki://index raw://source/abc": []}
    assert column(spark, list(cases), text.links) == list(cases.values())


def test_slugs(spark):
    bad = ["..", "a/b", "a:b", "hello world", "", "CON", ".hidden", "trailing.", "con.md"]
    assert not any(column(spark, bad, text.valid_slug))
    assert all(column(spark, ["doc.md", "api_v2"], text.valid_slug))


def test_snippets(spark):
    cut, whole = column(spark, ["A" * 500, "á" * 200], text.snippet)
    assert cut == "A" * 300 + "..." and whole == "á" * 200


def test_uris_and_mime(spark):
    got = column(spark, ["wiki://log", "wiki://page/x", "raw://sourcemetadata/y", "http://x"], text.uri_kind)
    assert [g and tuple(g) for g in got] == [("log", None), ("page", "x"), ("raw_metadata", "y"), None]
    assert column(spark, ["a/b.MD", "b.htm", "noext", ".md"], text.mime_of) == ["text/markdown", "text/html", None, None]


FRONT = '---\ntype: note\ntags: [a, "b"]\nsources:\n  - s1\n  - s2\nextra: 5\n---\nbody\n'


def test_front_matter_columns(spark):
    row = column(spark, [FRONT], frontmatter.fields)[0]
    assert (row.type, row.tags, row.sources, row.related) == ("note", ["a", "b"], ["s1", "s2"], [])
    bad = ["---\ntype: x\nno end", "---\n# head\ntype: x\n---\n", "---\n\n---\nx", "text\n---\nmore", "---\r\ntype: x\r\n---\r\n"]
    assert column(spark, bad, frontmatter.fields) == [None] * 5
    assert column(spark, [FRONT, bad[0], "---\ntype: x\n---"], frontmatter.body) == ["body\n", bad[0], ""]


def test_front_matter_yaml(spark):
    assert frontmatter.parse_page(FRONT)["sources"] == ["s1", "s2"]
    assert frontmatter.parse_page("---\ntags: word\n---\n") is None
    assert frontmatter.parse_page("---\ntype: yes\ncreated_at: 2024-01-01\n---\n")["created_at"] == "2024-01-01"
    assert frontmatter.parse_page("---\ntype: note\n---\n")["tags"] == []
    rows = spark.createDataFrame([(FRONT,), (None,)], "v string").select(frontmatter.parsed("v").alias("f")).collect()
    assert rows[0].f.tags == ["a", "b"] and rows[1].f.type is None


def test_front_matter_edits():
    out = frontmatter.apply_metadata(FRONT, {"status": "done"}, {"tags": ["a", "c"]}, {"sources": ["s1", "s2"]})
    fields = frontmatter.parse_page(out)
    assert (fields["status"], fields["tags"], fields["sources"]) == ("done", ["a", "b", "c"], []) and "extra: 5" in out and out.endswith("---\nbody\n")
    for bad in ({"set_fields": {"updated_at": "x"}}, {"add": {"type": ["x"]}}):
        with pytest.raises(ValueError):
            frontmatter.apply_metadata(FRONT, **bad)
    assert frontmatter.apply_metadata("---\ntags: [a]\n---\nb", remove={"tags": ["a"]}) == "b"
    dated = frontmatter.with_dates("---\ncreated_at: old\nupdated_at: old\n---\nx", "2026-05-15", False)
    assert dated == '---\ncreated_at: old\nupdated_at: "2026-05-15"\n---\nx'
    assert frontmatter.with_dates("x", "2026-01-01", True).startswith('---\ncreated_at: "2026-01-01"\nupdated_at')


def test_sections():
    assert sections.heading("## Título ##") == (2, "Título")
    assert [sections.heading(x) for x in ("#hashtag", "####### x", "    # x")] == [None] * 3
    page = "# A\nx\n## B\nold\n### C\nchild\n## D\nrest\n"
    assert sections.edit(page, "b", "new") == "# A\nx\n## B\n\nnew\n\n## D\nrest\n"
    assert sections.edit(page, "## D", "more", append=True).endswith("## D\n\nrest\n\nmore\n")
    fenced = "## A\n```\n# no\n```\nx\n## B\n"
    assert [h[2] for h in sections.scan(fenced)] == ["A", "B"]
    for title in ("none", "##"):
        with pytest.raises(ValueError):
            sections.edit(page, title, "x")
    with pytest.raises(ValueError):
        sections.edit("# A\n# A\n", "A", "x")
    assert sections.edit("# A\r\nx\r\n# B\r\n", "A", "y") == "# A\r\n\r\ny\r\n\r\n# B\r\n"


CLAIMS = "# P\n## Claims\n- One `x`\n  - Source: `raw://s`\n  - Confiança: alta\n- Two\n  - Last verified: 2024-01-01\n## Next\n- no claim\n"


def test_claims():
    found = claims.parse(CLAIMS)
    assert [c["text"] for c in found] == ["One `x`", "Two"]
    assert found[0]["source"] == "`raw://s`" and found[0]["confidence"] == "alta" and found[1]["last_verified"] == "2024-01-01"
    one = claims.set_last_verified(CLAIMS, 0, "2025-01-01")
    assert claims.parse(one)[0]["last_verified"] == "2025-01-01" and claims.parse(one)[0]["source"] == "`raw://s`"
    assert claims.parse(claims.set_last_verified(CLAIMS, 1, "2025-01-01"))[1]["last_verified"] == "2025-01-01"
    for content, i in (("none", 0), (CLAIMS, 5)):
        with pytest.raises(ValueError):
            claims.set_last_verified(content, i, "x")


def test_chunks():
    assert chunking.chunks("  \n") == [] and chunking.chunks("") == []
    assert chunking.chunks("x" * 500, 100)[0] == (0, 0, 100)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é€.\n", min_size=1, max_size=300), st.integers(8, 60))
def test_chunk_cover(body, target):
    got = chunking.chunks(body, target)
    raw = body.encode()
    if not body.strip():
        assert got == []
        return
    assert got[0][1] == 0 and got[-1][2] == len(raw)
    joined, end = b"", 0
    for _, a, b in got:
        assert a <= end <= b and a < b and b - a <= target
        raw[a:b].decode()
        joined += raw[end:b]
        end = b
    assert joined == raw


def test_diff():
    assert diffing.stats("a\nb", "a\nx\ny\nb") == (2, 0)
    assert diffing.stats("a\nb\nc", "a\nB\nc") == (1, 1)
    old = "\n".join(map(str, range(40)))
    out = diffing.unified(old, old.replace("\n20\n", "\nnew\n"))
    assert out.startswith("@@ -18,7 +18,7 @@\n") and "-20\n+new\n" in out and " 5\n" not in out
    assert diffing.unified("a", "a") == ""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_diff_reverses(old, new):
    ops = diffing.diff(old, new)
    assert [x for m, x in ops if m != "+"] == old and [x for m, x in ops if m != "-"] == new


def test_rewrite():
    page = "---\nsee: wiki://page/a\n---\n[T](wiki://page/s) `wiki://page/x` wiki://page/y. [[z]] [s](wiki://page/s)\n```\nwiki://page/q\n```\n`code wiki://page/n`\n"
    out, n = rewrite.rewrite_page(page)
    assert n == 4 and "[[s|T]] [[x]] [[y]]. [[z]] [[s]]" in out and "```\nwiki://page/q" in out and "`code wiki://page/n`" in out and "see: wiki://page/a" in out
    assert rewrite.rewrite_page(out) == (out, 0)


def test_parser():
    assert parser.parse("  ").kind == "all"
    assert parser.terms(parser.parse("+a -b c")) == ["a", "c"]
    assert parser.parse('"x y"').words == ["x", "y"] and parser.parse("x-y").kind in ("and", "phrase")
    with pytest.raises(parser.QueryError):
        parser.parse('a "b')
    assert parser.terms(parser.parsed('a "b')) == ["a", "b"]
    assert text.escaped_query("a+b") == "a\\+b"


#: Characters that end a line elsewhere, but not in a page.
NO_LINE_ENDS = ["\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\r"]


@pytest.mark.parametrize("mark", NO_LINE_ENDS)
def test_edits_cut_lines_at_line_feeds_only(mark):
    page = f"# A\nx{mark}y\n## B\nold\n## C\nkeep{mark}z\n"
    assert sections.edit(page, "B", "new") == f"# A\nx{mark}y\n## B\n\nnew\n\n## C\nkeep{mark}z\n"
    assert sections.edit(page, "C", "more", append=True).startswith(f"# A\nx{mark}y\n## B\nold\n## C\n\nkeep")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["text", "", "# A", "## B", "### C", "```", "~~~", "x\x0cy", "a\u2028b", "q\x85", "end\r", "\r"]), max_size=12), st.lists(st.sampled_from(["", "tail\x1c", "# Z", "body"]), max_size=5))
def test_edits_leave_the_rest(before, after):
    """All lines outside the section stay byte for byte."""
    page = "\n".join([*before, "# Only here", "old", "## inner", "x", "# Next", *after])
    headings = sections.scan(page)
    if [h[2].lower() for h in headings].count("only here") != 1:
        return
    line = next(h[0] for h in headings if h[2] == "Only here")
    end = next(h[0] for h in headings if h[0] > line and h[1] == 1)
    out = sections.edit(page, "only here", "new")
    lines = page.split("\n")
    assert out.startswith("\n".join(lines[: line + 1])) and out.endswith("\n".join(lines[end:]))
    assert "old" not in out[len("\n".join(lines[: line + 1])) : len(out) - len("\n".join(lines[end:]))]


def test_results_of_a_batch_leave_slice_by_slice(spark):
    """A batch's rows aren't Python objects all at once, and its results aren't held to its end."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from quillspark import functions

    made = functions.row_function(T.StringType())(lambda x: x and x.upper())
    parts = list(made.func(iter([pa.array(["a", None] * functions.SLICE), pa.array([], pa.string()), pa.array(["b"])])))
    assert [len(p) for p in parts] == [functions.SLICE] * 2 + [1] and parts[2].to_pylist() == ["B"]
    both = functions.row_function(T.IntegerType(), 2)(lambda a, b: a + b)
    rows = spark.range(0, 3000, 1, 2).select("id", both("id", F.lit(5).cast("long")).alias("n"), made(F.col("id").cast("string")).alias("s")).collect()
    assert len(rows) == 3000 and all(r.n == r.id + 5 and r.s == str(r.id) for r in rows)
