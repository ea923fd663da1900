"""Operators on small frames, and every registered query against its oracle."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import fusion, graph, lexical, lint, metadata, mutation, similarity, updates, vectors
from quillspark.oracles import ORACLES
from quillspark.plans import render, search
from quillspark.queries import QUERIES
from quillspark.sources import vectorfiles, wiki
from quillspark.streaming import events

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_oracle(spark, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("documents", "embeddings", "events", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(show(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(show(r[i]) for i in at) for r in found.fetchall())


def test_whole_tables(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet").select(F.concat(F.lit("conv-"), "conv_id").alias("s"), "turn", similarity.similarity_tokens(F.col("text")).alias("t")).collect()
    sets = sorted((r.s, r.turn, frozenset(r.t)) for r in turns)
    pairs = [(-round(len(x & y) / len(x | y), 6), a, i, b, j) for n, (a, i, x) in enumerate(sets) for b, j, y in sets[n + 1 :] if x & y and len(x & y) / len(x | y) >= 0.25]
    assert [(-r.similarity, r.slug_a, r.idx_a, r.slug_b, r.idx_b) for r in QUERIES["conflicting_claims"](spark, data).collect()] == sorted(pairs)[:50]
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = {r.slug: r.last_verified for r in QUERIES["claim_verified"](spark, data).where("coalesce(idx, 1) = 1").collect()}
    assert len(got) == len(docs) and all(got[f"doc-{r.doc_id}"] == (None if r.doc_id % 8 == 1 else "2025-05-05") for r in docs if f"doc-{r.doc_id}" in got)
    assert QUERIES["term_stats"](spark, data).where("df = 1").count() > 0


def test_link_suggestions_with_boosts(spark, data):
    from quillspark.sources.tables import wiki as made

    pages = metadata.with_fields(made(spark, data).select("slug", "content"))
    linked = {frozenset((r.src, r.dst)) for r in graph.edges(pages).collect()}
    rows = sorted((r.slug, (r.project or "").lower(), set(r.tags), set(r.t)) for r in pages.select("slug", "project", "tags", similarity.similarity_tokens(F.col("content")).alias("t")).collect())
    want = []
    for n, (a, p, x, s) in enumerate(rows):
        for b, q, y, t in rows[n + 1 :]:
            score = (len(s & t) / len(s | t) if s | t else 0) + 0.15 * (p == q != "") + min(0.05 * len(x & y), 0.2)
            if frozenset((a, b)) not in linked and "index" not in (a, b) and score >= 0.15:
                want.append((-round(score, 6), a, b))
    got = [(-r.score, r.a, r.b) for r in QUERIES["link_suggestions"](spark, data).collect()]
    assert got == sorted(want)[:20] and len({a for _, a, _ in got}) > 1


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def pages_of(spark, rows):
    return spark.createDataFrame([(a, b, c) for a, b, c in rows], "slug string, content string, related array<string>")


def test_graph(spark):
    pages = pages_of(spark, [("index", "[[about]] [[home]]", []), ("home", "[[about]] [[gone]] [[home]]", ["about"]), ("about", "", [])])
    edge = graph.edges(pages)
    assert sorted(map(tuple, edge.collect())) == [("home", "about", "body"), ("home", "gone", "body"), ("index", "about", "body"), ("index", "home", "body")]
    assert [r.slug for r in graph.orphans(pages, edge).collect()] == ["home"]
    assert [tuple(r) for r in graph.broken(pages, edge).collect()] == [("home", "gone")]
    assert graph.hubs(pages, edge).first().slug == "home"
    assert "nós): 3" in render.graph_text(pages, edge) and "-->" in render.graph_text(pages, edge, "mermaid")
    rel = pages_of(spark, [("home", "[[mutual]] [[target]]", ["kept"]), ("mutual", "[[home]]", []), ("source", "[[home]]", [])])
    got = [(r.relation, r.slug) for r in graph.related(graph.edges(rel), "home").collect()]
    assert got == [("bidirectional", "mutual"), ("declared", "kept"), ("links-to", "target"), ("linked-from", "source")]


def test_similarity(spark):
    words = " ".join(f"word{i}" for i in range(50))
    pages = spark.createDataFrame([("b", words), ("a", words), ("c", "apple banana cherry"), ("d", "apple banana date")], "slug string, content string")
    sets = similarity.token_sets(pages, "slug", "content")
    assert [tuple(r) for r in similarity.jaccard_pairs(sets, "slug", 0.6, 20).collect()] == [("a", "b", 1.0)]
    assert sorted(tuple(r) for r in similarity.jaccard_pairs(sets, "slug", 0.5).collect()) == [("a", "b", 1.0), ("c", "d", 0.5)]
    full = pages.withColumns({"project": F.lit(None).cast("string"), "tags": F.array().cast("array<string>")})
    none = spark.createDataFrame([], "src string, dst string, kind string")
    assert [(r.a, r.b) for r in similarity.link_suggestions(full, none, 0.6).collect()] == [("a", "b")]
    linked = spark.createDataFrame([("b", "a", "body")], "src string, dst string, kind string")
    assert similarity.link_suggestions(full, linked, 0.6).count() == 0


def _jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 0


def test_suggestions_by_levels(spark):
    """Settled by the prefix join, by the whole candidates, with null tags, and with a focus: equal to brute force."""
    base = [f"word{i}" for i in range(40)]
    rows = [(f"p{i:02}", " ".join(base[i % 4 : 30 + i % 7]), "Px" if i % 3 else None, ["t1", "t2"][: i % 3] if i % 5 else None) for i in range(30)]
    pages = spark.createDataFrame(rows, "slug string, content string, project string, tags array<string>")
    edge = spark.createDataFrame([("p01", "p08", "body"), ("p09", "p02", "body")], "src string, dst string, kind string")
    want = []
    for n, (a, x, p, s) in enumerate(rows):
        for b, y, q, t in rows[n + 1 :]:
            score = _jaccard(set(x.split()), set(y.split())) + 0.15 * (p == q == "Px") + min(0.05 * len(set(s or []) & set(t or [])), 0.2)
            if (a, b) not in {("p01", "p08"), ("p02", "p09")} and score >= 0.15:
                want.append((-round(score, 6), a, b))
    show = lambda df: [(-r.score, r.a, r.b) for r in df.collect()]
    for limit in (3, 400):
        assert show(similarity.link_suggestions(pages, edge, limit=limit)) == sorted(want)[:limit]
    turned = sorted((s, "p09", a if b == "p09" else b) for s, a, b in want if "p09" in (a, b))
    assert show(similarity.link_suggestions(pages, edge, limit=40, focus="p09")) == turned


def test_conflicts_among_equal_claims(spark):
    """Equal claims beyond any limit change nothing: equal to brute force, settled early or not."""
    texts = ["red green blue cyan", "cyan blue green red", "red green blue grey", "black white brown pink", "red green lilac mauve", "", None]
    rows = [(f"s{i % 17:02}", i, texts[i % 3] if i % 4 else texts[i % 7]) for i in range(60)]
    claims = spark.createDataFrame(rows, "slug string, idx int, text string")
    sets = sorted((s, i, frozenset((t or "").split())) for s, i, t in rows)
    pairs = [(-round(_jaccard(x, y), 6), a, i, b, j) for n, (a, i, x) in enumerate(sets) for b, j, y in sets[n + 1 :] if _jaccard(x, y) >= 0.25]
    for limit in (1, 5, 5000):
        assert [(-r.similarity, r.slug_a, r.idx_a, r.slug_b, r.idx_b) for r in similarity.conflicting_claims(claims, limit=limit).collect()] == sorted(pairs)[:limit]


def test_vectors_and_fusion(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([1.0], [1.0, 0.0], 0), ([], [], 0), ([0.0], [1.0], 0)]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>, want int")
    assert all(abs(r.c - r.want) < 1e-12 for r in df.select("want", vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect())
    chunks = spark.createDataFrame([("p", 0, [1.0, 0.0]), ("p", 1, [0.0, 1.0]), ("q", 0, [0.7, 0.7])], "slug string, index int, vector array<float>")
    best = vectors.semantic_search(chunks, [0.0, 1.0], 2).collect()
    assert [(r.slug, r.best_index) for r in best] == [("p", 1), ("q", 0)]
    top = lambda rows: spark.createDataFrame(rows, "slug string, score double")
    fused = fusion.fused_top(fusion.rrf(fusion.ranked(top([("a", 2.0), ("c", 1.0)]), "slug"), fusion.ranked(top([("a", 2.0), ("b", 1.0)]), "slug"), "slug"), 5).collect()
    assert [(r.slug, round(r.rrf, 9)) for r in fused] == [("a", round(3 / 60, 9)), ("b", round(2 / 61, 9)), ("c", round(1 / 61, 9))]


def test_search_falls_back(spark):
    docs = spark.createDataFrame([("page", "wiki://page/lex", "lex", "qwxz qwxz qwxz qwxz"), ("page", "wiki://page/other", "other", "asa " * 10), ("raw", "raw://source/r", "r", "qwxz")], "kind string, uri string, title string, content string")
    embed = vectors.embedder(vectors.ByteHistogram())
    chunks = docs.where("kind = 'page'").select(F.regexp_replace("uri", ".*/", "").alias("slug"), F.lit(0).alias("index"), embed("content").alias("vector"))

    class Broken:
        model = "x"

        def embed(self, texts):
            raise RuntimeError

    query = "qwxz aaaaaaaa ssssssss"
    slugs = lambda **k: [r.slug for r in search.query_wiki(docs, chunks, query, **k).orderBy("position").collect()]
    assert slugs(provider=vectors.ByteHistogram(), mode="semantic")[0] == "other"
    assert slugs(mode="bm25") == ["lex"] and slugs(provider=Broken()) == ["lex"]
    assert set(slugs(provider=vectors.ByteHistogram())) == {"lex", "other"}
    assert slugs(provider=vectors.ByteHistogram(), raws=True)[-1] == "r"
    kinds = lexical.search(docs, ["qwxz"], 1, kind="raw").collect()
    assert [r.uri for r in kinds] == ["raw://source/r"]


def test_mutation(spark):
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    pages = spark.createDataFrame([("p", "new"), ("q", "same")], "slug string, content string")
    rows = [("1", "p", True, md5("old"), "x", "pending", "t"), ("2", "q", True, md5("same"), "y", "pending", "t"), ("3", "z", False, None, "z", "pending", "t"), ("4", "q", True, "", "n", "applied", "t")]
    proposals = spark.createDataFrame(rows, "proposal_id string, slug string, base_page_exists boolean, base_hash string, proposed_content string, status string, created_at string")
    assert {r.proposal_id: r.outcome for r in mutation.judge_proposals(proposals, pages).collect()} == {"1": "conflict", "2": "applied", "3": "applied", "4": "closed"}
    assert {r.slug: r.content for r in mutation.apply_proposals(proposals, pages, force=True).collect()} == {"p": "x", "q": "y", "z": "z"}
    changes = spark.createDataFrame([("p", "a", 1, False), ("p", "b", 2, True), ("n", "c", 1, False)], "slug string, content string, ts int, deleted boolean")
    assert sorted(tuple(r) for r in mutation.apply_changes(pages, changes, ["slug"], "ts", "deleted").collect()) == [("n", "c"), ("q", "same")]


def test_lint(spark):
    pages = metadata.with_fields(spark.createDataFrame([("adr-1", "---\ntype: x\n---\n[[none]] s-1"), ("b", "## See also")], "slug string, content string"))
    sources = spark.createDataFrame([("s-1",), ("s-22",)], "source_id string")
    found = {(r.check, r.slug, r.target) for r in lint.lint(pages, sources, large=10).collect()}
    assert {("broken_link", "adr-1", "none"), ("missing_front_matter", "b", None), ("missing_see_also", "adr-1", None), ("raw_without_pages", "s-22", None), ("decision_without_rationale", "adr-1", None)} <= found
    assert ("raw_without_pages", "s-1", None) not in found and "## broken_link" in render.lint_text(lint.lint(pages))


def test_wiki_folder(spark, tmp_path):
    root = str(tmp_path)
    wiki.init_layout(root)
    (tmp_path / "pages/a.md").write_text("# A")
    (tmp_path / "pages/note.txt").write_text("no page")
    (tmp_path / "sources/s1").write_text("raw")
    (tmp_path / "rawindex.md").write_text("# c\n\ns1 | - | t1\ns2 | x%7Cy | t2\n | bad | t\n")
    assert [tuple(r)[:2] for r in wiki.pages(spark, root).collect()] == [("a", "# A")]
    assert [tuple(r) for r in wiki.raw_index(spark, root).orderBy("source_id").collect()] == [("s1", None, "t1"), ("s2", "x%7Cy", "t2")]
    assert wiki.read_uri(spark, root, "raw://source/s1").first().value == "raw"
    assert wiki.resources(wiki.pages(spark, root), wiki.raw_sources(spark, root)).count() == 5
    with pytest.raises(ValueError):
        wiki.guarded(root, "..", "x")
    assert wiki.read_uri(spark, root, "wiki://list").first().value == "wiki://page/a"
    with pytest.raises(ValueError):
        wiki.read_uri(spark, root, "wiki://other")


def test_writes_to_a_wiki_folder(spark, tmp_path):
    root = str(tmp_path)
    wiki.init_layout(root)
    pages = spark.createDataFrame([("a", "# A\nsee wiki://page/b."), ("b", "# B\n## Part\nold\n## Next\nx")], "slug string, content string")
    wiki.write_pages(pages, root)
    edits = spark.createDataFrame([("b", "append", "Part", "new", "why"), ("c", "overwrite", None, "text", None), ("a", "other", None, "x", None), ("b/../x", "overwrite", None, "x", "no"), ("d", "append", "Part", "x", None)], "slug string, mode string, section string, content string, rationale string")
    done = {r.slug: r for r in updates.update_pages(wiki.pages(spark, root), edits, "2025-01-02").collect()}
    assert done["b"].error is None, done["b"]
    assert "## Part\n\nold\n\nnew\n\n## Next" in done["b"].content and done["b"].log_entry == "[append section 'Part'] `b`: why"
    assert done["c"].content == '---\ncreated_at: "2025-01-02"\nupdated_at: "2025-01-02"\n---\ntext' and done["c"].is_new and done["c"].log_entry is None
    assert all(done[x].error and done[x].content is None for x in ("a", "b/../x", "d"))
    good = updates.update_pages(wiki.pages(spark, root), edits, "2025-01-02").where("error is null").select("slug", "content", "log_entry").collect()
    wiki.write_pages(spark.createDataFrame(good), root)
    wiki.append_log(root, [r.log_entry for r in good if r.log_entry], "2025-01-02T00:00:00Z")
    assert [tuple(r) for r in wiki.log(spark, root).collect()] == [("2025-01-02T00:00:00Z", "[append section 'Part'] `b`: why")]
    with pytest.raises(ValueError):
        wiki.write_pages(spark.createDataFrame([("../x", "no")], "slug string, content string"), root)
    proposals = updates.propose(wiki.pages(spark, root), edits.where("slug = 'b'"), "2025-01-03", F.lit("2025-01-03 00:00:00").cast("timestamp"))
    wiki.write_proposals(proposals, root)
    held = wiki.proposals(spark, root).first()
    assert held.proposal_id.startswith("b-20250103000000-") and held.base_page_exists and held.reason == "why"
    sources = spark.createDataFrame([("s1", "/x/a.txt", "text/plain", ["t"], "one"), ("s2", None, "text/html", [], "two")], "source_id string, original_path string, mime_type string, tags array<string>, content string")
    wiki.write_sources(sources, root, "2025-01-01")
    wiki.write_sources(sources.where("source_id = 's1'"), root, "2025-01-05")
    assert sorted(tuple(r) for r in wiki.raw_index(spark, root).collect()) == [("s1", "/x/a.txt", "2025-01-05"), ("s2", None, "2025-01-01")]
    assert {(r.source_id, r.size_bytes) for r in wiki.metadata(spark, root).collect()} == {("s1", 3), ("s2", 3)}
    wiki.delete_source(spark, root, "s1")
    assert [r.source_id for r in wiki.raw_index(spark, root).collect()] == ["s2"] and wiki.raw_sources(spark, root).count() == 1
    assert [tuple(r) for r in wiki.migrate(spark, root, dry_run=True).collect()] == [("a", 1)] and "wiki://" in (tmp_path / "pages/a.md").read_text()
    assert [tuple(r) for r in wiki.migrate(spark, root).collect()] == [("a", 1)] and (tmp_path / "pages/a.md").read_text() == "# A\nsee [[b]]."
    assert wiki.migrate(spark, root).count() == 0 and "wiki://" in (tmp_path / "backups/pages-v1/a.md").read_text()
    assert wiki.delete_page(root, "c") and not wiki.delete_page(root, "c")


def test_arguments(tmp_path):
    assert updates.pairs_of('{"a": "x", "b": 2, "c": true}') == {"a": "x", "b": "2", "c": "true"} and updates.pairs_of(" ") == {}
    for bad in ("[1]", '{"a": [1]}', "{"):
        with pytest.raises(ValueError):
            updates.pairs_of(bad)
    assert wiki.workspace("/home/Some One/x") == "-home-Some-One-x" and len(wiki.workspace("y" * 300)) == 120
    (tmp_path / "f.html").write_text("x")
    assert wiki.load(f"file://{tmp_path}/f.html") == (b"x", "text/html")


def test_large_diff_is_bounded():
    import tracemalloc

    from quillspark.functions import diffing

    old = [f"line {i}" for i in range(3000)]
    new = [f"line {i}" if i % 3 else f"other {i}" for i in range(3000)]
    tracemalloc.start()
    ops = diffing.diff(old, new)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x for m, x in ops if m != "+"] == old and [x for m, x in ops if m != "-"] == new and sum(m == "=" for m, _ in ops) == 2000
    assert peak < 12e6  # a table of 32-bit lengths alone has 36 MB


def test_search_shuffles_no_text(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([("page", f"wiki://page/p{i}", f"p{i}", f"text {i} with words") for i in range(50)], "kind string, uri string, title string, content string")
        plan = lexical.search(docs, ["with"], 5)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert [r.uri for r in search.lexical_search(docs, 'a-b "', 5).collect()] == []
        assert [r.uri for r in search.lexical_search(docs, "text-7 (", 5).collect()] == ["wiki://page/p7"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vector_files(spark, tmp_path):
    data = vectorfiles.encode(2, "m", "h", [(0, 0, 5, [1.0, 2.0]), (1, 4, 9, [3.0, 4.0])])
    assert vectorfiles.decode(data) == (2, "m", "h", [(0, 0, 5, [1.0, 2.0]), (1, 4, 9, [3.0, 4.0])])
    (tmp_path / "p.bin").write_bytes(data)
    (tmp_path / "bad.bin").write_bytes(b"nope")
    rows = vectorfiles.read(spark, str(tmp_path))
    assert sorted((r.slug, r["index"]) for r in rows.collect()) == [("p", 0), ("p", 1)]
    assert bytes(vectorfiles.encoded(rows).first().content) == data


def test_event_names(spark):
    rows = [("create", ["/w/pages/a.md"]), ("rename", ["/w/pages/a.md", "/w/pages/b.md"]), ("rename_from", ["/w/sources/s"]), ("modify", ["/w/metadata/s.json"]), ("access", ["/w/pages/a.md"]), ("modify", ["/w/.git/x"]), ("modify", ["/w/log.md"]), ("modify", ["/w/pages/.hid.md"])]
    df = spark.createDataFrame(rows, "op string, paths array<string>").withColumn("ts", F.current_timestamp())
    got = sorted((r.kind, r.key or "") for r in events.domain_events(events.split_renames(df)).collect())
    assert got == sorted([("page_created", "a"), ("page_deleted", "a"), ("page_created", "b"), ("raw_deleted", "s"), ("raw_updated", "s"), ("log_changed", ""), ("unknown", "")])


def test_jaccard_pairs_against_brute_force_for_small_and_large_sets(spark):
    """Near copies of sets on both sides of the size at which bitmaps widen, among sets that share a frequent token."""
    rng = random.Random(5)
    sets = {}
    for i in range(60):
        n = rng.choice([20, 60, similarity.LARGE - 40, similarity.LARGE + 30, 900])
        own = {f"t{rng.randrange(10**9)}" for _ in range(n)} | {"every"}
        sets[f"s{i:03}"] = own
        keep = set(rng.sample(sorted(own), round(len(own) * rng.choice([0.55, 0.62, 0.8, 1.0]))))
        sets[f"s{i:03}x"] = keep | {f"u{rng.randrange(10**9)}" for _ in range(rng.choice([0, n // 10]))}
    rows = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "k string, tokens array<string>")
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b): round(jaccard(a, b), 9) for a in sets for b in sets if a < b and jaccard(a, b) >= 0.6}
    got = similarity.jaccard_pairs(rows, "k", 0.6)
    assert {(r.a, r.b): round(r.similarity, 9) for r in got.collect()} == want and len(want) > 30
    assert similarity.hashed_sets(rows.where("k = 's000'"), "k").first().single >= len(sets["s000"]) - 10  # two may share a counter: ids that no other set has don't go to the join


def test_term_stats_meet_by_term_alone_unless_keys_repeat(spark):
    rows = [("u1", "b a b"), ("u2", "a"), ("u3", None), ("u4", "b c")]
    own = lambda more: lexical.term_stats(spark.createDataFrame(rows + more, "uri string, content string"))
    found = lambda df: sorted(tuple(r) for r in df.collect())
    assert found(own([])) == [("a", 2, 2), ("b", 2, 3), ("c", 1, 1)]
    assert own([])._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2  # partial and final, one shuffle
    assert found(own([("u1", "a c"), ("u1", "a")])) == [("a", 2, 4), ("b", 2, 3), ("c", 2, 2)]


def test_a_set_is_sent_once_for_its_copies(spark, monkeypatch):
    """Candidates of one group share cells, so that whole sets aren't sent for each pair; blocks and small cells lose no pair."""
    monkeypatch.setattr(similarity, "CELL_SETS", 4)
    monkeypatch.setattr(similarity, "CELL_PAIRS", 5)
    sets = {f"g{i:02}": {f"w{x}" for x in range(40)} | {f"own{i}"} for i in range(30)} | {f"p{i}": {f"q{i // 2}-{x}" for x in range(20 + i % 2)} for i in range(12)}
    sets["z"] = {f"w{x}" for x in range(24)}
    rows = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "k string, tokens array<string>")
    want = {(a, b): round(_jaccard(sets[a], sets[b]), 9) for a in sets for b in sets if a < b and _jaccard(sets[a], sets[b]) >= 0.55}
    got = similarity.jaccard_pairs(rows, "k", 0.55)
    assert {(r.a, r.b): round(r.similarity, 9) for r in got.collect()} == want and len(want) > 400
    assert "array_intersect" not in got._jdf.queryExecution().executedPlan().toString()


def test_page_filters_make_front_matter_once(spark):
    """The condition on fields is a column below the rows that fit; pushed into a filter, each use would make the fields anew."""
    pages = spark.createDataFrame([("b", "---\nproject: X\n---\nb"), ("a", "---\nproject: x\nsources: [s]\n---\na"), ("c", "c")], "slug string, content string")
    own = metadata.with_fields(pages)
    found = metadata.by_scalar(own, "project", "x")
    assert [r.slug for r in found.collect()] == ["a", "b"] and [r.slug for r in metadata.without_sources(own).collect()] == ["b", "c"]
    assert "Filter" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_prefix_entries_keep_their_width_for_large_sets_and_lose_no_pair(spark, monkeypatch):
    """Groups of a set's tokens bound an entry's bitmap; levels of sizes, equal sizes and slices of pairs lose no pair."""
    monkeypatch.setattr(similarity, "SLICE_PAIRS", 7)
    rng, sets = random.Random(3), {}
    for i in range(40):
        n = rng.choice([20, 60, 95, 130, 380, 500, 1500, 2500])
        own = [rng.randrange(-(2**63), 2**63) for _ in range(n)]
        sets[2 * i], sets[2 * i + 1] = {*own, 7}, {*own[: round(n * rng.choice([0.58, 0.62, 0.8, 1.0]))], 7, *(rng.randrange(2**63) for _ in range(rng.choice([0, n // 12])))}
    sets |= {100 + i: {*range(40), 1000 + i} for i in range(12)}
    ids = [sorted(s) for s in sets.values()]
    ranked = pa.RecordBatch.from_pydict({"k": list(sets), "ids": pa.array(ids, pa.list_(pa.int64())), "single": pa.array([0] * len(ids), pa.int32())})
    entries = list(similarity._entries(0.6, "k")(iter([ranked])))
    assert {b.num_columns - 4 for b in entries} == {similarity.GROUP_WORDS}
    met = [p for b in similarity._met(0.6)(iter(entries)) for p in b.to_pylist()]
    want = {(a, b) for a in sets for b in sets if a < b and _jaccard(sets[a], sets[b]) >= 0.6}
    assert want <= {(p["a"], p["b"]) for p in met} and len(want) > 80


def test_candidates_move_without_the_ids_at_which_they_met(spark):
    """Pairs may grow with the square of a group of copies: only their two keys leave a task, each pair once."""
    ranked = pa.RecordBatch.from_pydict({"k": list(range(9)), "ids": pa.array([list(range(30))] * 9, pa.list_(pa.int64())), "single": pa.array([0] * 9, pa.int32())})
    met = list(similarity._met(0.6)(similarity._entries(0.6, "k")(iter([ranked]))))
    assert {tuple(b.schema.names) for b in met} == {("a", "b")} and sum(b.num_rows for b in met) == 36
