"""Chat prefix trees, spelling variants and source divergence against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import chat, divergence, queries, spelling

CONV = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def vocabulary():
    path, pattern = queries._vocabulary("byte_bpe_multi_50k.tiktoken")
    return Path(path).read_bytes(), pattern


@pytest.fixture
def many_ranges(spark):
    """Small range partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


# --- chat -------------------------------------------------------------------------------------


@given(st.text(alphabet="<|\\>a\nim_end", max_size=30))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible(text):
    assert chat.unescaped(chat.escaped(text)) == text
    assert "<|" not in chat.escaped(text)
    assert chat.unescaped_role(chat.escaped_role(text)) == text
    assert "\n" not in chat.escaped_role(text) and "<|" not in chat.escaped_role(text)


def _conversations(rng, n):
    """Few different turns, so that many first turns are shared; copies and prefixes of others among them."""
    rows = []
    for c in range(n):
        turns = [(("user", "assistant")[i % 2], rng.choice(["yes", "no <|im_end|>", "", None])) for i in range(rng.randint(1, 7))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return rows


def test_tree_holds_each_shared_turn_once(spark, vocabulary, many_ranges):
    rows = _conversations(random.Random(3), 150)
    nodes, convs = chat.tree(spark.createDataFrame(rows, CONV).repartition(5), *vocabulary)
    nodes = sorted((r.asDict(recursive=True) for r in nodes.collect()), key=lambda r: r["start"])
    codec = chat.Codec(*vocabulary)
    whole = defaultdict(list)
    for c, _, role, text in rows:
        whole[c].append((role, text or ""))
    prefixes = {tuple(t[: i + 1]) for t in whole.values() for i in range(len(t))}
    assert len(nodes) == len(prefixes)
    stream, told = [], {}
    for node in nodes:
        assert node["start"] == len(stream)
        stream += node["token_ids"]
        seen = [i for a in node["attends"] for i in range(a["start"], a["end"])]
        assert seen == sorted(seen) and all(b["start"] >= a["end"] for a, b in zip(node["attends"], node["attends"][1:], strict=False))
        before = [stream[i] for i in seen]
        assert node["position_ids"] == list(range(len(before), len(before) + len(node["token_ids"])))
        told[node["start"]] = codec.text(before + node["token_ids"])
        assert len(node["loss"]) == len(node["token_ids"])
    said = lambda turns: "".join(f"<|im_start|>{chat.escaped_role(r)}\n{chat.escaped(t)}<|im_end|>\n" for r, t in turns)
    assert sorted(told.values()) == sorted(said(p) for p in prefixes)
    # depth first: what a node's descendants hold stands in one piece behind it
    order = [told[n["start"]] for n in nodes]
    for i, text in enumerate(order):
        below = [j for j, other in enumerate(order) if other.startswith(text)]
        assert below == list(range(i, i + len(below)))
    found = {r.conv_id: (r.n_turns, [(a.start, a.end) for a in r.runs]) for r in convs.collect()}
    assert set(found) == set(whole)
    for c, (n, runs) in found.items():
        assert n == len(whole[c])
        assert codec.text([t for a, b in runs for t in stream[a:b]]) == said(whole[c])


def test_chat_digests_and_odd_rows(spark, vocabulary, many_ranges):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 0, "assistant", "a\n<\\|b"), (None, 1, "as\nsist", "x" * 70_000), (2, 5, "assistant", ""), (3, 5, "assistant", "")]
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 as path", "'x' as leaf", "2 as start")
    found = {r.conv_id: r for r in chat.digests(*chat.tree(chat.with_control_texts(df), *vocabulary), *vocabulary).collect()}
    assert set(found) == {1, None, 2, 3, -1}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found[1].n_turns == 3 and found[1].turns_sha256 == sha("\n\nuser\nhi\nuser\nhi\n")
    assert found[None].turns_sha256 == sha("assistant\na\n<\\|b\nas\nsist\n" + "x" * 70_000 + "\n")
    assert (found[None].loss_chars, found[None].loss_sha256) == (6, sha("a\n<\\|b"))
    assert found[2].loss_chars == 0 and found[2].loss_sha256 == sha("") and found[3].turns_sha256 == found[2].turns_sha256
    said = "<|im_end|><|im_start|>assistant ok"
    assert found[-1].loss_sha256 == sha(said) and found[-1].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n")
    assert found[-1].formatted_chars == sum(len(f"<|im_start|>{r}\n{said}<|im_end|>\n") + 2 for r in ("user", "assistant"))
    empty = spark.createDataFrame([], CONV)
    assert chat.digests(*chat.tree(empty, *vocabulary), *vocabulary).count() == 0


# --- spelling ---------------------------------------------------------------------------------


def _brute_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    n = {w: c for w, c in counts.items() if c >= 2}

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in n if apart(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def _spelling_rows():
    rng = random.Random(5)
    base = ["Analysis", "façades", "Ünderworld", "zzzzzzz", "letters÷on"]
    rows = []
    for i in range(1500):
        w = rng.choice(base)
        if rng.random() < 0.1:
            at = rng.randrange(len(w))
            w = w[:at] + rng.choice(["", "a", "é", "zz", w[at] * 2]) + w[at + 1 :]
        rows.append((i % 300 if i % 11 else None, f"{w} short {w.upper()}, x{'y' * (i % 3)}"))
    long = "ab" * 3000
    return [*rows, (1, None), (2, ""), (7, long + " " + long), (8, long[:-1]), (9, long[:-1])]


@pytest.mark.parametrize("part_words", [spelling.PART_WORDS, 13])
def test_variants_equal_brute_force(spark, monkeypatch, part_words):
    monkeypatch.setattr(spelling.near_words, "__defaults__", (part_words,))
    rows = _spelling_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as near").repartition(3)
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}
    assert found == _brute_variants(rows)
    assert any(v[0] for v in found.values())


def test_variants_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op12_spelling_variants(spark, data).collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    some = set(random.Random(1).sample(sorted(found), 400))
    n = Counter({w: v[2] for w, v in found.items()})
    for w in some:  # counts of near words by definition, over the whole vocabulary
        near = [x for x in n if abs(len(x) - len(w)) <= 1 and x != w and _one_edit(w, x)]
        assert found[w][3] == len(near)
    assert sum(n.values()) > 0 and len(rows) == docs.count()
    assert spelling.variants(docs.limit(0)).count() == 0


def _one_edit(a, b):
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return (len(a) == len(b) and a[i + 1 :] == b[i + 1 :]) or (len(a) > len(b) and a[i + 1 :] == b[i:]) or (len(a) < len(b) and a[i:] == b[i + 1 :])


# --- divergence -------------------------------------------------------------------------------


def _brute_audit(rows, min_docs, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = [low(t) for t in term.findall(text or "")]
        groups[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        own = {s: c for (g, s), c in groups.items() if g == lang}

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 5)) // (total + 5 * len(kept)) for t in kept}

        q = share(sum(own.values(), Counter()))
        p = {s: share(c) for s, c in own.items()}
        for s in own:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s))
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            over = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(over)}
    return out


@pytest.mark.parametrize("block_terms, cells, held", [(2048, 1 << 21, 400_000), (3, 20, 5)])
def test_audit_equals_brute_force(spark, monkeypatch, block_terms, cells, held):
    for name, value in (("BLOCK_TERMS", block_terms), ("TILE_CELLS", cells), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(11)
    words = ["alpha", "Beta", "ÉTÉ", "été", "日本", "x", "don", "gamma", "ß", "z" * 200]
    rows = [(i, None if i % 37 == 0 else " ".join(rng.choices(words, range(1, 11), k=rng.randint(0, 12))) + " it's 4u", rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", None])) for i in range(400)]
    rows += [(500, "", "xx", "one"), (501, None, "xx", "two"), (501, None, "xx", "two"), (502, "lonely", "yy", "one")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as term", "2 as n", "3 as counts", "4 as kept", "5 as block").repartition(4)
    found = [tuple(r) for r in divergence.audit(df, min_docs=20, top=4).collect()]
    assert len(found) == len(set(found)) and set(found) == _brute_audit(rows, 20, 4)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits():
    counts, total = np.array([[0, 7, 10**13, 123_456_789_012]]), np.array([10**13 + 123_456_789_019])
    kept = 4
    want = [1 + (10**9 * (int(c) + 5)) // (int(total[0]) + 5 * kept) for c in counts[0]]
    assert divergence.shares(counts, total, kept)[0].tolist() == want


@pytest.mark.parametrize("name", ["op11_chat_prefix_tree", "op13_source_divergence"])
def test_queries_equal_their_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    found = queries.queries()[name](spark, data)
    want = con.sql(queries.oracle_sql()[name])
    names = sorted(found.columns)
    assert names == sorted(want.columns)
    rows = lambda it: sorted(map(repr, it))
    assert rows(tuple(r[n] for n in names) for r in found.collect()) == rows(want.project(", ".join(f'"{n}"' for n in names)).fetchall())
