"""DuckDB SQL of the registered queries, written apart from the Spark plans."""

from __future__ import annotations

from .sources.tables import INDEX_SQL, WIKI_SQL

WIKI = WIKI_SQL.format(documents="documents")
INDEX = INDEX_SQL.format(documents="documents")
BLOCK = r"(?s)\A---\n(.*?)\n---(\n|\z)"
WORDS = "list_transform(list_filter(regexp_split_to_array({0}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) < 40 AND w <> ''), lambda w: lower(w))"
TOKENS = "list_distinct(list_transform(list_filter(regexp_split_to_array({0}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) >= 3), lambda w: lower(w)))"
LEGACY = "list_filter(list_transform(regexp_extract_all({0}, 'wiki://page/([A-Za-z0-9._-]*)', 1), lambda x: rtrim(x, '.')), lambda x: x <> '')"
BRACKETS = r"list_filter(list_transform(regexp_extract_all({0}, '\[\[([^\n]*?)\]\]', 1), lambda x: trim(split_part(x, '|', 1))), lambda x: regexp_full_match(x, '[A-Za-z0-9._-]*[A-Za-z0-9_-]'))"

PARSED = f"""
wiki AS ({WIKI}),
fronts AS (SELECT doc_id, slug, content, nullif(regexp_extract(content, '{BLOCK}', 1), '') AS front FROM wiki),
parsed AS (SELECT doc_id, slug, content, front, front IS NOT NULL AS has_front,
  nullif(regexp_extract(front, '(?m)^type: (.*)$', 1), '') AS type, nullif(regexp_extract(front, '(?m)^project: (.*)$', 1), '') AS project,
  nullif(regexp_extract(front, '(?m)^status: (.*)$', 1), '') AS status,
  coalesce(regexp_extract(front, '(?m)^tags: \\[(.*)\\]$', 1), '') AS tags, coalesce(regexp_extract(front, '(?m)^sources: \\[(.*)\\]$', 1), '') AS sources,
  coalesce(regexp_extract(front, '(?m)^related: \\[(.*)\\]$', 1), '') AS related FROM fronts)
"""
BODY_LINKS = f"links AS (SELECT DISTINCT slug AS src, unnest(list_concat({LEGACY.format('content')}, {BRACKETS.format('content')})) AS dst FROM wiki)"
EDGES = f"""{PARSED}, {BODY_LINKS},
edges AS (SELECT src, dst, min(kind) AS kind FROM (
  SELECT src, dst, 'body' AS kind FROM links UNION ALL SELECT slug, related, 'related' FROM parsed WHERE related <> '') WHERE src <> dst GROUP BY src, dst)
"""


def _bm25(fields: tuple[str, ...], kind: str | None, k: int, docs: str = INDEX) -> str:
    """Scores by an explicit inverted index."""
    parts = " UNION ALL ".join(f"SELECT uri, '{f}' AS field, unnest({WORDS.format(f)}) AS term FROM docs" for f in fields)
    lens = " UNION ALL ".join(f"SELECT uri, '{f}' AS field, len({WORDS.format(f)}) AS dl FROM docs" for f in fields)
    where = f"WHERE kind = '{kind}'" if kind else ""
    return f"""docs AS ({docs}), tokens AS ({parts}), lens AS ({lens}),
tf AS (SELECT uri, field, term, count(*) AS tf FROM tokens WHERE term IN ('with', 'from') GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL), av AS (SELECT field, avg(dl) AS al FROM lens GROUP BY field),
scored AS (SELECT uri, sum(ln(1 + ((SELECT count(*) FROM docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))) AS score
  FROM tf JOIN df USING (field, term) JOIN lens USING (uri, field) JOIN av USING (field) GROUP BY uri),
found AS (SELECT uri, kind, slug, score FROM scored JOIN docs USING (uri) {where} ORDER BY score DESC, uri LIMIT {k})"""


CHANGED = f"SELECT * REPLACE (CASE WHEN last_modified % 10 = 3 THEN content || ' with from with' ELSE content END AS content) FROM ({INDEX}) WHERE last_modified % 10 <> 4"
BM25 = "WITH {0} SELECT uri, kind, round(score, 6) AS score FROM found"
NORM = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
COSINE = f"list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])) / ({NORM.format('e.embedding')} * {NORM.format('q.v')})"
QUERY = "q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)"
SEMANTIC = f"""{QUERY}, chunk AS (SELECT 'doc-' || CAST(label AS STRING) AS slug, vec_id, {COSINE} AS s FROM embeddings e, q),
semantic AS (SELECT slug, max(s) AS score, arg_max(vec_id, (s, -vec_id)) AS best_index FROM chunk GROUP BY slug ORDER BY score DESC, slug LIMIT {{0}})"""
HYBRID = f"""WITH {SEMANTIC.format(30)}, {_bm25(("title", "content"), "page", 30)},
s AS (SELECT slug, score, row_number() OVER (ORDER BY score DESC, slug) - 1 AS sr FROM semantic),
l AS (SELECT slug, score, row_number() OVER (ORDER BY round(score, 9) DESC, slug) - 1 AS lr FROM found),
fused AS (SELECT slug, s.score AS ss, l.score AS ls, sr, lr, coalesce(2.0 / (60 + sr), 0) + coalesce(1.0 / (60 + lr), 0) AS rrf FROM s FULL JOIN l USING (slug)
  ORDER BY rrf DESC, sr NULLS LAST, lr NULLS LAST LIMIT 10)"""

DOC_SETS = f"sets AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)"
CLAIM_LINES = f"""wiki AS ({WIKI}),
lines AS (SELECT slug, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM wiki),
heads AS (SELECT slug, min(n) AS h FROM lines WHERE line = '## Claims' GROUP BY slug),
ends AS (SELECT l.slug, coalesce(min(n) FILTER (WHERE n > h AND starts_with(line, '#')), max(n) + 1) AS e, any_value(h) AS h FROM lines l JOIN heads USING (slug) GROUP BY l.slug),
inside AS (SELECT slug, n, line, sum(CASE WHEN starts_with(line, '- ') THEN 1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY n) AS idx FROM lines JOIN ends USING (slug) WHERE n > h AND n < e),
claims AS (SELECT slug, CAST(idx AS BIGINT) AS idx, trim(max(CASE WHEN starts_with(line, '- ') THEN substr(line, 3) END)) AS text,
  max(CASE WHEN starts_with(line, '  - Source:') THEN trim(substr(line, 12)) END) AS source,
  max(CASE WHEN starts_with(line, '  - Confidence:') THEN trim(substr(line, 16)) END) AS confidence,
  max(CASE WHEN starts_with(line, '  - Last verified:') THEN trim(substr(line, 19)) END) AS last_verified FROM inside WHERE idx > 0 GROUP BY slug, idx)"""
SESSIONS = """marked AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL {1} THEN 1 ELSE 0 END AS new FROM rows WINDOW w AS (PARTITION BY {0} ORDER BY ts)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY {0} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM marked)"""
CHANGES = """rows AS (SELECT ts, event_id, user_id, 'p' || CAST(event_id % 50 AS STRING) AS key,
  CASE event_type WHEN 'signup' THEN 'page_created' WHEN 'view' THEN 'page_updated' WHEN 'error' THEN 'page_deleted' WHEN 'purchase' THEN 'raw_updated' ELSE 'log_changed' END AS kind FROM events)"""
EVENT_SESSIONS = f"WITH rows AS (SELECT * FROM events), {SESSIONS.format('user_id', '2 HOUR')} SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, count(*) AS events FROM numbered GROUP BY user_id, session"
NAME = "regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1)"
BASE = "regexp_replace(url, '[?#].*$', '')"
MIME = f"""CASE lower(regexp_extract({BASE}, '[^/.][^/]*\\.([^./]+)$', 1)) WHEN 'md' THEN 'text/markdown' WHEN 'txt' THEN 'text/plain' WHEN 'log' THEN 'text/plain'
  WHEN 'json' THEN 'application/json' WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' WHEN 'csv' THEN 'text/csv' WHEN 'xml' THEN 'application/xml' END"""
HOST = "lower(regexp_extract({0}, '://([^/?#]+)', 1))"


def _see_also(text: str = "content") -> str:
    return " OR ".join(f"contains({text}, '{h}')" for h in ("## Veja também", "## Veja Também", "## See also", "## See Also"))


def _rationale() -> str:
    return " OR ".join(f"contains(content, '{h}')" for h in ("## Rationale", "## rationale", "## Justificativa", "## Motivação", "## Motivacao", "## Por que", "## Por quê"))


SIMILAR = """prs AS (SELECT a.k AS a, b.k AS b, len(list_intersect(a.t, b.t)) AS c, len(a.t) AS na, len(b.t) AS nb FROM sets a JOIN sets b ON a.k < b.k
  AND least(len(a.t), len(b.t)) >= {0} * greatest(len(a.t), len(b.t)) WHERE len(a.t) >= {1} AND len(b.t) >= {1}),
similars AS (SELECT a, b, c / (na + nb - c) AS s FROM prs WHERE c / (na + nb - c) >= {0})"""
# exact and fast enough for the small tables: sharing pairs by token join
JOINED = """exploded AS (SELECT k, unnest(t) AS w FROM sets), sizes AS (SELECT k, len(t) AS n FROM sets),
freq AS (SELECT w, row_number() OVER (ORDER BY count(*), w) AS r FROM exploded GROUP BY w),
ranked AS (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY r) AS p FROM exploded JOIN freq USING (w)),
heads AS (SELECT ranked.* FROM ranked JOIN sizes USING (k) WHERE n >= {1} AND p <= n - ceil({0} * n) + 1),
cand AS (SELECT DISTINCT a.k AS a, b.k AS b FROM heads a JOIN heads b ON a.w = b.w AND a.k < b.k),
similars AS (SELECT a, b, s FROM (SELECT a, b, len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) AS s
  FROM cand JOIN sets x ON x.k = a JOIN sets y ON y.k = b) WHERE s >= {0})"""

WIKI_BODY = f"regexp_replace(content, '{BLOCK}', '')"
STALE_BODY = f"CASE WHEN starts_with(content, '---') THEN {WIKI_BODY} ELSE content END"

_DATE = """updated_at: "2025-06-01"' || chr(10) || '---' || chr(10)"""
UPDATED = f"""wiki AS ({WIKI}),
base AS (SELECT doc_id, slug, content, doc_id % 5 AS k, 'New text ' || CAST(doc_id AS STRING) AS t, NOT (doc_id % 5 = 3 AND NOT contains(content, '## Claims')) AS ok FROM wiki WHERE doc_id % 5 < 4),
raw AS (SELECT *, CASE k WHEN 1 THEN content || chr(10) || chr(10) || t WHEN 3 THEN split_part(content, '## Claims', 1) || '## Claims' || chr(10) || chr(10) || t || chr(10) ELSE t END AS r FROM base),
updated AS (SELECT doc_id, k, ok, CASE WHEN k = 2 THEN 'new-' ELSE '' END || slug AS slug, CASE WHEN k <> 2 THEN md5(content) END AS base_hash,
  CASE WHEN starts_with(r, '---' || chr(10)) THEN regexp_replace(r, '\\n---\\n', chr(10) || '{_DATE})
    WHEN k = 2 THEN '---' || chr(10) || 'created_at: "2025-06-01"' || chr(10) || '{_DATE} || r ELSE '---' || chr(10) || '{_DATE} || r END AS content FROM raw)"""

_WINDOW = "substr(body, {0} + 1, 2000)"
CUT = f"""CASE WHEN contains({_WINDOW}, chr(10) || chr(10)) THEN 2001 - instr(reverse({_WINDOW}), chr(10) || chr(10)) WHEN contains({_WINDOW}, chr(10)) THEN 2001 - instr(reverse({_WINDOW}), chr(10))
  WHEN regexp_matches({_WINDOW}, '[.!?] ') THEN length(regexp_extract({_WINDOW}, '(?s)\\A(.*[.!?] )', 1)) WHEN contains({_WINDOW}, ' ') THEN 2001 - instr(reverse({_WINDOW}), ' ') ELSE 2000 END"""

#: Borders of page chunks by recursion; each step looks for the last blank line, line, sentence and word of 2000 characters.
CHUNKS = f"""plain AS (SELECT slug, regexp_replace(content, '[^\\n -~]', '?', 'g') AS content FROM ({WIKI})),
body AS (SELECT slug, {STALE_BODY} AS body FROM plain),
step AS (
  SELECT slug, body, 0 AS i, 0 AS s, CASE WHEN length(body) <= 2000 THEN length(body) ELSE {CUT.format("0")} END AS e FROM body WHERE trim(body, chr(10) || ' ') <> ''
  UNION ALL
  SELECT slug, body, i + 1, n, CASE WHEN length(body) - n <= 2000 THEN length(body) ELSE n + {CUT.format("n")} END
  FROM (SELECT *, CASE WHEN greatest(0, e - 400) > s THEN greatest(0, e - 400) ELSE e END AS n FROM step WHERE e < length(body))
), chunk AS (SELECT * FROM step)"""

PHRASE = f"WITH docs AS ({INDEX}) SELECT uri FROM docs WHERE contains(' ' || array_to_string({WORDS.format('title')}, ' ') || ' ', ' of the ') OR contains(' ' || array_to_string({WORDS.format('content')}, ' ') || ' ', ' of the ')"
MUST_NOT = f"WITH docs AS ({INDEX}), w AS (SELECT uri, {WORDS.format('title')} AS a, {WORDS.format('content')} AS b FROM docs) SELECT uri FROM w WHERE (list_contains(a, 'the') OR list_contains(b, 'the')) AND NOT list_contains(b, 'from')"

ORACLES: dict[str, str] = {
    "bm25_topk": BM25.format(_bm25(("content",), None, 20)),
    "bm25_kind_filter": BM25.format(_bm25(("content",), "raw", 20)),
    "bm25_two_field": BM25.format(_bm25(("title", "content"), None, 20)),
    "query_fallback": BM25.format(_bm25(("title", "content"), None, 20)),
    "index_search": BM25.format(_bm25(("title", "content"), None, 20)),
    "index_kind": BM25.format(_bm25(("title", "content"), "raw", 20)),
    "index_upserted": BM25.format(_bm25(("title", "content"), None, 20, CHANGED)),
    "index_compacted": BM25.format(_bm25(("title", "content"), None, 20, CHANGED)),
    "index_phrase": PHRASE,
    "index_boolean": MUST_NOT,
    "index_terms": f"WITH docs AS ({INDEX}), t AS (SELECT uri, 'title' AS field, unnest({WORDS.format('title')}) AS term FROM docs UNION ALL SELECT uri, 'content', unnest({WORDS.format('content')}) FROM docs) SELECT field, term, count(DISTINCT uri) AS df FROM t GROUP BY ALL",
    "match_all": f"SELECT uri, kind, 1.0::DOUBLE AS score FROM ({INDEX}) ORDER BY uri LIMIT 20",
    "phrase_match": PHRASE,
    "boolean_must_not": MUST_NOT,
    "term_stats": f"WITH docs AS ({INDEX}), t AS (SELECT uri, unnest({WORDS.format('content')}) AS term FROM docs) SELECT term, count(DISTINCT uri) AS df, count(*) AS cf FROM t GROUP BY term",
    "field_lengths": f"WITH docs AS ({INDEX}) SELECT 'title' AS field, uri, len({WORDS.format('title')}) AS dl FROM docs UNION ALL SELECT 'content', uri, len({WORDS.format('content')}) FROM docs",
    "snippets": f"SELECT uri, CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END AS snippet FROM ({INDEX})",
    "cosine_topk": f"WITH {QUERY} SELECT vec_id, round({COSINE}, 5) AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 20",
    "maxpool_by_label": f"WITH {SEMANTIC.format(10)} SELECT slug, round(score, 5) AS score, best_index FROM semantic",
    "semantic_mode": f"WITH {SEMANTIC.format(10)} SELECT CAST(row_number() OVER (ORDER BY score DESC, slug) AS INTEGER) AS position, slug, round(score, 5) AS score FROM semantic",
    "rrf_fusion": f"{HYBRID} SELECT slug, round(rrf, 9) AS rrf FROM fused",
    "hybrid_with_raws": f"""{HYBRID}, raws AS (WITH {_bm25(("title", "content"), "raw", 10)} SELECT slug, score FROM found)
SELECT CAST(row_number() OVER (ORDER BY rrf DESC, sr NULLS LAST, lr NULLS LAST) AS INTEGER) AS position, 'page' AS kind, slug, round(coalesce(ss, ls), 5) AS score FROM fused
UNION ALL SELECT CAST((SELECT count(*) FROM fused) + row_number() OVER (ORDER BY round(score, 9) DESC, slug) AS INTEGER), 'raw', slug, round(score, 5) FROM raws""",
    "content_hash_gate": f"WITH wiki AS ({WIKI}), b AS (SELECT doc_id, slug, {STALE_BODY} AS body FROM wiki) SELECT slug, md5(body) AS hash FROM b WHERE doc_id % 4 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0",
    "byte_embeddings": """WITH b AS (SELECT conv_id, turn, CAST('0x' || unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS INTEGER) % 16 AS dim FROM conversations),
c AS (SELECT conv_id, turn, dim, count(*) AS n FROM b GROUP BY ALL), z AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS z FROM c GROUP BY ALL)
SELECT conv_id, turn, CAST(dim AS INTEGER) AS dim, round(CAST(CAST(n / z AS FLOAT) AS DOUBLE), 4) AS value FROM c JOIN z USING (conv_id, turn)""",
    "token_sets": f"WITH {DOC_SETS} SELECT doc_id, len(t) AS tokens, list_min(t) AS first, list_max(t) AS last FROM sets",
    "distinct_tokens": f"WITH {DOC_SETS} SELECT token, count(*) AS docs FROM (SELECT unnest(t) AS token FROM sets) GROUP BY token",
    "near_duplicates": f"WITH sets AS (SELECT doc_id AS k, {TOKENS.format('text')} AS t FROM documents), {JOINED.format(0.6, 20)} SELECT a, b, round(s, 6) AS similarity FROM similars",
    "conflicting_claims": f"""WITH sets AS (SELECT ('conv-' || CAST(conv_id AS STRING), turn) AS k, {TOKENS.format('text')} AS t FROM conversations), {JOINED.format(0.25, 1)}
SELECT a[1] AS slug_a, a[2] AS idx_a, b[1] AS slug_b, b[2] AS idx_b, round(s, 6) AS similarity FROM similars ORDER BY similarity DESC, slug_a, idx_a, slug_b, idx_b LIMIT 50""",
    "link_suggestions": f"""WITH {EDGES}, sets AS (SELECT slug AS k, coalesce(lower(project), '') AS p, string_split(tags, ', ') AS g, {TOKENS.format('content')} AS t FROM parsed WHERE slug <> 'index'),
words AS (SELECT k, unnest(t) AS w FROM sets), common AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM words a JOIN words b ON a.w = b.w AND a.k < b.k GROUP BY ALL),
pairs AS (SELECT x.k AS a, y.k AS b, coalesce(c, 0) / greatest(len(x.t) + len(y.t) - coalesce(c, 0), 1) AS j, x.p = y.p AND x.p <> '' AS same, len(list_filter(list_intersect(x.g, y.g), lambda v: v <> '')) AS shared
  FROM sets x JOIN sets y ON x.k < y.k LEFT JOIN common ON a = x.k AND b = y.k)
SELECT a, b, round(j + CASE WHEN same THEN 0.15 ELSE 0 END + least(shared * 0.05, 0.2), 6) AS score FROM pairs WHERE (j > 0 OR same OR shared > 0)
AND j + CASE WHEN same THEN 0.15 ELSE 0 END + least(shared * 0.05, 0.2) >= 0.15 AND (a, b) NOT IN (SELECT (least(src, dst), greatest(src, dst)) FROM edges) ORDER BY score DESC, a, b LIMIT 20""",
    "links_legacy": f"WITH wiki AS ({WIKI}) SELECT slug, array_to_string({LEGACY.format('content')}, ',') AS links FROM wiki",
    "links_wiki": f"WITH wiki AS ({WIKI}) SELECT slug, array_to_string({BRACKETS.format('content')}, ',') AS links FROM wiki",
    "edges": f"WITH {EDGES} SELECT src, dst, kind FROM edges",
    "edge_kinds": f"WITH {EDGES} SELECT kind, count(*) AS edges FROM edges GROUP BY kind",
    "graph_summary": f"""WITH {EDGES} SELECT 'nodes' AS metric, count(*) AS value FROM wiki UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'orphans', count(*) FROM wiki WHERE slug <> 'index' AND slug NOT IN (SELECT dst FROM edges WHERE src <> 'index')
UNION ALL SELECT 'broken_links', count(*) FROM edges WHERE dst NOT IN (SELECT slug FROM wiki)""",
    "backlinks": f"WITH {EDGES} SELECT src, kind FROM edges WHERE dst = 'doc-21'",
    "orphans_graph": f"WITH {EDGES} SELECT slug FROM wiki WHERE slug <> 'index' AND slug NOT IN (SELECT dst FROM edges WHERE src <> 'index')",
    "orphans_lint": f"WITH wiki AS ({WIKI}), {BODY_LINKS} SELECT slug FROM wiki WHERE slug NOT IN (SELECT dst FROM links)",
    "broken_links_graph": f"WITH {EDGES} SELECT src, dst FROM edges WHERE dst NOT IN (SELECT slug FROM wiki)",
    "broken_links_lint": f"WITH wiki AS ({WIKI}), {BODY_LINKS} SELECT src, dst FROM links WHERE dst NOT IN (SELECT slug FROM wiki)",
    "degrees": f"WITH {EDGES} SELECT slug, (SELECT count(*) FROM edges WHERE dst = slug) AS in_degree, (SELECT count(*) FROM edges WHERE src = slug) AS out_degree FROM wiki",
    "hubs": f"WITH {EDGES}, d AS (SELECT slug, (SELECT count(*) FROM edges WHERE dst = slug) AS in_degree, (SELECT count(*) FROM edges WHERE src = slug) AS out_degree FROM wiki) SELECT * FROM d WHERE in_degree + out_degree > 0 ORDER BY in_degree + out_degree DESC, slug LIMIT 10",
    "related_pages": f"""WITH {EDGES}, o AS (SELECT dst AS slug, kind FROM edges WHERE src = 'doc-21'), i AS (SELECT src AS slug, kind FROM edges WHERE dst = 'doc-21'),
r AS (SELECT slug, CASE WHEN o.kind IS NOT NULL AND i.kind IS NOT NULL THEN 0 WHEN coalesce(o.kind, i.kind) = 'related' THEN 1 WHEN o.kind IS NOT NULL THEN 2 ELSE 3 END AS rank FROM o FULL JOIN i USING (slug))
SELECT rank, CASE rank WHEN 0 THEN 'bidirectional' WHEN 1 THEN 'declared' WHEN 2 THEN 'links-to' ELSE 'linked-from' END AS relation, slug FROM r""",
    "href_graph": f"""WITH h AS (SELECT {HOST.format('url')} AS src, unnest(regexp_extract_all(html, 'href="((?:https?:/)?/[^"?#]*)', 1)) AS u FROM pages)
SELECT src, CASE WHEN starts_with(u, '/') THEN src || u ELSE regexp_extract(u, '://(.*)$', 1) END AS dst, count(*) AS links FROM h GROUP BY ALL""",
    "front_matter_fields": f"WITH {PARSED} SELECT slug, has_front, type, project, status, replace(tags, ', ', ',') AS tags, replace(sources, ', ', ',') AS sources, replace(related, ', ', ',') AS related FROM parsed",
    "front_matter_yaml": f"WITH {PARSED} SELECT slug, type, project, status, CASE WHEN has_front THEN replace(tags, ', ', ',') END AS tags FROM parsed",
    "front_matter_strip": f"WITH wiki AS ({WIKI}) SELECT slug, md5({STALE_BODY}) AS body_md5 FROM wiki",
    "pages_by_type": f"WITH {PARSED} SELECT slug FROM parsed WHERE lower(type) = 'concept'",
    "pages_by_project": f"WITH {PARSED} SELECT slug FROM parsed WHERE lower(project) = 'src3'",
    "pages_by_tag": f"WITH {PARSED} SELECT slug FROM parsed WHERE list_contains(string_split(lower(tags), ', '), 't3')",
    "pages_without_sources": f"WITH {PARSED} SELECT slug FROM parsed WHERE NOT has_front OR sources = ''",
    "catalogue_groups": f"""WITH {PARSED} SELECT 'type' AS "grouping", coalesce(type, '(untyped)') AS name, count(*) AS pages, min(slug) AS first_slug, max(slug) AS last_slug FROM parsed GROUP BY 2
UNION ALL SELECT 'project', project, count(*), min(slug), max(slug) FROM parsed WHERE project IS NOT NULL GROUP BY 2""",
    "missing_front_matter": f"WITH {PARSED} SELECT slug FROM parsed WHERE NOT has_front",
    "large_pages": f"WITH wiki AS ({WIKI}) SELECT slug, CAST(strlen(content) AS DOUBLE) AS bytes FROM wiki WHERE strlen(content) > 10000",
    "missing_see_also": f"WITH wiki AS ({WIKI}) SELECT slug FROM wiki WHERE NOT ({_see_also()})",
    "decisions_without_rationale": f"WITH wiki AS ({WIKI}) SELECT slug FROM wiki WHERE regexp_matches(lower(slug), 'decisao|decision|adr') AND NOT ({_rationale()})",
    "stale_pages": f"WITH wiki AS ({WIKI}) SELECT slug FROM wiki WHERE doc_id % 200 < 90",
    "raw_without_pages": f"WITH wiki AS ({WIKI}), s AS (SELECT 'raw-' || CAST(range AS STRING) AS source_id FROM range(60)) SELECT source_id FROM s WHERE NOT EXISTS (SELECT 1 FROM wiki WHERE contains(content, source_id))",
    "lint_all": f"""WITH {PARSED}, {BODY_LINKS}, sets AS (SELECT slug AS k, {TOKENS.format('content')} AS t FROM wiki), {JOINED.format(0.6, 20)},
f AS (SELECT 'broken_link' AS "check", src AS slug FROM links WHERE dst NOT IN (SELECT slug FROM wiki) UNION ALL SELECT 'orphan', slug FROM wiki WHERE slug NOT IN (SELECT dst FROM links)
UNION ALL SELECT 'large_page', slug FROM wiki WHERE strlen(content) > 10000 UNION ALL SELECT 'missing_front_matter', slug FROM parsed WHERE NOT has_front
UNION ALL SELECT 'missing_see_also', slug FROM wiki WHERE NOT ({_see_also()})
UNION ALL SELECT 'raw_without_pages', 'raw-' || CAST(range AS STRING) FROM range(60) WHERE NOT EXISTS (SELECT 1 FROM wiki WHERE contains(content, 'raw-' || CAST(range AS STRING)))
UNION ALL SELECT 'decision_without_rationale', slug FROM wiki WHERE regexp_matches(lower(slug), 'decisao|decision|adr') AND NOT ({_rationale()})
UNION ALL SELECT 'similar_pages', a FROM similars)
SELECT "check", count(*) AS findings, min(slug) AS first_slug FROM f GROUP BY "check" """,
    "index_consistency": f"""WITH wiki AS ({WIKI}), held AS (SELECT CASE WHEN doc_id % 50 = 1 THEN 'gone-' ELSE '' END || slug AS slug, md5(content || CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE '' END) AS hash FROM wiki WHERE doc_id % 10 <> 4),
d AS (SELECT slug, CASE WHEN hash IS NULL THEN 'missing' WHEN content IS NULL THEN 'extra' WHEN md5(content) <> hash THEN 'stale' END AS state FROM wiki FULL JOIN held USING (slug))
SELECT slug, state FROM d WHERE state IS NOT NULL""",
    "claims_rows": f"WITH {CLAIM_LINES} SELECT slug, idx, text, source, confidence, last_verified FROM claims",
    "claims_parsed": f"WITH {CLAIM_LINES} SELECT slug, count(*) AS claims, count(source) AS sources, count(last_verified) AS verified FROM claims GROUP BY slug",
    "claims_without_source": f"WITH {CLAIM_LINES} SELECT slug, idx FROM claims WHERE source IS NULL",
    "claim_verified": f"""WITH {CLAIM_LINES} SELECT slug, idx, text, CASE WHEN idx = 1 THEN '2025-05-05' ELSE last_verified END AS last_verified FROM claims
UNION ALL SELECT slug, NULL, NULL, NULL FROM wiki WHERE slug NOT IN (SELECT slug FROM claims)""",
    "section_list": f"""WITH wiki AS ({WIKI}), parts AS (SELECT slug, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS n FROM wiki),
fronts AS (SELECT slug, CASE WHEN bool_or(n = 0 AND line = '---') THEN coalesce(min(n) FILTER (WHERE n > 0 AND line = '---'), -1) ELSE -1 END AS e FROM parts GROUP BY slug),
marked AS (SELECT slug, n, line, regexp_matches(line, '^ {{0,3}}(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(line, '^ {{0,3}}(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY n) AS fences FROM parts JOIN fronts USING (slug) WHERE n > e)
SELECT slug, CAST(n AS INTEGER) AS line, CAST(length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})', 1)) AS INTEGER) AS level, rtrim(rtrim(trim(regexp_replace(line, '^ {{0,3}}#{{1,6}}', '')), '#')) AS title
FROM marked WHERE fences % 2 = 0 AND NOT fence AND regexp_matches(line, '^ {{0,3}}#{{1,6}}([ \\t]|$)')""",
    "section_edit": f"""WITH wiki AS ({WIKI}) SELECT slug, contains(content, '## Claims') AS ok,
CASE WHEN contains(content, '## Claims') THEN md5(split_part(content, '## Claims', 1) || '## Claims' || chr(10) || chr(10) || '- none' || chr(10)) END AS replaced,
CASE WHEN contains(content, '## See also') THEN md5(replace(content, '## See also' || chr(10) || '- [[' || slug || ']]' || chr(10), '## See also' || chr(10) || chr(10) || '- [[' || slug || ']]' || chr(10) || chr(10) || '- more' || chr(10) || chr(10))) END AS extended FROM wiki""",
    "chunk_spans": "SELECT doc_id, strlen(text) AS bytes, CASE WHEN trim(text) <> '' THEN CAST(0 AS BIGINT) END AS first, CASE WHEN trim(text) <> '' THEN strlen(text) END AS last, true AS fits FROM documents",
    "diff_counts": f"""WITH wiki AS ({WIKI}), l AS (SELECT slug, regexp_extract(content, '\\n(See \\[\\[[^\\n]*)', 1) AS line FROM wiki)
SELECT slug, 2 AS added, 1 AS removed, '-' || line || chr(10) || '+Look at' || substr(line, 4) || chr(10) || '+one more line' AS changed FROM l""",
    "diff_hunks": f"""WITH wiki AS ({WIKI}), l AS (SELECT slug, len(string_split(content, chr(10))) - 1 AS n, len(string_split(split_part(content, chr(10) || 'See [[', 1), chr(10))) + 1 AS pos FROM wiki),
s AS (SELECT slug, n, pos, greatest(1, pos - 3) AS s FROM l)
SELECT slug, CASE WHEN n - pos <= 6 THEN format('@@ -{{}},{{}} +{{}},{{}} @@', s, n - s + 1, s, n - s + 2)
  ELSE format('@@ -{{}},{{}} +{{}},{{}} @@', s, pos + 4 - s, s, pos + 4 - s) || chr(10) || format('@@ -{{}},3 +{{}},4 @@', n - 2, n - 2) END AS hunks FROM s""",
    "migrate_links": f"WITH wiki AS ({WIKI}) SELECT slug, CAST(len({LEGACY.format('content')}) AS INTEGER) AS links, md5(regexp_replace(content, '(^|[^(])wiki://page/([A-Za-z0-9._-]*[A-Za-z0-9_-])', '\\1[[\\2]]', 'g')) AS content_md5 FROM wiki",
    "proposal_conflicts": "SELECT 'p-' || CAST(doc_id AS STRING) AS proposal_id, CASE WHEN doc_id % 5 = 0 THEN 'closed' WHEN doc_id % 3 = 0 THEN 'conflict' ELSE 'applied' END AS outcome FROM documents",
    "rawindex_upsert": "SELECT 'u' || CAST(user_id AS STRING) AS source_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id",
    "page_upsert": f"WITH wiki AS ({WIKI}) SELECT doc_id, slug, CASE WHEN doc_id % 10 = 3 THEN 'changed' ELSE md5(content) END AS hash FROM wiki",
    "slug_validity": f"""WITH s AS (SELECT page_id, {NAME} AS slug FROM pages) SELECT page_id, slug, regexp_full_match(slug, '[A-Za-z0-9_-]([A-Za-z0-9._-]*[A-Za-z0-9_-])?') AND NOT contains(slug, '..')
  AND NOT regexp_full_match(upper(split_part(slug, '.', 1)), 'CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]') AS valid FROM s""",
    "mime_lookup": f"SELECT page_id, {MIME} AS mime FROM pages",
    "uri_parse": """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'log' WHEN 1 THEN 'index' WHEN 2 THEN 'page' WHEN 3 THEN 'raw_source' WHEN 4 THEN 'raw_metadata' WHEN 5 THEN 'raw_sources' END AS kind,
  CASE page_id % 7 WHEN 2 THEN 'p' || CAST(page_id AS STRING) WHEN 3 THEN 's' || CAST(page_id AS STRING) WHEN 4 THEN 's' || CAST(page_id AS STRING) END AS id FROM pages""",
    "path_slug": "SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}]', '-', 'g') AS slug FROM pages",
    "event_latest_per_key": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "event_sessions": EVENT_SESSIONS,
    "stream_sessions": EVENT_SESSIONS,
    "stream_bursts": f"WITH rows AS (SELECT * FROM events), {SESSIONS.format('user_id', '2 HOUR')} SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, count(*) AS events FROM numbered GROUP BY user_id, session HAVING max(ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events)",
    "stream_maintained": "SELECT user_id, max(event_id) AS last_event FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'",
    "commit_batches": f"""WITH all_rows AS (WITH {CHANGES} SELECT * FROM rows WHERE kind <> 'log_changed'), rows AS (SELECT * FROM all_rows), {SESSIONS.format('user_id', '2 HOUR')},
d AS (SELECT user_id, session, ts, event_id, CASE kind WHEN 'page_created' THEN 'cria ' WHEN 'page_updated' THEN 'atualiza ' WHEN 'page_deleted' THEN 'remove ' ELSE 'ingere fonte ' END || key AS d FROM numbered),
firsts AS (SELECT user_id, session, d, min((ts, event_id)) AS o FROM d GROUP BY ALL),
msg AS (SELECT user_id, session, string_agg(d, ', ' ORDER BY o) AS m, count(*) AS n FROM firsts GROUP BY ALL)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, count(*) AS events, 'wiki: ' || CASE WHEN length(any_value(m)) <= 60 THEN any_value(m) ELSE CAST(any_value(n) AS STRING) || ' alterações' END AS message
FROM d JOIN msg USING (user_id, session) GROUP BY user_id, session""",
    "event_rename_split": """WITH f AS (SELECT 'p' || CAST(event_id % 50 AS STRING) AS a, 'p' || CAST(event_id % 70 AS STRING) AS b, event_type AS t FROM events),
k AS (SELECT 'page_deleted' AS kind, a AS key FROM f WHERE t IN ('view', 'error') UNION ALL SELECT 'page_created', b FROM f WHERE t = 'view' UNION ALL SELECT 'page_created', a FROM f WHERE t = 'signup' UNION ALL SELECT 'page_updated', a FROM f WHERE t = 'purchase')
SELECT kind, key, count(*) AS events FROM k GROUP BY ALL""",
    "dirty_index_bursts": f"WITH all_rows AS (WITH {CHANGES} SELECT *, 1 AS one FROM rows WHERE kind LIKE 'page_%'), rows AS (SELECT * FROM all_rows), {SESSIONS.format('one', '30 MINUTE')} SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, count(*) AS events FROM numbered GROUP BY session",
    "page_updates": f"""WITH {UPDATED} SELECT slug, CASE WHEN ok THEN md5(content) END AS content_md5, ok, k = 2 AS is_new,
CASE WHEN ok AND doc_id % 2 = 0 THEN '[' || CASE k WHEN 0 THEN 'overwrite' WHEN 3 THEN 'overwrite section ''Claims''' ELSE 'append' END || '] `' || slug || '`: because' END AS log_entry FROM updated""",
    "page_proposals": f"""WITH {UPDATED} SELECT slug || '-20250601120000-' || substr(md5(slug || ':1748779200000000000'), 1, 6) AS proposal_id, slug, CASE WHEN doc_id % 2 = 0 THEN 'because' END AS reason,
base_hash IS NOT NULL AS base_page_exists, base_hash, 'pending' AS status FROM updated WHERE ok""",
    "metadata_edits": f"WITH {PARSED} SELECT slug, type, 'done' AS status, CASE WHEN has_front THEN split_part(tags, ', ', 2) || ',new' ELSE 'new' END AS tags FROM parsed",
    "page_chunks": f"WITH RECURSIVE {CHUNKS} SELECT slug, i AS index, s AS start, e AS end FROM chunk",
    "semantic_snippets": f"""WITH RECURSIVE {CHUNKS}, piece AS (SELECT slug, i, substr(body, s + 1, e - s) AS t FROM chunk),
letters AS (SELECT slug, i, unnest(string_split(t, '')) AS c FROM piece), dims AS (SELECT slug, i, ascii(c) % 16 AS d, count(*) AS n FROM letters GROUP BY ALL),
asked AS (SELECT ascii(c) % 16 AS d, count(*) AS n FROM (SELECT unnest(string_split('with from', '')) AS c) GROUP BY ALL),
scored AS (SELECT slug, i, sum(x.n * coalesce(q.n, 0)) / sqrt(sum(x.n * x.n)) / (SELECT sqrt(sum(n * n)) FROM asked) AS score FROM dims x LEFT JOIN asked q USING (d) GROUP BY slug, i),
best AS (SELECT slug, max(score) AS score, arg_max(i, (round(score, 6), -i)) AS i FROM scored GROUP BY slug ORDER BY score DESC, slug LIMIT 10)
SELECT slug, round(score, 5) AS score, md5(t) AS snippet_md5 FROM best JOIN piece USING (slug, i)""",
    "embedding_upkeep": f"""WITH wiki AS ({WIKI}), now AS (SELECT slug, CASE WHEN doc_id % 5 < 3 AND doc_id % 3 = 0 THEN content || 'more' || chr(10) ELSE content END AS content FROM wiki WHERE doc_id % 5 <> 1),
b AS (SELECT slug, {STALE_BODY} AS body FROM now) SELECT slug, md5(body) AS body_hash, 'bytes-16' AS model, 0 AS first, strlen(body) AS last, true AS whole FROM b WHERE trim(body, chr(10) || ' ') <> ''""",
    "ingest_sources": f"""WITH kept AS (SELECT url, arg_max(html, page_id) AS html, max(page_id) AS page_id FROM pages WHERE url IS NOT NULL GROUP BY url)
SELECT md5(url) AS source_id, coalesce({MIME}, 'text/html') AS mime_type, strlen(html) AS size_bytes FROM kept WHERE page_id % 5 <> 0""",
}
