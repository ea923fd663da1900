"""Input tables, and a wiki made from the documents table by plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slug(number: str) -> str:
    return f"(CASE ({number}) % 10 WHEN 0 THEN 'decision-' ELSE 'doc-' END || CAST(({number}) AS STRING))"


#: One text for both engines; ``{documents}`` is the table.
WIKI_SQL = f"""
SELECT doc_id, lang, source, text, slug,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE '---' || chr(10)
    || 'type: ' || CASE doc_id % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'note' ELSE 'Concept' END || chr(10)
    || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'project: ' || source || chr(10) END
    || 'status: ' || CASE WHEN doc_id % 5 = 0 THEN 'draft' ELSE 'active' END || chr(10)
    || 'tags: [' || lang || ', T' || CAST(doc_id % 7 AS STRING) || ']' || chr(10)
    || CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'sources: [raw-' || CAST(doc_id % 50 AS STRING) || ']' || chr(10) END
    || 'related: [' || rel || ']' || chr(10) || '---' || chr(10) END
  || '# ' || slug || chr(10) || text || chr(10)
  || 'See [[' || wl || '|alias]] and wiki://page/' || ll || '.' || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN '## See also' || chr(10) || '- [[' || slug || ']]' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 20 = 0 THEN '## Rationale' || chr(10) || 'Because.' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 8 = 1 THEN '' ELSE '## Claims' || chr(10)
    || '- ' || replace(substr(text, 1, 60), chr(10), ' ') || chr(10)
    || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '  - Source: raw-' || CAST(doc_id % 50 AS STRING) || chr(10) END
    || '  - Confidence: ' || CASE WHEN doc_id % 2 = 0 THEN 'high' ELSE 'low' END || chr(10)
    || '- Second claim of ' || slug || chr(10) || '  - Last verified: 2024-01-0' || CAST(1 + doc_id % 9 AS STRING) || chr(10) END AS content
FROM (SELECT doc_id, lang, source, text, {_slug("doc_id")} AS slug, {_slug("(doc_id * 5) % (n + 100)")} AS rel,
        {_slug("CASE WHEN doc_id % 4 = 1 THEN 0 ELSE (doc_id * 7) % (n + 50) END")} AS wl, {_slug("CASE WHEN doc_id % 4 = 1 THEN 0 ELSE (doc_id * 3) % n END")} AS ll
      FROM (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, (SELECT count(*) FROM {{documents}}) AS n FROM {{documents}}) d) w
"""


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug and content of the made pages, with what they were made from."""
    return spark.sql(WIKI_SQL, documents=table(spark, sf_dir, "documents"))


#: Documents as index entries: two of three are pages, the rest raw sources.
INDEX_SQL = """
SELECT CASE WHEN doc_id % 3 = 0 THEN 'raw' ELSE 'page' END AS kind,
  CASE WHEN doc_id % 3 = 0 THEN 'raw://source/doc-' ELSE 'wiki://page/doc-' END || CAST(doc_id AS STRING) AS uri,
  'doc-' || CAST(doc_id AS STRING) AS slug, source || ' ' || lang || ' with ' || CAST(doc_id AS STRING) AS title, text AS content, doc_id AS last_modified
FROM {documents}
"""


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(INDEX_SQL, documents=table(spark, sf_dir, "documents"))
