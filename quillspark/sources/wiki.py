"""A wiki folder as DataFrames: pages, raw sources, their metadata and index, log and proposals.

Layout: ``pages/*.md``, ``sources/*``, ``metadata/*.json``, ``proposals/*.json``,
``rawindex.md`` and ``log.md``.  All reads go through Spark, so the root may lie in any store.
"""

from __future__ import annotations

import hashlib
import json
import mimetypes
import os
import re
import shutil
import urllib.request
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rewrite import rewritten
from ..functions.text import index_field, mime_of, valid_slug
from ..operators.mutation import latest

METADATA = "source_id string, original_path string, size_bytes bigint, mime_type string, extracted_at string, tags array<string>, updated_at string"
PROPOSAL = "proposal_id string, slug string, reason string, created_at string, base_page_exists boolean, base_hash string, proposed_content string, status string, applied_at string"


def _texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"))


def pages(spark: SparkSession, root: str) -> DataFrame:
    """slug, content, mtime of all Markdown pages."""
    rows = _texts(spark, f"{root}/pages", "*.md")
    return rows.select(F.regexp_extract(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), r"^(.*)\.md$", 1).alias("slug"), F.col("value").alias("content"), "mtime")


def raw_sources(spark: SparkSession, root: str) -> DataFrame:
    """source_id and content of every file in ``sources``."""
    return _texts(spark, f"{root}/sources").select(F.col("file").alias("source_id"), F.col("value").alias("content"))


def metadata(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(METADATA).option("multiLine", True).json(f"{root}/metadata")


def proposals(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(PROPOSAL).option("multiLine", True).json(f"{root}/proposals")


def parse_raw_index(lines: DataFrame) -> DataFrame:
    """source_id, original_path, extracted_at of index lines (``value``); comments and blank lines go."""
    parts = F.split(F.col("value"), r"\|", 3)
    cell = lambda i: F.trim(F.get(parts, F.lit(i)))
    kept = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    rows = kept.select(cell(0).alias("source_id"), F.nullif(F.nullif(cell(1), F.lit("-")), F.lit("")).alias("original_path"), cell(2).alias("extracted_at"))
    return rows.where("source_id <> ''")


def raw_index(spark: SparkSession, root: str) -> DataFrame:
    return parse_raw_index(spark.read.text(f"{root}/rawindex.md"))


def raw_index_lines(entries: DataFrame) -> DataFrame:
    """The index's lines: id, path or a dash, time."""
    path = F.coalesce(index_field(F.col("original_path")), F.lit("-"))
    return entries.select(F.concat_ws(" | ", index_field(F.col("source_id")), path, "extracted_at").alias("value"))


def log(spark: SparkSession, root: str) -> DataFrame:
    """time and entry of the operation log."""
    line = r"^- \*\*(.+?)\*\*: (.*)$"
    rows = spark.read.text(f"{root}/log.md").where(F.col("value").rlike(line))
    return rows.select(F.regexp_extract("value", line, 1).alias("at"), F.regexp_extract("value", line, 2).alias("entry"))


def log_lines(entries: DataFrame) -> DataFrame:
    return entries.select(F.concat(F.lit("- **"), "at", F.lit("**: "), "entry").alias("value"))


def resources(page_rows: DataFrame, source_rows: DataFrame) -> DataFrame:
    """uri, name, mime and position group of everything that can be read."""
    spark = page_rows.sparkSession
    fixed = spark.createDataFrame([("wiki://log", "log", "text/markdown", 0), ("wiki://index", "index", "text/markdown", 0)], "uri string, name string, mime string, part int")
    own = page_rows.select(F.concat(F.lit("wiki://page/"), "slug").alias("uri"), F.col("slug").alias("name"), F.lit("text/markdown").alias("mime"), F.lit(1).alias("part"))
    two = F.array(
        F.struct(F.concat(F.lit("raw://source/"), "source_id").alias("uri"), F.col("source_id").alias("name"), F.coalesce(mime_of(F.col("source_id")), F.lit("text/plain")).alias("mime")),
        F.struct(F.concat(F.lit("raw://sourcemetadata/"), "source_id").alias("uri"), F.concat("source_id", F.lit(" (metadata)")).alias("name"), F.lit("application/json").alias("mime")),
    )
    raws = source_rows.select(F.explode(two).alias("x")).select("x.*", F.lit(2).alias("part"))
    return reduce(DataFrame.unionByName, (fixed, own, raws))


def read_uri(spark: SparkSession, root: str, uri: str) -> DataFrame:
    """One column ``value`` with the text behind a URI; ValueError where nothing can be read by it."""
    if uri == "wiki://log":
        return spark.read.text(f"{root}/log.md", wholetext=True)
    if uri == "wiki://list":
        return pages(spark, root).select(F.concat(F.lit("wiki://page/"), "slug").alias("value")).orderBy("value")
    if uri in ("wiki://index", "wiki://rawindex"):
        return raw_index_lines(raw_index(spark, root))
    for prefix, rows, key in (("wiki://page/", pages, "slug"), ("raw://source/", raw_sources, "source_id")):
        if uri.startswith(prefix):
            return rows(spark, root).where(F.col(key) == uri.removeprefix(prefix)).select(F.col("content").alias("value"))
    if uri.startswith("raw://sourcemetadata/"):
        return metadata(spark, root).where(F.col("source_id") == uri.removeprefix("raw://sourcemetadata/")).select(F.to_json(F.struct("*")).alias("value"))
    raise ValueError(f"nothing to read at {uri!r}")


def guarded(root: str, *parts: str) -> str:
    """A local path under the root; ValueError for one that leads outside, also by links."""
    base = Path(root).resolve()
    path = base.joinpath(*parts)
    if not path.resolve().is_relative_to(base):
        raise ValueError(f"{os.path.join(*parts)!r} leads outside")
    return str(path)


def load_local(uri: str) -> tuple[bytes, str | None]:
    """Bytes and MIME type of a local file, by path or file URL."""
    path = uri.removeprefix("file://")
    return Path(path).read_bytes(), mimetypes.guess_type(path)[0]


def load_remote(uri: str, timeout: float = 30.0) -> tuple[bytes, str | None]:
    """Bytes and MIME type behind an http or https address."""
    if not uri.startswith(("http://", "https://")):
        raise ValueError(f"not a web address: {uri!r}")
    with urllib.request.urlopen(uri, timeout=timeout) as found:  # noqa: S310  the scheme is checked
        return found.read(), found.headers.get_content_type() or mimetypes.guess_type(uri)[0]


def load(uri: str) -> tuple[bytes, str | None]:
    """Bytes and MIME type of a source, by web address, file URL or path."""
    return load_remote(uri) if uri.startswith(("http://", "https://")) else load_local(uri)


def workspace(path: str, longest: int = 120) -> str:
    """The folder name of a workspace: a path with all but letters and digits as dashes, long ones cut and hashed."""
    slug = re.sub(r"[\W_]", "-", path)
    return slug if len(slug) <= longest else f"{slug[: longest - 33]}-{hashlib.md5(path.encode()).hexdigest()}"  # noqa: S324


def _put(path: str, text: str) -> None:
    """A file that readers see whole or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    held = f"{path}.{uuid.uuid4().hex}.part"
    Path(held).write_text(text, encoding="utf-8")
    os.replace(held, path)


def write_pages(rows: DataFrame, root: str) -> None:
    """Pages (slug, content) as files of a root that all executors can reach; a task that runs again writes the same."""
    if bad := [r.slug for r in rows.where(~valid_slug(F.col("slug"))).select("slug").limit(3).collect()]:
        raise ValueError(f"not page names: {bad}")

    def put(part) -> None:
        for r in part:
            _put(guarded(root, "pages", f"{r.slug}.md"), r.content or "")

    rows.select("slug", "content").foreachPartition(put)


def delete_page(root: str, slug: str) -> bool:
    """Whether there was such a page."""
    path = Path(guarded(root, "pages", f"{slug}.md"))
    found = path.exists()
    path.unlink(missing_ok=True)
    return found


def append_log(root: str, entries: list[str], at: str) -> None:
    """Entries of one time, each in a line of its own, at the end of the log."""
    with open(guarded(root, "log.md"), "a", encoding="utf-8") as f:
        f.writelines(f"- **{at}**: {' '.join(e.splitlines())}\n" for e in entries)


def write_sources(rows: DataFrame, root: str, at: str) -> None:
    """Raw sources (source_id, original_path, mime_type, tags, content) with their metadata files; the index gets their lines once."""

    def put(part) -> None:
        for r in part:
            meta = {"source_id": r.source_id, "original_path": r.original_path, "size_bytes": len((r.content or "").encode()), "mime_type": r.mime_type, "extracted_at": at, "tags": list(r.tags or []), "updated_at": at}
            _put(guarded(root, "sources", r.source_id), r.content or "")
            _put(guarded(root, "metadata", f"{r.source_id}.json"), json.dumps(meta, ensure_ascii=False))

    rows.foreachPartition(put)
    write_raw_index(rows.sparkSession, root, rows.select("source_id", "original_path", F.lit(at).alias("extracted_at")))


def write_raw_index(spark: SparkSession, root: str, entries: DataFrame, gone: DataFrame | None = None) -> None:
    """The index with new entries (one line a source: the last extracted) and without those that are gone."""
    held = raw_index(spark, root).unionByName(entries)
    if gone is not None:
        held = held.join(gone.select("source_id"), "source_id", "left_anti")
    lines = raw_index_lines(latest(held, ["source_id"], "extracted_at").orderBy("source_id"))
    _put(guarded(root, "rawindex.md"), "\n".join(["# id | path | extracted_at", *(r.value for r in lines.toLocalIterator())]) + "\n")


def delete_source(spark: SparkSession, root: str, source_id: str) -> None:
    """The source, its metadata and its line in the index."""
    for folder, name in (("sources", source_id), ("metadata", f"{source_id}.json")):
        Path(guarded(root, folder, name)).unlink(missing_ok=True)
    gone = spark.range(1).select(F.lit(source_id).alias("source_id"))
    write_raw_index(spark, root, raw_index(spark, root).limit(0), gone)


def write_proposals(rows: DataFrame, root: str) -> None:
    """Proposals as one JSON file each."""

    def put(part) -> None:
        for r in part:
            _put(guarded(root, "proposals", f"{r.proposal_id}.json"), json.dumps(r.asDict(), ensure_ascii=False))

    rows.foreachPartition(put)


SCHEMA_VERSION = 2


def migrate(spark: SparkSession, root: str, dry_run: bool = False) -> DataFrame:
    """Old link syntax rewritten in all pages: slug and links of those that change.

    Once done, a marker file holds the version and a later run finds nothing to do. The pages
    are copied to ``backups`` first. A dry run writes nothing.
    """
    marker = Path(guarded(root, ".schema-version"))
    done = marker.exists() and int(marker.read_text().strip() or 0) >= SCHEMA_VERSION
    rows = pages(spark, root).select("slug", "content", rewritten("content").alias("r")).where(F.lit(not done) & (F.col("r.links") > 0))
    found = spark.createDataFrame(rows.select("slug", "r.links", F.col("r.content").alias("content")).collect(), "slug string, links int, content string")  # a folder's own pages
    if not dry_run and not done:
        if os.path.isdir(f"{root}/pages"):
            shutil.copytree(f"{root}/pages", guarded(root, "backups", f"pages-v{SCHEMA_VERSION - 1}"), dirs_exist_ok=True)
        write_pages(found, root)
        _put(str(marker), f"{SCHEMA_VERSION}\n")
    return found.select("slug", "links")


def init_layout(root: str) -> None:
    """The folders and the two seed files of an empty wiki."""
    for name in ("pages", "sources", "metadata", "proposals"):
        os.makedirs(f"{root}/{name}", exist_ok=True)
    for name, text in (("log.md", "# Log\n"), ("rawindex.md", "# id | path | extracted_at\n")):
        if not os.path.exists(f"{root}/{name}"):
            Path(root, name).write_text(text)
