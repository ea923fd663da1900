"""Column expressions for tokens, links, names and identifiers; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_PREFIX = "wiki://page/"
ALNUM = r"[^\p{IsAlphabetic}\p{N}]+"
#: Device names that no page may have.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
#: MIME types by extension.
MIME = {"md": "text/markdown", "txt": "text/plain", "log": "text/plain", "json": "application/json", "html": "text/html", "htm": "text/html", "csv": "text/csv", "xml": "application/xml"}
#: Characters of the search grammar.
QUERY_SIGNS = "+-&|!(){}[]^\"~*?:\\/"


def similarity_tokens(text: Column) -> Column:
    """Distinct lower-cased words of at least 3 bytes."""
    return F.array_distinct(F.transform(F.filter(F.split(text, ALNUM), lambda w: F.octet_length(w) >= 3), F.lower))


def search_terms(text: Column) -> Column:
    """Terms of the search analyser, in order: lower-cased words below 40 bytes."""
    return F.transform(F.filter(F.split(text, ALNUM), lambda w: (F.octet_length(w) < 40) & (w != "")), F.lower)


def title_of(slug: Column) -> Column:
    return F.replace(slug, F.lit("-"), F.lit(" "))


def snippet(text: Column, chars: int = 300) -> Column:
    """The first characters, with dots only where something is cut."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def valid_target(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9._-]*[A-Za-z0-9_-]$")


def legacy_links(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"wiki://page/([A-Za-z0-9._-]*)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"\.+$", "")), lambda x: x != "")


def wiki_links(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\n]*?)\]\]"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(F.get(F.split(x, r"\|"), F.lit(0)))), valid_target)


def links(text: Column) -> Column:
    """Distinct link targets of both syntaxes, sorted."""
    return F.array_sort(F.array_distinct(F.concat(legacy_links(text), wiki_links(text))))


def valid_slug(slug: Column) -> Column:
    shape = slug.rlike(r"^[A-Za-z0-9_-]([A-Za-z0-9._-]*[A-Za-z0-9_-])?$")
    return shape & ~F.contains(slug, F.lit("..")) & ~F.upper(F.substring_index(slug, ".", 1)).isin(RESERVED)


def page_slug(name: Column) -> Column:
    """A slug or page URI as slug."""
    return F.regexp_replace(name, f"^{PAGE_PREFIX}", "")


def index_field(text: Column) -> Column:
    """A field of the raw index: one line without the separator."""
    return F.replace(F.regexp_replace(text, r"[\r\n]", " "), F.lit("|"), F.lit("%7C"))


def path_slug(path: Column, longest: int = 120) -> Column:
    """A path as directory name; long ones keep their head and get a hash."""
    slug = F.regexp_replace(path, r"[^\p{IsAlphabetic}\p{N}]", "-")
    return F.when(F.length(slug) > longest, F.concat(F.substring(slug, 1, longest - 33), F.lit("-"), F.md5(path))).otherwise(slug)


def mime_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name, mime in MIME.items():
        out = F.when(ext == name, mime).otherwise(out)
    return out


def uri_kind(uri: Column) -> Column:
    """kind and id of a logical URI, null where it is none."""
    exact = {"wiki://log": "log", "wiki://index": "index", "wiki://list": "list", "wiki://rawindex": "rawindex", "raw://sources": "raw_sources"}
    made = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("id"))
    out = F.lit(None).cast("struct<kind:string,id:string>")
    for prefix, kind in ((PAGE_PREFIX, "page"), ("raw://sourcemetadata/", "raw_metadata"), ("raw://source/", "raw_source")):
        out = F.when(uri.startswith(prefix), made(kind, F.substring(uri, len(prefix) + 1, 1 << 30))).otherwise(out)
    for value, kind in exact.items():
        out = F.when(uri == value, made(kind, F.lit(None))).otherwise(out)
    return out


def commit_description(kind: Column, key: Column) -> Column:
    """What a change event says in a commit message; null where it isn't content."""
    verbs = {"page_created": "cria ", "page_updated": "atualiza ", "page_deleted": "remove ", "raw_updated": "ingere fonte ", "raw_deleted": "remove fonte "}
    out = F.lit(None).cast("string")
    for name, verb in verbs.items():
        out = F.when(kind == name, F.concat(F.lit(verb), key)).otherwise(out)
    return out


def commit_message(parts: Column, number: Column | None = None) -> Column:
    """Distinct descriptions in order, or their number where that gets long; ``number`` where parts are only the first of them."""
    own = F.array_distinct(parts)
    n = F.size(own) if number is None else number
    text = F.array_join(own, ", ")
    return F.when((F.length(text) <= 60) & (n == F.size(own)), F.concat(F.lit("wiki: "), text)).otherwise(F.concat(F.lit("wiki: "), n.cast("string"), F.lit(" alterações")))


def proposal_id(slug: Column, at: Column) -> Column:
    nanos = (F.unix_micros(at) * 1000).cast("string")
    return F.concat_ws("-", slug, F.date_format(at, "yyyyMMddHHmmss"), F.substring(F.md5(F.concat(slug, F.lit(":"), nanos)), 1, 6))


def escaped_query(query: str) -> str:
    """A query text whose signs are plain characters."""
    return "".join("\\" + c if c in QUERY_SIGNS else c for c in query)
