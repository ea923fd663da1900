"""Front matter: a YAML block between dashes at the top of a page.

``block``, ``body`` and the scalar and list fields are column expressions.  ``parsed`` reads
any YAML with the full type rules in an Arrow batch function; edits keep other lines.
"""

from __future__ import annotations

import re

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import row_function, struct_of

SCALARS = ("type", "project", "status", "created_at", "updated_at", "confidence", "owner")
LISTS = ("sources", "related", "tags")
DATES = ("created_at", "updated_at")
SCHEMA = struct_of(**{s: T.StringType() for s in SCALARS}, **{x: T.ArrayType(T.StringType()) for x in LISTS})
_BLOCK = re.compile(r"\A---\n(.*?)\n---(?:\n|\Z)", re.S)
_KEY = re.compile(r"[\w-]+:")


class _Loader(yaml.SafeLoader):
    """Safe YAML whose only implicit types are null, numbers and true or false."""


_Loader.yaml_implicit_resolvers = {
    first: [(tag, rx) for tag, rx in found if tag.rpartition(":")[2] in ("null", "int", "float", "merge")]
    for first, found in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


# --- column expressions ---------------------------------------------------------------------


def block(content: Column) -> Column:
    """The text between the dashes, or null where it doesn't look like a mapping."""
    inner = F.when(content.startswith("---\n"), F.nullif(F.regexp_extract(content, r"(?s)\A---\n(.*?)\n---(\n|\z)", 1), F.lit("")))
    lines = F.split(inner, "\n")
    key = lambda x: x.rlike(r"^[A-Za-z0-9_\-]+:")
    fits = F.forall(lines, lambda x: (F.trim(x) == "") | key(x) | x.rlike(r"^[- \t]")) & F.exists(lines, key) & ~F.exists(lines, lambda x: x.startswith("#"))
    return F.when(fits, inner)


def body(content: Column) -> Column:
    """The page without its front matter."""
    return F.when(block(content).isNull(), content).otherwise(F.substring(content, F.length(F.regexp_extract(content, r"(?s)\A---\n.*?\n---(\n|\z)", 0)) + F.lit(1), F.length(content)))


def scalar(front: Column, name: str) -> Column:
    """A scalar field of a block, without quotes."""
    value = F.regexp_extract(front, rf"(?m)^{name}:[ \t]+(.*?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(value, "^\"(.*)\"$|^'(.*)'$", "$1$2"), F.lit(""))


def list_field(front: Column, name: str) -> Column:
    """A list field in flow or block form; never null."""
    flow = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\[(.*)\][ \t]*$", 1)
    lines = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*- .*\n?)+)", 1)
    items = F.concat(F.split(flow, ","), F.transform(F.split(lines, "\n"), lambda x: F.regexp_replace(x, r"^[ \t]*- ", "")))
    plain = F.transform(items, lambda x: F.regexp_replace(F.trim(x), "^\"(.*)\"$|^'(.*)'$", "$1$2"))
    return F.coalesce(F.filter(plain, lambda x: x != ""), F.array().cast("array<string>"))


def fields(content: Column) -> Column:
    """The typed view of plain front matter, or null."""
    front = block(content)
    return F.when(front.isNotNull(), F.struct(*[scalar(front, s).alias(s) for s in SCALARS], *[list_field(front, x).alias(x) for x in LISTS]))


# --- whole YAML, and edits ------------------------------------------------------------------


def split_page(content: str) -> tuple[str | None, str]:
    """Block and body; block is None without front matter."""
    m = _BLOCK.match(content or "")
    if not m or not _mapping_like(m[1]):
        return None, content
    return m[1], content[m.end() :]


def _mapping_like(text: str) -> bool:
    lines = text.split("\n")
    keys = [bool(_KEY.match(x)) for x in lines]
    return bool(text.strip()) and not any(x.startswith("#") for x in lines) and any(keys) and all(k or not x.strip() or x[0] in "- \t" for k, x in zip(keys, lines, strict=True))


def parse_page(content: str | None) -> dict | None:
    """Typed fields; None if there is no front matter or any value has the wrong type."""
    front, _ = split_page(content or "")
    if front is None:
        return None
    try:
        found = yaml.load(front, _Loader)  # noqa: S506  a safe loader
    except yaml.YAMLError:
        return None
    if not isinstance(found, dict):
        return None
    out: dict = {}
    for name in SCALARS:
        value = found.get(name)
        if value is not None and not isinstance(value, str):
            return None
        out[name] = value
    for name in LISTS:
        value = found[name] if name in found else []
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            return None
        out[name] = value
    return out


@row_function(SCHEMA)
def parsed(content: str | None) -> dict:
    """``parse_page`` of a column; all fields null where it gives None."""
    return parse_page(content) or dict.fromkeys((*SCALARS, *LISTS))


def apply_metadata(content: str, set_fields: dict[str, str] | None = None, add: dict[str, list[str]] | None = None, remove: dict[str, list[str]] | None = None) -> str:
    """Set scalars, then add to lists, then remove from lists; unknown keys stay, an emptied list or mapping goes."""
    set_fields, add, remove = set_fields or {}, add or {}, remove or {}
    if bad := [k for k in (*set_fields, *add, *remove) if k in DATES]:
        raise ValueError(f"{bad[0]} is kept by the engine")
    front, rest = split_page(content)
    found = dict(yaml.load(front, _Loader) or {}) if front is not None else {}  # noqa: S506
    found.update(set_fields)
    for key, values in add.items():
        own = found.get(key) or []
        if not isinstance(own, list):
            raise ValueError(f"{key} is not a list")
        found[key] = own + [v for i, v in enumerate(values) if v not in own and v not in values[:i]]
    for key, values in remove.items():
        own = found.get(key)
        if own is None:
            continue
        if not isinstance(own, list):
            raise ValueError(f"{key} is not a list")
        left = [x for x in own if x not in values]
        found.pop(key) if not left else found.__setitem__(key, left)
    if not found:
        return rest
    return "---\n" + yaml.safe_dump(found, sort_keys=False, allow_unicode=True, width=1 << 20) + "---\n" + rest


def with_dates(content: str, date: str, is_new: bool) -> str:
    """updated_at always, created_at for a new page that lacks it; other lines stay as they are."""
    front, rest = split_page(content)
    lines = front.split("\n") if front is not None else []
    at = lambda key: next((i for i, x in enumerate(lines) if re.match(rf"{key}:(?:[ \t]|$)", x)), None)
    if is_new and at("created_at") is None:
        lines.append(f'created_at: "{date}"')
    if (i := at("updated_at")) is None:
        lines.append(f'updated_at: "{date}"')
    else:
        lines[i] = f'updated_at: "{date}"'
    return "---\n" + "\n".join(lines) + "\n---\n" + (rest if front is not None else content)
