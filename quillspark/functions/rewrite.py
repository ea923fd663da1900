"""Rewriting of old link syntax to double brackets, outside front matter, code blocks and inline code."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from . import row_function, struct_of
from .frontmatter import split_page

NAME = r"[A-Za-z0-9._-]*[A-Za-z0-9_-]"
# one pass over a line, the first alternative that fits wins
_LINK = re.compile(
    r"(?P<done>\[\[[^\n]*?\]\])"
    rf"|\[(?P<text>[^\[\]\n]*)\]\(wiki://page/(?P<named>{NAME})\)"
    rf"|`wiki://page/(?P<coded>{NAME})`"
    r"|(?P<code>`[^`\n]*`)"
    rf"|(?<!\()wiki://page/(?P<bare>{NAME})"
)


def _one(m: re.Match) -> str:
    if m["named"]:
        alias = m["text"].strip()
        if not alias or alias.strip("`") == m["named"]:
            return f"[[{m['named']}]]"
        return f"[[{m['named']}|{alias.replace('|', chr(92) + '|')}]]"
    if name := m["coded"] or m["bare"]:
        return f"[[{name}]]"
    return m[0]


def rewrite_line(line: str) -> tuple[str, int]:
    count = sum(m["done"] is None and m["code"] is None for m in _LINK.finditer(line))
    return (_LINK.sub(_one, line), count) if count else (line, 0)


def rewrite_page(content: str) -> tuple[str, int]:
    """The page in new syntax, and how many links changed; a second run changes nothing."""
    front, body = split_page(content)
    head = content[: len(content) - len(body)] if front is not None else ""
    out, total, fenced = [], 0, False
    for line in re.split(r"(?<=\n)", body):
        mark = line.lstrip().startswith("```")
        fenced ^= mark
        new, n = (line, 0) if mark or fenced else rewrite_line(line)
        out.append(new)
        total += n
    return head + "".join(out), total


@row_function(struct_of(content=T.StringType(), links=T.IntegerType()))
def rewritten(content: str | None) -> dict:
    return dict(zip(("content", "links"), rewrite_page(content or ""), strict=True))
