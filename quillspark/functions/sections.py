"""Sections of Markdown pages: headings outside front matter and code fences, and edits of one section."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from . import row_function, struct_of

HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*))?$")
FENCE = re.compile(r" {0,3}(```|~~~)")


def heading(line: str) -> tuple[int, str] | None:
    """Level and title of a heading line."""
    m = HEADING.match(line.rstrip("\r\n"))
    if not m:
        return None
    return len(m[1]), (m[2] or "").strip().rstrip("#").rstrip()


def scan(content: str) -> list[tuple[int, int, str]]:
    """(line, level, title) of all headings."""
    lines = content.split("\n")
    begin = 0
    if lines[0].rstrip("\r") == "---":
        begin = next((i + 1 for i, x in enumerate(lines[1:], 1) if x.rstrip("\r") == "---"), 0)
    found, fence = [], None
    for i, line in enumerate(lines[begin:], begin):
        mark = FENCE.match(line)
        if mark and fence in (None, mark[1]):
            fence = mark[1] if fence is None else None
        elif fence is None and (h := heading(line)):
            found.append((i, *h))
    return found


def _trimmed(text: str, eol: str) -> str:
    lines = text.replace("\r\n", "\n").split("\n")
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    return eol.join(lines)


def edit(content: str, title: str, new: str, append: bool = False) -> str:
    """Replace or extend one section's body; all else stays byte for byte.  ValueError without exactly one such section."""
    wanted = title.strip().lstrip("#").strip()
    if not wanted:
        raise ValueError("a section needs a title")
    headings = scan(content)
    matching = [h for h in headings if h[2].lower() == wanted.lower()]
    if len(matching) != 1:
        names = ", ".join(repr(h[2]) for h in headings) or "none"
        raise ValueError(f"{len(matching)} sections are called {wanted!r} (sections: {names})")
    line, level, _ = matching[0]
    lines = re.findall(r"[^\n]*\n|[^\n]+", content)  # only line feeds end lines, as in scan
    end = min((h[0] for h in headings if h[0] > line and h[1] <= level), default=len(lines))
    eol = "\r\n" if "\r\n" in content else "\n"
    parts = [_trimmed("".join(lines[line + 1 : end]), eol)] * append + [_trimmed(new, eol)]
    inside = (eol + eol).join(p for p in parts if p)
    head = "".join(lines[: line + 1])
    out = head + (eol if not head.endswith("\n") else "") + eol + (inside + eol if inside else "")
    return out + (eol if end < len(lines) else "") + "".join(lines[end:])


@row_function(T.ArrayType(struct_of(line=T.IntegerType(), level=T.IntegerType(), title=T.StringType())))
def sections(content: str | None) -> list[dict]:
    """All headings of each page."""
    return [{"line": a, "level": b, "title": c} for a, b, c in scan(content or "")]


@row_function(struct_of(content=T.StringType(), error=T.StringType()), 4)
def edited(content: str, title: str, new: str, append: bool) -> dict:
    try:
        return {"content": edit(content, title, new, append), "error": None}
    except ValueError as e:
        return {"content": None, "error": str(e)}
