"""Chunks of a text for embedding: byte windows that end at natural borders and overlap."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import row_function, struct_of

TARGET, OVERLAP = 2000, 0.2
TYPE = T.ArrayType(struct_of(index=T.IntegerType(), start=T.IntegerType(), end=T.IntegerType()))
_SENTENCE = re.compile(rb"[.!?] ")


def _border(raw: bytes, at: int, step: int) -> int:
    """The nearest character border from ``at`` on, in direction ``step``."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += step
    return at


def cut(window: bytes) -> int:
    """Where a window ends best: after a blank line, else a line, a sentence, a word; else at its end."""
    for mark in (b"\n\n", b"\n"):
        if (at := window.rfind(mark)) >= 0:
            return at + len(mark)
    if ends := [m.end() for m in _SENTENCE.finditer(window)]:
        return ends[-1]
    at = window.rfind(b" ")
    return at + 1 if at >= 0 else len(window)


def chunks(text: str, target: int = TARGET, overlap: int | None = None) -> list[tuple[int, int, int]]:
    """(index, start, end) in bytes; they cover the text, and none is longer than the target (or one character)."""
    if not text.strip():
        return []
    raw, out, start = text.encode(), [], 0
    overlap = int(target * OVERLAP) if overlap is None else overlap
    while True:
        if len(raw) - start <= target:
            out.append((len(out), start, len(raw)))
            return out
        limit = _border(raw, start + target, -1)
        if limit <= start:
            limit = _border(raw, start + 1, 1)
        end = start + cut(raw[start:limit])
        out.append((len(out), start, end))
        if end >= len(raw):
            return out
        back = _border(raw, max(0, end - overlap), -1)
        start = back if back > start else end


@row_function(TYPE)
def chunked(text: str | None) -> list[dict]:
    """Chunks of each text with the usual sizes."""
    return [{"index": i, "start": a, "end": b} for i, a, b in chunks(text or "")]


def piece(text, start, end):
    """Column: the text of a byte span."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, end - start), "UTF-8")
