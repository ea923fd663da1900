"""Line diffs: longest common subsequence, counts, and unified text with three lines of context."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import types as T

from . import row_function, struct_of

CONTEXT = 3


def diff(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """Operations ('=', '-' or '+', line); where both orders serve, deletions come first.

    Common ends are cut off first.
    """
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    same = lambda rows: [("=", x) for x in rows]
    return same(old[:head]) + _inner(old[head : len(old) - tail], new[head : len(new) - tail]) + same(old[len(old) - tail :])


def _row(x: int, b: np.ndarray, below: np.ndarray) -> np.ndarray:
    """A row of the table of common lengths from the row below it: a running maximum from its end."""
    row = np.zeros(len(b) + 1, np.int32)
    row[:-1] = np.maximum.accumulate(np.where(b == x, below[1:] + 1, below[:-1])[::-1])[::-1]
    return row


def _inner(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """The walk through the table of common lengths, deletions first.

    A line that one side lacks changes no length, so the table has rows and columns of shared
    lines only.  Of its n rows those at the ends of blocks of sqrt(n) are held; the others are
    made again, a block at a time, when the walk gets there.
    """
    ids: dict[str, int] = {}
    a, b = (np.array([ids.setdefault(x, len(ids)) for x in side], np.int64) for side in (old, new))
    in_new, in_old = np.isin(a, b), np.isin(b, a)
    rows, columns = a[in_new], b[in_old]
    size = max(1, math.isqrt(len(rows)))
    held, row = {}, np.zeros(len(columns) + 1, np.int32)
    for i in range(len(rows), 0, -1):
        if i % size == 0 or i == len(rows):
            held[-(-i // size) - 1] = row
        row = _row(rows[i - 1], columns, row)

    def keeps(block: int) -> list[tuple[bytes, bytes]]:
        """Of each row of a block, a bit a column: whether a deletion keeps the length, against an insertion and against none."""
        below, out = held.pop(block), []
        for x in rows[block * size : (block + 1) * size][::-1]:
            row = _row(x, columns, below)
            out.append((np.packbits(below[:-1] >= row[1:]).tobytes(), np.packbits(below >= row).tobytes()))
            below = row
        return out[::-1]

    mine, yours, shared_a, shared_b = a.tolist(), b.tolist(), in_new.tolist(), in_old.tolist()
    out, i, j, r, c, block, bits = [], 0, 0, 0, 0, -1, []
    while i < len(mine) and j < len(yours):
        if mine[i] == yours[j]:
            out.append(("=", old[i]))
            i, j, r, c = i + 1, j + 1, r + 1, c + 1
            continue
        if shared_a[i] and r // size != block:
            block = r // size
            bits = keeps(block)
        if not shared_a[i] or bits[r % size][not shared_b[j]][c >> 3] >> (7 - (c & 7)) & 1:
            out.append(("-", old[i]))
            r += shared_a[i]
            i += 1
        else:
            out.append(("+", new[j]))
            c += shared_b[j]
            j += 1
    return out + [("-", x) for x in old[i:]] + [("+", x) for x in new[j:]]


def lines_of(text: str) -> list[str]:
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    return lines[:-1] if lines[-1] == "" else lines


def stats(old: str, new: str) -> tuple[int, int]:
    """Lines added and removed."""
    return _stats(diff(lines_of(old), lines_of(new)))


def _stats(ops: list[tuple[str, str]]) -> tuple[int, int]:
    marks = [m for m, _ in ops]
    return marks.count("+"), marks.count("-")


def unified(old: str, new: str) -> str:
    """Hunks of changes; empty for equal texts."""
    return _hunks(diff(lines_of(old), lines_of(new)))


def _hunks(ops: list[tuple[str, str]]) -> str:
    changed = [i for i, (m, _) in enumerate(ops) if m != "="]
    shown = sorted({j for i in changed for j in range(max(0, i - CONTEXT), min(len(ops), i + CONTEXT + 1))})
    runs: list[list[int]] = []
    for j in shown:
        if runs and j == runs[-1][-1] + 1:
            runs[-1].append(j)
        else:
            runs.append([j])
    before = lambda end, skip: sum(m != skip for m, _ in ops[:end])
    out = []
    for run in runs:
        part = [ops[j] for j in run]
        olds, news = (sum(m != skip for m, _ in part) for skip in "+-")
        out.append(f"@@ -{before(run[0], '+') + 1},{olds} +{before(run[0], '-') + 1},{news} @@\n")
        out += [{"=": " "}.get(m, m) + line + "\n" for m, line in part]
    return "".join(out)


@row_function(struct_of(added=T.IntegerType(), removed=T.IntegerType(), diff=T.StringType()), 2)
def compared(old: str | None, new: str | None) -> dict:
    """Counts and unified diff of each pair."""
    ops = diff(lines_of(old or ""), lines_of(new or ""))
    return dict(zip(("added", "removed", "diff"), (*_stats(ops), _hunks(ops)), strict=True))
