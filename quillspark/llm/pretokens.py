"""Vectorised pre-tokenisation for byte-level BPE vocabularies.

The usual byte-level pattern (``public_tokenizers.PATTERN``) is a function of character
classes, so the token starts of a whole block of texts are found with array operations.
Within a block, tokens are grouped by a 64-bit multilinear hash and by length; a library
encodes each different token once per worker (the worker's memory is keyed by the token
itself), and ids are gathered for all occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

#: Characters that are handled in one go; a longer text makes a longer block of its own.
BLOCK_CHARS = 1_000_000
#: Different tokens that one worker remembers.
CACHE_TOKENS = 600_000
LETTER, NUMBER, OTHER, SPACE, END = range(5)
#: Between texts; a lone surrogate can't occur in Spark's strings.
MARK = "\ud800"
SUPPORTED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    at = lambda i: i if i < 0xD800 else i + 0x800
    for kind, prop in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(prop, every):
            out[at(m.start()) : at(m.end() - 1) + 1] = kind
    out[ord(MARK)] = END
    return out


@lru_cache(1)
def code_numbers() -> np.ndarray:
    """A random 64-bit number per code point (fixed seed)."""
    return np.random.default_rng(20240607).integers(1, 1 << 64, 0x110000, np.uint64)


_places = np.zeros(0, np.uint64)


def place_numbers(n: int) -> np.ndarray:
    """A random odd 64-bit number for each place in a token, for multilinear hashing (fixed seed)."""
    global _places
    if len(_places) < n:
        _places = np.random.default_rng(7).integers(0, 1 << 63, max(n, 4096), np.uint64) * np.uint64(2) + np.uint64(1)
    return _places


def token_starts(cp: np.ndarray) -> np.ndarray:
    """Where tokens begin; the texts' end marks stand alone."""
    kind = classes()[cp]
    start = np.ones(len(cp), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & (kind[1:] != END))
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    quote = np.flatnonzero((cp == 39) & start)
    quote = quote[quote + 2 < len(cp)]  # a long form's end is in bounds too: its second letter isn't the end mark
    if len(quote):
        a, b = cp[quote + 1], cp[quote + 2]
        short = np.isin(a, list(map(ord, "stmd")))
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for hit, size in ((short, 2), (long, 3)):
            at = quote[hit]
            start[at + 1] = False
            at = at + size
            start[at[kind[at] == LETTER]] = True
    return start


def ragged(buffer: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate buffer[offset : offset + length] for all pairs."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return buffer[np.arange(total) + np.repeat(offsets - (ends - lengths), lengths)]


def blocks(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARS characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def parted(ids: np.ndarray, sizes: np.ndarray, tokens: Sequence[bytes]) -> list[bytes]:
    """Cut the ids of concatenated tokens at the tokens' ends, as packed uint32; sizes: bytes of each id."""
    ends = np.cumsum(sizes)
    cuts = [0, *((np.searchsorted(ends, np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))) + 1) * 4).tolist()]
    data = ids.astype(np.uint32).tobytes()
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class TokenIds:
    """Ids of whole texts, by a function that encodes single tokens (UTF-8) to packed uint32."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], pattern: str = SUPPORTED) -> None:
        if pattern != SUPPORTED:
            raise ValueError("only the usual byte-level pattern can be split by character classes")
        self.encode = encode
        self.known: dict[str, bytes] = {}

    def block(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts one after another, and how many each text has."""
        joined = MARK.join(texts) + MARK
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.flatnonzero(token_starts(cp))
        lengths = np.diff(begins, append=len(cp))
        rel = np.arange(len(cp), dtype=np.int32) - np.repeat(begins.astype(np.int32), lengths)
        hashes = code_numbers()[cp]
        hashes *= place_numbers(int(lengths.max()))[rel]
        hashes = np.add.reduceat(hashes, begins)
        marks = np.flatnonzero(cp == ord(MARK))
        real = cp[begins] != ord(MARK)
        begins, lengths, hashes = begins[real], lengths[real], hashes[real]
        of, different = pd.factorize(hashes)
        first = np.empty(len(different), np.int64)
        first[of[::-1]] = np.arange(len(of))[::-1]
        if not np.array_equal(lengths[first][of], lengths):  # two tokens share a hash: group by the tokens
            of, _ = pd.factorize(np.array([joined[b : b + n] for b, n in zip(begins.tolist(), lengths.tolist(), strict=True)], object))
            first = np.empty(of.max() + 1, np.int64)
            first[of[::-1]] = np.arange(len(of))[::-1]
        found = self.lookup([joined[b : b + n] for b, n in zip(begins[first].tolist(), lengths[first].tolist(), strict=True)])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = sizes[of]
        ids = ragged(np.frombuffer(b"".join(found), np.uint32), (np.cumsum(sizes) - sizes)[of], each)
        before = np.concatenate([[0], np.cumsum(each)])
        return ids, np.diff(before[np.searchsorted(begins, marks)], prepend=0)

    def lookup(self, tokens: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > CACHE_TOKENS:
            known.clear()
        out = list(map(known.get, tokens))
        new = [i for i, x in enumerate(out) if x is None]
        if new:
            fresh = [tokens[i] for i in new]
            got = self.encode([t.encode() for t in fresh])
            known.update(zip(fresh, got, strict=True))
            for i, x in zip(new, got, strict=True):
                out[i] = x
        return out
