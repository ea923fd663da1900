"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

Words are runs of letters (A-Z lower-cased) counted over all texts.  Each word's full
neighbourhood (every distinct deletion, replacement and insertion over the alphabet that the
words themselves use) is looked up in the vocabulary by equality, so no distance is computed.

Tasks walk a word's neighbourhood as numbers: a string's 64-bit hash is a sum of one term a
position, so that all edits at a position follow from sums of what stands before and behind
it.  The vocabulary's sorted hashes come to the tasks in parts of at most ``PART_WORDS`` (8
bytes each), one pass over the words a part, so what is broadcast is bounded at any
vocabulary size.  Only neighbours whose hash occurs are spelled out, made distinct within
their word, and joined to the vocabulary by the string itself, which settles chance
collisions.  A word's neighbourhood grows with its length times the alphabet (90 letters at
most); its walk is cut into pieces of ``CELLS`` numbers, so long runs need no more memory.

Defined cases: a null text has no words; a null id counts as the empty string where it picks
the planted typing error; empty and very long texts, repeated rows and repeated ids are rows
as they come; words without neighbours come out with ``n_near`` 0 and null form; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, written

#: Maximal runs of letters, once A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Different words that a task counts before it sends them on.
HELD = 300_000
#: Hashes that are broadcast at once, and neighbours that a task looks up at once, at most.
PART_WORDS, CELLS = 4_000_000, 1 << 20
#: Words of a task that walks neighbourhoods, about.
TASK_WORDS = 20_000


def with_typing_errors(doc_id: str, run: str, one_in: int = 31) -> str:
    """The run, or, where the crc32 of ``id:run`` is a multiple of ``one_in``, the run without one code point."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, min_length: int = 7, as_read: Callable[[str, str], str] = with_typing_errors) -> DataFrame:
    """word and n: what ``as_read`` makes of each run, from ``min_length`` code points on, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            found = list(words)
            for at in range(0, len(found), 50_000):
                part = found[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([words[w] for w in part], pa.int64())], ["word", "n"])

        for batch in arrow_rows(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs = Counter(r for r in RUN.findall(text.as_buffer().to_pybytes().lower().decode()) if len(r) >= min_length)
                for run, n in runs.items():
                    if len(word := as_read(doc_id, run)) >= min_length:
                        words[word] += n
                if len(words) >= HELD:
                    yield from sent()
                    words.clear()
        yield from sent()

    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _term(position: np.ndarray, code: np.ndarray) -> np.ndarray:
    """What a code point at a position adds to its string's hash (a 64-bit mix of both)."""
    x = (position.astype(np.uint64) << np.uint64(24)) + code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def hashes(words: list[str]) -> np.ndarray:
    """The hash of each word."""
    out = np.zeros(len(words), np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        rows = np.nonzero(lengths == length)[0]
        for at in range(0, len(rows), max(1, CELLS // max(1, int(length)))):
            part = rows[at : at + max(1, CELLS // max(1, int(length)))]
            codes = _codes([words[i] for i in part])
            out[part] = _term(np.arange(codes.shape[1])[None, :], codes).sum(axis=1, dtype=np.uint64)
    return out


class Held:
    """A part of the vocabulary's hashes: a bitmap by their leading bits, then a binary search."""

    def __init__(self, sorted_hashes: np.ndarray) -> None:
        self.sorted = sorted_hashes
        self.shift = np.uint64(64 - max(10, int(32 * len(sorted_hashes)).bit_length()))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), np.bool_)
        self.bitmap[sorted_hashes >> self.shift] = True

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Flat places of ``asked`` whose hash occurs."""
        flat = asked.reshape(-1)
        likely = np.nonzero(self.bitmap[flat >> self.shift])[0]
        if not len(likely):
            return likely
        at = np.searchsorted(self.sorted, flat[likely])
        at[at == len(self.sorted)] = 0
        return likely[self.sorted[at] == flat[likely]]


def neighbours(words: list[str], alphabet: str, held: Held, min_length: int) -> Iterator[tuple[int, set[str]]]:
    """Index and distinct neighbours, among those of ``held``, of words of one length."""
    codes, letters = _codes(words), np.frombuffer(alphabet.encode("utf-32-le"), np.uint32)
    n, length = codes.shape
    place = np.arange(length)[None, :]
    here, later = _term(place, codes), _term(place + 1, codes)
    zero = np.zeros((n, 1), np.uint64)
    before = np.concatenate([zero, np.cumsum(here, axis=1, dtype=np.uint64)], axis=1)  # sum of the first i
    total, moved = before[:, -1:], np.concatenate([zero, np.cumsum(later, axis=1, dtype=np.uint64)], axis=1)
    found: dict[int, set[str]] = {}

    def add(i: int, at: int, put: str, skip: int) -> None:
        w = words[i]
        found.setdefault(i, set()).add(w[:at] + put + w[at + skip :])

    if length > min_length:  # without the code point at i: those behind it move down
        earlier = _term(np.maximum(place - 1, 0), codes)
        down = np.concatenate([zero, np.cumsum(earlier, axis=1, dtype=np.uint64)], axis=1)
        for flat in held.find(before[:, :-1] + down[:, -1:] - down[:, 1:]):
            add(int(flat // length), int(flat % length), "", 1)
    step = max(1, CELLS // (n * len(letters)))
    for lo in range(0, length, step):  # another code point at i
        hi = min(length, lo + step)
        put = _term(np.arange(lo, hi)[:, None], letters[None, :])
        asked = (total - here[:, lo:hi])[:, :, None] + put[None, :, :]
        for flat in held.find(asked):
            i, rest = divmod(int(flat), (hi - lo) * len(letters))
            at, letter = divmod(rest, len(letters))
            if codes[i, lo + at] != letters[letter]:
                add(i, lo + at, alphabet[letter], 1)
    for lo in range(0, length + 1, step):  # a code point before i: those from i on move up
        hi = min(length + 1, lo + step)
        put = _term(np.arange(lo, hi)[:, None], letters[None, :])
        asked = (before[:, lo:hi] + moved[:, -1:] - moved[:, lo:hi])[:, :, None] + put[None, :, :]
        for flat in held.find(asked):
            i, rest = divmod(int(flat), (hi - lo) * len(letters))
            at, letter = divmod(rest, len(letters))
            add(i, lo + at, alphabet[letter], 0)
    yield from found.items()


def _vocabulary(counts: DataFrame, min_count: int) -> DataFrame:
    """Written: word, n and its hash h."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes(batch.column(0).to_pylist()).view(np.int64))], ["word", "n", "h"])

    return written(counts.where(F.col("n") >= min_count).select("word", "n").mapInArrow(hashed, "word string, n long, h long"), "spelling-words")


def near_words(vocabulary: DataFrame, min_length: int, part_words: int = PART_WORDS) -> DataFrame:
    """word, n, near and near_n: all pairs of words one edit apart, both ways."""
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = "".join(sorted(r.c for r in letters.collect()))  # letters of RUN: 90 at most
    size = vocabulary.count()
    parts = max(1, -(-size // part_words))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_WORDS))
    words = vocabulary.select("word").repartition(tasks, F.xxhash64("word"))
    pairs = None
    for part in range(parts):
        own = vocabulary.select("h").where(F.pmod(F.col("h"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast(np.sort(own.toArrow().column("h").to_numpy().view(np.uint64)))

        def walk(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in arrow_rows(batches):
                held = held or Held(sent.value)
                by_length: dict[int, list[str]] = {}
                for w in batch.column(0).to_pylist():
                    by_length.setdefault(len(w), []).append(w)
                for length, some in by_length.items():
                    rows = max(1, CELLS // (len(alphabet) * (length + 1)))
                    for at in range(0, len(some), rows):
                        chunk = some[at : at + rows]
                        for i, near in neighbours(chunk, alphabet, held, min_length):
                            yield pa.RecordBatch.from_arrays([pa.array([chunk[i]] * len(near), pa.string()), pa.array(sorted(near), pa.string())], ["word", "near"])

        found = written(words.mapInArrow(walk, "word string, near string"), "spelling-pairs")
        sent.destroy()
        pairs = found if pairs is None else pairs.unionByName(found)
    # a pair that another part's equal hash brought in twice can't be: a hash is in one part alone
    known = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.join(known, "near").join(vocabulary.select("word", "n"), "word").select("word", "n", "near", "near_n")


def _followed(forms: DataFrame) -> DataFrame:
    """word and root, from word and form: each round a word's root becomes its root's root, so paths halve."""
    roots = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        nxt = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = written(roots.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        roots = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return roots


def variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, as_read: Callable[[str, str], str] = with_typing_errors) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``min_length`` code points and ``min_count`` occurrences.

    A word's form is its most frequent near word (ties: the smallest), where that is at least
    ``ratio`` times as frequent; forms are then more frequent at each step, so they lead to an end.
    """
    vocabulary = _vocabulary(word_counts(docs, min_length, as_read), min_count)
    near = near_words(vocabulary, min_length)
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    chosen = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    chosen = written(vocabulary.select("word", "n").join(chosen, "word", "left"), "spelling-forms")
    strong = F.col("best.near_n") >= ratio * F.col("n")
    chosen = chosen.select("word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.near_n")).alias("form_n"))
    roots = _followed(chosen.where("form is not null"))
    return chosen.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
