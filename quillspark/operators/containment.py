"""Many ids in many texts: which of them occur in some text, in one pass and without a shuffle of texts."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of ids in one automaton (up to some fifty times that in a worker); more ids mean more passes over the texts.
PART_BYTES = 4 << 20


def _scanned(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ids of bounded size, those that occur; a task sends each at most once."""
    held = ids.sparkSession.sparkContext.broadcast([r.id for r in ids.toLocalIterator()])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for name in held.value:
            automaton.add_word(name, name)
        automaton.make_automaton()
        seen: set[str] = set()
        for batch in batches:
            for text in batch.column("text"):
                seen.update(name for _, name in automaton.iter(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["id"])

    return texts.select("text").where("text is not null").mapInArrow(scan, "id string").distinct() if held.value else ids


def occurring(ids: DataFrame, texts: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The distinct ids (column ``id``) that occur in some text (column ``text``).

    Ids go to the tasks in parts of bounded size, each part as one automaton that finds all its
    ids in one pass over a text, whatever their number.  Null and empty ids and null texts take
    no part.
    """
    ids = ids.select("id").where("id <> ''").distinct()
    size = ids.agg(F.sum(F.octet_length("id"))).first()[0] or 0
    parts = -(-size // part_bytes)
    if parts <= 1:
        return _scanned(ids, texts)
    return functools.reduce(DataFrame.unionByName, (_scanned(ids.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == n), texts) for n in range(parts)))
