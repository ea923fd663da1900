"""How far the sources of a language stray from each other and from the language: exact term-share differences.

Per language the terms of at least ``min_docs`` documents are kept, V of them.  A group (a source
within a language, or the language itself) gives a kept term of count c the share
p = 1 + floor(10^9 (c + 5) / (N + 5 V)), N being the group's occurrences of kept terms.  Two
parts come out: ``pair``, the sum of \\|p - q\\| over all kept terms for each pair of sources, and
``term``, the group's terms above the language's share, the largest excesses first.

Tasks count terms of their own rows and send sums.  Kept terms are dealt to blocks of a language;
a block is one dense int64 tile, groups by terms, whose pairs are compared by broadcasting.  It
sends one partial sum a pair and one short list a group, which are added and merged.  Tiles are
made narrower where a language has many sources, so a tile's cells are bounded; no table is
broadcast, and a hot language or source is spread by term and by block.

Defined cases: null text, language or source is the empty string, which is a language and a
source like any other; empty and very long texts, repeated rows and null or repeated ids are
documents as they come; a language without kept terms has its pairs at 0 and no terms; an empty
table gives no rows; further columns are ignored.  Ties rank by the item's UTF-8 bytes.  All
arithmetic is on whole numbers, and shares are exact while N + 5 V stays under 9 * 10^15.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, written

#: Maximal runs of ASCII letters and of everything beyond ASCII.
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
#: Entries that a task counts before it sends them on.
HELD = 400_000
#: Terms of a block at most, and cells of a tile at most (as long as a tile has one term).
BLOCK_TERMS, TILE_CELLS = 2048, 1 << 21
SMOOTHING, SCALE_ROUNDS = 5, 3


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with the term), for every group and term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_with) in seen.items():
                terms = list(n)
                for at in range(0, len(terms), 50_000):
                    part = terms[at : at + 50_000]
                    columns = [[lang] * len(part), [source] * len(part), part, [n[t] for t in part], [docs_with[t] for t in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["lang", "source", "term", "n", "docs"])

        for batch in arrow_rows(batches):
            for text, lang, source in zip(*(batch.column(i) for i in range(3)), strict=True):
                terms = TERM.findall(text.as_buffer().to_pybytes().lower().decode())  # bytes lower A-Z alone
                n, docs_with = seen.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                held -= len(n)
                n.update(terms)
                docs_with.update(set(terms))
                held += len(n)
                if held >= HELD:
                    yield from sent()
                    seen, held = {}, 0
        yield from sent()

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    partial = read.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10^9 (c + 5) / (N + 5 V)) for a row of counts a group, by long division, three digits a step."""
    below = (total + SMOOTHING * kept)[:, None]
    whole, rest = np.divmod(counts + SMOOTHING, below)
    for _ in range(SCALE_ROUNDS):
        digits, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digits
    return whole + 1


def _tile(rows: pd.DataFrame, top: int) -> pd.DataFrame:
    """Partial results of one block: its rows are the language's groups (term is null) and the block's terms."""
    lang, kept = rows["lang"].iat[0], int(rows["kept"].iat[0])
    groups = rows[rows["term"].isna()].sort_values("source")
    sources, totals = groups["source"].to_numpy(), groups["total"].to_numpy(np.int64)
    own = rows[rows["term"].notna()]
    by_bytes = np.argsort(np.array([t.encode() for t in own["term"]], dtype=object), kind="stable")
    terms, lists = own["term"].to_numpy()[by_bytes], own["counts"].to_numpy()[by_bytes]
    place = {s: i for i, s in enumerate(sources)}
    tile = np.zeros((len(sources), len(terms)), np.int64)
    for j, found in enumerate(lists):
        for one in found:
            tile[place[one["source"]], j] = one["n"]
    p = shares(tile, totals, kept) if kept else tile
    everywhere = shares(tile.sum(axis=0)[None, :], totals.sum()[None], kept)[0] if kept else np.zeros(0, np.int64)
    out = []
    step = max(1, TILE_CELLS // max(1, tile.size))
    for at in range(0, len(sources), step):
        apart = np.abs(p[at : at + step, None, :] - p[None, :, :]).sum(axis=2)
        i, j = np.nonzero(np.arange(at, at + len(apart))[:, None] != np.arange(len(sources))[None, :])
        out.append(pd.DataFrame({"source": sources[at + i], "part": "pair", "item": sources[j], "value": apart[i, j]}))
    for g, source in enumerate(sources):
        over = p[g] - everywhere
        found = np.nonzero((tile[g] > 0) & (over > 0))[0]
        found = found[np.argsort(-over[found], kind="stable")[:top]]  # terms are in byte order, so ties are too
        out.append(pd.DataFrame({"source": source, "part": "term", "item": terms[found], "value": over[found]}))
    return pd.concat(out, ignore_index=True).assign(lang=lang)[["lang", "source", "part", "item", "value"]]


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank, as above: all pairs of a language's sources, ``top`` terms a source."""
    counted = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = written(counted.where(F.col("docs") >= min_docs).select("lang", "term", "counts"), "divergence-terms")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
    width = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TERMS), F.floor(F.lit(TILE_CELLS) / F.col("sources"))))
    sizes = sizes.select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.greatest(F.lit(1), F.ceil(F.coalesce("kept", F.lit(0)) / width)).cast("long").alias("blocks"))
    sizes = written(sizes, "divergence-sizes")
    no_counts = F.lit(None).cast("array<struct<source:string,n:bigint>>")
    heads = groups.join(sizes, "lang").select("lang", "kept", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "total", F.lit(None).cast("string").alias("term"), no_counts.alias("counts"))
    parts = kept.join(sizes, "lang").select("lang", "kept", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("total"), "term", "counts")
    partial = heads.unionByName(parts).groupBy("lang", "block").applyInPandas(lambda rows: _tile(rows, top), "lang string, source string, part string, item string, value long")
    partial = written(partial, "divergence-tiles")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = partial.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
