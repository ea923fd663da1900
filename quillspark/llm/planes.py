"""Token ids in a bit-plane-shuffled, compressed file format.

Texts are encoded with a tokenizer of the tokenizers library (texts are cut at the file's
added tokens first, as its encode does), an end id is appended to each document, and the
ids are written in ascending document order.  The format: ids are
cut into blocks of ``BLOCK_IDS``; a block's little-endian ids are transposed into planes
(byte planes, or single-bit planes with ``bits=True``), each plane is compressed by
zstandard, and planes that hold only zeros are stored as empty.

Storage is a folder of two Parquet tables that Spark's committers write: ``chunks`` (shard,
chunk, n_ids, planes, and the places of the documents inside) and, made from them, the index
``chunk_index`` (shard, chunk, the global place of its first id, n_ids, sizes of the planes),
by which documents get their places when they are read.  A shard is a range of the document
order; a chunk never mixes shards, so every shard can be written, retried and read on its own.

Defined cases: a null text counts as empty and becomes the end id alone; null ids sort
first; rows with equal ids keep one row each (ordered by text); extra columns are ignored;
an empty table gives empty files and an empty result.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .bpe import byte_chars, mapped
from .common import arrow_rows, shared_dir
from .pretokens import TokenIds, blocks, parted

BLOCK_IDS = 1 << 16
CHUNKS = "shard int, chunk int, n_ids int, planes array<binary>, docs array<struct<seq: int, doc_id: bigint, first: bigint, n: int, piece: int, whole: boolean>>"
INDEX = "shard int, chunk int, start bigint, n_ids int, plane_bytes array<int>"


def to_planes(ids: np.ndarray, bits: bool = False, level: int = 1) -> list[bytes]:
    """Compressed planes of one block of ids."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    planes = np.packbits(np.unpackbits(rows, axis=1), axis=0).T if bits else rows.T
    pack = zstandard.ZstdCompressor(level=level).compress
    return [pack(np.ascontiguousarray(p).tobytes()) if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    """The ids of one block."""
    unpack = zstandard.ZstdDecompressor().decompress
    width = -(-n // 8) if bits else n
    rows = np.zeros((len(planes), width), np.uint8)
    for row, p in zip(rows, planes, strict=True):
        if p:
            row[:] = np.frombuffer(unpack(p), np.uint8)
    if bits:
        rows = np.packbits(np.unpackbits(rows, axis=1)[:, :n], axis=0)
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


class TokenizerIds:
    """Whole texts to ids by a byte-level tokenizer file of the tokenizers library."""

    def __init__(self, file: str) -> None:
        whole = Tokenizer.from_str(file)
        self.model = whole.model
        vocabulary = whole.get_vocab()
        added = {t.content: (i, t) for i, t in whole.get_added_tokens_decoder().items()}
        if any(t.single_word or t.lstrip or t.rstrip for _, t in added.values()) or whole.normalizer is not None:
            raise ValueError("only plain added tokens and files without a normaliser can be cut out of texts")
        self.added = {content: i for content, (i, _) in added.items()}
        #: The longest added token at the leftmost place, as the library matches them.
        self.cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)  # one mapped character a byte
        joint = "".join(t for t in vocabulary if len(t) > 1)
        #: A byte that no UTF-8 text has and that no merge uses, to part tokens.
        self.part = next(b for b in [0xC0, 0xC1, *range(0xF5, 0x100)] if byte_chars()[b] not in joint)
        self.part_id = vocabulary[byte_chars()[self.part]]
        self.ids = TokenIds(self.encode_tokens)

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each has."""
        if self.cut is None or not any(map(self.cut.search, texts)):
            return self.ids.block(texts)
        parts: list[str] = []
        ends: list[int] = []  # parts up to the end of each text
        tokens: list[tuple[int, int]] = []  # an added token's id, and the parts before it
        for t in texts:
            at = 0
            for m in self.cut.finditer(t):
                parts.append(t[at : m.start()])
                tokens.append((self.added[m[0]], len(parts)))
                at = m.end()
            parts.append(t[at:])
            ends.append(len(parts))
        ids, counts = self.ids.block(parts)
        upto = np.concatenate([[0], np.cumsum(counts)])
        after = np.array([n for _, n in tokens], np.int64)
        ids = np.insert(ids, upto[after], np.array([i for i, _ in tokens], np.uint32))
        last = np.array(ends, np.int64)
        return ids, np.diff(upto[last] + np.searchsorted(after, last, "right"), prepend=0)

    def encode_tokens(self, tokens: list[bytes]) -> list[bytes]:
        """Single pre-tokens by the library's model, some at a time, with a byte between them that never merges."""
        out: list[bytes] = []
        for i in range(0, len(tokens), 32):
            raw = tokens[i : i + 32]
            ids = np.array([t.id for t in self.model.tokenize(mapped(bytes([self.part]).join(raw)))], np.int64)
            ids = ids[ids != self.part_id]
            out += parted(ids, self.sizes[ids], raw)
        return out


@lru_cache(2)
def tokenizer(file: str) -> TokenizerIds:
    return TokenizerIds(file)


def _shards(docs: DataFrame, file: str, end_id: int, bits: bool) -> DataFrame:
    """Chunk rows of all shards; each task takes one range of the document order and streams it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(file)
        schema = pa.schema([("chunk", pa.int32()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())), ("docs", pa.list_(pa.struct([("seq", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("piece", pa.int32()), ("whole", pa.bool_())])))])
        seq, chunk, place = 0, 0, 0
        held: list[np.ndarray] = []
        inside: list[dict] = []
        room = BLOCK_IDS

        def flush() -> pa.RecordBatch:
            nonlocal chunk, held, inside, room
            ids = np.concatenate(held)
            row = {"chunk": chunk, "n_ids": len(ids), "planes": to_planes(ids, bits), "docs": inside}
            chunk, held, inside, room = chunk + 1, [], [], BLOCK_IDS
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in arrow_rows(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            names = batch.column(0).to_pylist()
            for begin, end in blocks(texts):
                ids, counts = own.block(texts[begin:end])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                ends = (ends + np.arange(1, len(ends) + 1)).tolist()
                at = 0
                for name, upto in zip(names[begin:end], ends, strict=True):
                    n, piece = upto - at, 0
                    while at < upto:
                        take = min(room, upto - at)
                        held.append(ids[at : at + take])
                        inside.append({"seq": seq, "doc_id": name, "first": place, "n": take, "piece": piece, "whole": take == n})
                        at, place, room, piece = at + take, place + take, room - take, piece + 1
                        if not room:
                            yield flush()
                    seq += 1
        if held:
            yield flush()

    plain = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    dealt = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, CHUNKS.removeprefix("shard int, ")).select(F.spark_partition_id().alias("shard"), "*")


def write_ids(docs: DataFrame, file: str, end_id: int = 0, bits: bool = False) -> str:
    """Encode and store chunks, then their index; returns the folder."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/quillspark/ids-{uuid.uuid4().hex}"
    _shards(docs, file, end_id, bits).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("shard", "chunk", "n_ids", F.transform("planes", lambda p: F.octet_length(p)).alias("plane_bytes"))
    totals = chunks.groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("total"))  # a row per shard: a few thousand at any size
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    start = F.col("base") + F.col("chunk").cast("long") * BLOCK_IDS
    chunks.join(F.broadcast(bases), "shard").select("shard", "chunk", start.alias("start"), "n_ids", "plane_bytes").write.parquet(f"{path}/chunk_index")
    return path


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """shard, chunk, start (global place of its first id), n_ids, plane_bytes."""
    return spark.read.schema(INDEX).parquet(f"{path}/chunk_index")


def read_documents(spark: SparkSession, path: str, bits: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each stored document, from the stored planes alone."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "seq", "doc_id", "first", "n", "piece", "crc", "part"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        for batch in arrow_rows(batches):
            for row in batch.to_pylist():
                data = memoryview(from_planes(row["planes"], row["n_ids"], bits).tobytes())
                at, out = 0, []
                for d in row["docs"]:
                    own = data[4 * at : 4 * (at + d["n"])]
                    at += d["n"]
                    out.append((row["shard"], d["seq"], d["doc_id"], d["first"], d["n"], d["piece"], zlib.crc32(own) if d["whole"] else None, None if d["whole"] else bytes(own)))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    parts = chunks.mapInArrow(run, "shard int, seq int, doc_id bigint, first bigint, n int, piece int, crc bigint, part binary")
    joined = parts.groupBy("shard", "seq").agg(
        F.max("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum(F.col("n").cast("long")).alias("n_tokens"), F.max("crc").alias("crc"),
        F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("piece", "part")))).alias("parts"),
    )
    whole = F.expr("crc32(aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.part)))")
    based = joined.join(F.broadcast(chunk_index(spark, path).where("chunk = 0").select("shard", F.col("start").alias("base"))), "shard")  # a row per shard
    return based.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", F.coalesce("crc", whole).alias("ids_crc32"))
