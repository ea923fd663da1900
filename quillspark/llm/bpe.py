"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model is serialised here, directly from the rank vocabulary: every token's bytes
are mapped one to one to printable characters, its score is the negative rank, and the
normaliser is the identity.  sentencepiece then merges the best-scored neighbouring
pair first, leftmost on ties, which is the order of the ranks.

Texts are split into pre-tokens by the tokenizer's pattern and each pre-token is encoded
on its own; decoding maps ids back to bytes.

Defined cases: a null text counts as empty and has no ids (empty id list, hashes of the
empty string); repeated rows and repeated or null ids give one result row per input row;
extra columns of the input are ignored; an empty table gives an empty result.  Lone
surrogates cannot occur in Spark strings.  Very long pre-tokens are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import arrow_rows
from .pretokens import TokenIds, blocks, parted, ragged

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Parse a rank file: lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(1)
def byte_chars() -> list[str]:
    """One printable character per byte: itself where it is printable Latin-1, else from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(byte_chars())


@lru_cache(1)
def _parting() -> list[str]:
    return [*byte_chars()[:255], "\n"]  # no UTF-8 text has the byte 255


def mapped_tokens(tokens: list[bytes]) -> str:
    """The mapped characters of all tokens, with line ends (no byte maps to one) between them."""
    return b"\xff".join(tokens).decode("latin-1").translate(_parting())


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model; piece i + 1 is the i-th token by rank, piece 0 is unknown.

    Field numbers and enum values are those of the public sentencepiece_model.proto.
    """
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, float(score)) + _field(3, kind))
    pieces = [piece("<unk>", 0, 2)]
    pieces += [piece(mapped(token), -rank, 1) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        ranks = sorted(read_ranks(vocabulary).items(), key=lambda x: x[1])
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_proto(dict(ranks)))
        self.whole = {token: np.array(rank, np.uint32).tobytes() for token, rank in ranks}
        utf8 = (i for i in range(256) if i not in (0xC0, 0xC1) and i < 0xF5)
        self.missing = bytes(i for i in utf8 if bytes([i]) not in self.whole)
        self.rank = np.array([0, *(rank for _, rank in ranks)], np.uint32)
        top = ranks[-1][1] + 1 if ranks else 1
        self.tokens = self._store({rank: token for token, rank in ranks}, top)
        self.decimals = self._store({rank: b"%d," % rank for _, rank in ranks}, top)
        self.ids = TokenIds(self.encode_tokens, pattern)

    @staticmethod
    def _store(values: dict[int, bytes], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(values.get(i, b"")) for i in range(top)], np.int64)
        return np.frombuffer(b"".join(values.get(i, b"") for i in range(top)), np.uint8), np.cumsum(sizes) - sizes, sizes

    def encode_tokens(self, tokens: list[bytes]) -> list[bytes]:
        """Each pre-token on its own.  The library gets many at a time, parted by line ends, which no piece holds.

        A byte that is no token is an error, but in a pre-token that is a token as a whole.
        """
        if self.missing:
            for r in tokens:
                if r not in self.whole and r.translate(None, self.missing) != r:
                    raise ValueError(f"a byte of {r!r} is no token of the vocabulary")
        out: list[bytes] = []
        for i in range(0, len(tokens), 128):
            raw = tokens[i : i + 128]
            ids = np.array(self.processor.encode(mapped_tokens(raw), out_type=int), np.int64)
            ids = self.rank[ids[ids > 0]]
            out += [self.whole.get(r, x) for r, x in zip(raw, parted(ids, self.tokens[2][ids], raw), strict=True)]
        return out

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        got = [self.ids.block(texts[a:b]) for a, b in blocks(texts)]
        if not got:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        return np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])

    @staticmethod
    def spell(store: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, counts: np.ndarray) -> Iterator[memoryview]:
        """For each text, what the store holds for its ids."""
        buffer, offsets, sizes = store
        each = sizes[ids]
        data = memoryview(ragged(buffer, offsets[ids], each))
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return (data[a:b] for a, b in zip(ends, ends[1:], strict=False))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[memoryview]:
        """The bytes of each text."""
        return self.spell(self.tokens, ids, counts)


@lru_cache(2)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    """One codec a worker process, with what it has learnt."""
    return Codec(vocabulary, pattern)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode_documents(docs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """Digest rows of every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in arrow_rows(batches):
            texts = _texts(batch.column(1))
            n, a, b = [], [], []
            for begin, end in blocks(texts):
                ids, counts = own.ids.block(texts[begin:end])
                n += counts.tolist()
                a += [sha(x[:-1]) for x in own.spell(own.decimals, ids, counts)]
                b += map(sha, own.decode(ids, counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """The ids themselves: doc_id and an array of ints per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in arrow_rows(batches):
            ids, counts = own.encode(_texts(batch.column(1)))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, ids.astype(np.int32))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(rows: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """Texts of id arrays (null: empty); bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in arrow_rows(batches):
            lists = [v or [] for v in batch.column(1).to_pylist()]
            counts = np.array([len(x) for x in lists], np.int64)
            flat = np.array([i for x in lists for i in x], np.int64)
            texts = [bytes(x).decode("utf-8", "replace") for x in own.decode(flat, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.selectExpr("cast(doc_id as bigint) doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
