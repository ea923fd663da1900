"""Media columns: AVI files with motion-JPEG frames.

Reading: RIFF chunks and the ``idx1`` index are parsed (a file without index is walked),
frames are decoded by a baseline JPEG decoder (any Huffman and quantisation tables,
restart markers, sampling factors), and shots are cut where the histogram distance of
neighbouring frames stands out from what the last frames showed.  ``clip_rows`` yields one
timed row per clip.

Storing bytes: the unit of this format is a quantised coefficient.  A byte b becomes an AC
coefficient of size class 8, whose eight appended bits are b itself (b from 128 up stands
for the value b, below that for b - 255); 63 bytes fill the AC coefficients of a block,
whose DC difference is 0.  With Huffman tables of that one symbol each, a block takes 568
bits, so such frames are coded and decoded by array operations, and any JPEG decoder reads
them.  The payload's length stands in the file's INFO list.

Defined cases: null text or media counts as empty; an empty payload is one padding unit; a
media value that isn't AVI, is cut off or holds a frame that isn't baseline JPEG yields no
frames from there on; repeated rows and null ids keep their rows; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows

FRAMES_PER_SECOND = 25
#: Blocks of a frame's side; a frame is square.
SIDE = 4
BLOCKS = SIDE * SIDE
PER_BLOCK, CODED = 63, 71
PER_FRAME = BLOCKS * PER_BLOCK
UNIT = 192
BINS = 32

# The zigzag order of JPEG's coefficients.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])


@lru_cache(1)
def cosines() -> np.ndarray:
    """Rows: frequencies; columns: places."""
    u, x = np.mgrid[:8, :8]
    return (np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)


def pixels(coefficients: np.ndarray) -> np.ndarray:
    """Blocks of dequantised coefficients in natural order (n, 64) to 8-bit samples (n, 8, 8)."""
    c = cosines()
    return np.clip(np.rint(c.T @ coefficients.reshape(-1, 8, 8).astype(np.float32) @ c + 128), 0, 255).astype(np.uint8)


# --- storing bytes -------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(1)
def frame_head() -> bytes:
    one_code = bytes([1] + [0] * 15)
    side = SIDE * 8
    return (
        b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, side, side, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + one_code + b"\x00") + _segment(0xC4, b"\x10" + one_code + b"\x08") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def payload_frames(payload: bytes) -> list[bytes]:
    """JPEG frames that hold the payload."""
    n = max(1, -(-len(payload) // PER_FRAME))
    data = np.zeros(n * PER_FRAME, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    bits = np.zeros((n * BLOCKS, 1 + PER_BLOCK * 9), np.uint8)
    bits[:, 1:].reshape(-1, PER_BLOCK, 9)[:, :, 1:] = np.unpackbits(data).reshape(-1, PER_BLOCK, 8)
    coded = np.packbits(bits, axis=1).tobytes()
    head, size = frame_head(), BLOCKS * CODED
    return [head + coded[i : i + size].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, n * size, size)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FRAMES_PER_SECOND, comment: bytes = b"") -> bytes:
    """An AVI file with one motion-JPEG stream and an index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment)) if comment else b""
    movie, index, at = [b"movi"], [], 4
    for f in frames:
        movie.append(c := _chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    body = b"AVI " + head + info + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bytes_to_avi(payload: bytes) -> bytes:
    return write_avi(payload_frames(payload), SIDE * 8, SIDE * 8, comment=b"payload %d" % len(payload))


# --- reading -------------------------------------------------------------------------------


class Avi:
    """Frames and timing of an AVI file."""

    def __init__(self, data: bytes) -> None:
        self.data, self.fps, self.comment, self.spans = data, float(FRAMES_PER_SECOND), b"", []
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            return
        movie, index = None, None
        for name, begin, end in self._walk(12, len(data)):
            if name == b"LIST":
                kind = data[begin : begin + 4]
                if kind == b"movi":
                    movie = begin, end
                else:
                    self._lists(begin + 4, end)
            elif name == b"idx1":
                index = begin, end
        if movie and index:
            flat = struct.iter_unpack("<4sIII", data[index[0] : index[0] + (index[1] - index[0]) // 16 * 16])
            entries = [(at, n) for name, _, at, n in flat if name[2:] in (b"dc", b"db")]
            # offsets count from the list's type, or in some files from the file's begin
            base = movie[0] if not entries or data[movie[0] + entries[0][0] :][2:4] in (b"dc", b"db") else 0
            self.spans = [(base + at + 8, base + at + 8 + n) for at, n in entries if base + at + 8 + n <= len(data)]
        elif movie:
            self.spans = [(b, e) for name, b, e in self._walk(movie[0] + 4, movie[1]) if name[2:] in (b"dc", b"db")]

    def _walk(self, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
        while at + 8 <= end:
            n = int.from_bytes(self.data[at + 4 : at + 8], "little")
            yield self.data[at : at + 4], at + 8, min(at + 8 + n, end)
            at += 8 + n + (n & 1)

    def _lists(self, begin: int, end: int) -> None:
        for name, b, e in self._walk(begin, end):
            if name == b"LIST":
                self._lists(b + 4, e)
            elif name == b"strh" and self.data[b : b + 4] == b"vids" and e - b >= 28:
                scale, rate = struct.unpack("<II", self.data[b + 20 : b + 28])
                self.fps = rate / scale if scale and rate else self.fps
            elif name == b"ICMT":
                self.comment = self.data[b:e]

    def frames(self) -> list[bytes]:
        return [self.data[a:b] for a, b in self.spans]


def avi_payload(avi: Avi) -> tuple[bytes, np.ndarray]:
    """The stored bytes and the frames' coefficients (n, 64) of a file that ``bytes_to_avi`` made."""
    head, size = frame_head(), BLOCKS * CODED
    parts = []
    for frame in avi.frames():
        coded = frame[len(head) : -2].replace(b"\xff\x00", b"\xff")
        if not frame.startswith(head) or len(coded) != size:
            raise ValueError("not a frame of stored bytes")
        parts.append(coded)
    bits = np.unpackbits(np.frombuffer(b"".join(parts), np.uint8)).reshape(-1, CODED * 8)[:, 1:].reshape(-1, PER_BLOCK, 9)
    if bits[:, :, 0].any():
        raise ValueError("a code that the tables don't have")
    data = np.packbits(bits[:, :, 1:].reshape(-1, 8), axis=1).reshape(-1)
    values = data.astype(np.float32)
    values[data < 128] -= 255
    block = np.zeros((len(data) // PER_BLOCK, 64), np.float32)
    block[:, ZIGZAG[1:]] = values.reshape(-1, PER_BLOCK)
    return data.tobytes()[: int(avi.comment.split()[1])], block


class Jpeg:
    """A baseline JPEG decoder: planes of samples, one per component."""

    def __init__(self, data: bytes) -> None:
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.restart, at = 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise ValueError("no marker")
            marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    table = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8)
                    self.quant[body[0] & 15] = table.astype(np.float32)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    counts = body[1:17]
                    symbols = body[17 : 17 + sum(counts)]
                    self.huffman[body[0]] = self._table(counts, symbols)
                    body = body[17 + sum(counts) :]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker in (0xC0, 0xC1):
                self.height, self.width = struct.unpack(">HH", body[1:5])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif marker == 0xDA:
                tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                self._scan(data[at:], tables)
                return
            elif 0xC2 <= marker <= 0xCF:
                raise ValueError("not baseline")
        raise ValueError("no scan")

    @staticmethod
    def _table(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Length and symbol for each 16-bit window."""
        lengths, values = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code, k = 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                a = code << (16 - n)
                lengths[a : a + (1 << (16 - n))], values[a : a + (1 << (16 - n))] = n, symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        return lengths, values

    def _scan(self, coded: bytes, tables: dict[int, tuple[int, int]]) -> None:
        wide, high = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            wide = high = 1
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        columns, rows = -(-self.width // (8 * wide)), -(-self.height // (8 * high))
        blocks = [np.zeros((rows * p[2], columns * p[1], 64), np.float32) for p in self.parts]
        pieces = self._pieces(coded)
        last, value, left = [0] * len(self.parts), 0, 0

        def need(n: int) -> None:
            nonlocal value, left
            while left < n:
                value, left = (value << 8) | next(stream, 0xFF), left + 8

        def take(n: int) -> int:
            nonlocal value, left
            if not n:
                return 0
            need(n)
            left -= n
            out, value = value >> left, value & ((1 << left) - 1)
            return out if out >> (n - 1) else out - (1 << n) + 1

        def symbol(table: tuple[np.ndarray, np.ndarray]) -> int:
            nonlocal value, left
            need(16)
            window = value >> (left - 16)
            n = int(table[0][window])
            if not n:
                raise ValueError("a code that the tables don't have")
            left -= n
            value &= (1 << left) - 1
            return int(table[1][window])

        stream = iter(next(pieces))
        for mcu in range(rows * columns):
            if self.restart and mcu and mcu % self.restart == 0:
                stream, value, left, last = iter(next(pieces)), 0, 0, [0] * len(self.parts)
            for c, (name, h, v, _) in enumerate(self.parts):
                dc, ac = self.huffman[tables[name][0]], self.huffman[16 + tables[name][1]]
                for y in range(v):
                    for x in range(h):
                        block = blocks[c][mcu // columns * v + y, mcu % columns * h + x]
                        last[c] += take(symbol(dc))
                        block[0], k = last[c], 1
                        while k < 64:
                            s = symbol(ac)
                            if not s & 15:
                                if s != 0xF0:
                                    break
                                k += 16
                                continue
                            k += s >> 4
                            if k > 63:
                                raise ValueError("too many coefficients")
                            block[ZIGZAG[k]] = take(s & 15)
                            k += 1
        self.planes = []
        for (_, h, v, q), b in zip(self.parts, blocks, strict=True):
            scale = np.empty(64, np.float32)
            scale[ZIGZAG] = self.quant[q]
            part = pixels(b.reshape(-1, 64) * scale).reshape(b.shape[0], b.shape[1], 8, 8).swapaxes(1, 2).reshape(b.shape[0] * 8, -1)
            self.planes.append(part[: -(-self.height * v // high), : -(-self.width * h // wide)])

    @staticmethod
    def _pieces(coded: bytes) -> Iterator[bytes]:
        """Entropy-coded data between restart markers, without stuffing."""
        at = begin = 0
        while (at := coded.find(b"\xff", at)) >= 0 and at + 1 < len(coded):
            if coded[at + 1] == 0:
                at += 2
            elif 0xD0 <= coded[at + 1] <= 0xD7:
                yield coded[begin:at].replace(b"\xff\x00", b"\xff")
                at = begin = at + 2
            else:
                break
        yield coded[begin : at if at >= 0 else len(coded)].replace(b"\xff\x00", b"\xff")
        while True:
            yield b""


def histogram(plane: np.ndarray) -> np.ndarray:
    """Shares of brightness classes."""
    return np.bincount(plane.reshape(-1) >> 3, minlength=BINS) / max(1, plane.size)


def shots(histograms: np.ndarray, window: int = 8, factor: float = 3.0, least: float = 0.2) -> list[tuple[int, int]]:
    """Runs of frames: a cut where the L1 distance exceeds both ``least`` and the mean plus
    ``factor`` deviations of the last ``window`` distances of the same shot."""
    if not len(histograms):
        return []
    gaps = np.abs(np.diff(histograms, axis=0)).sum(axis=1).tolist()
    cuts, recent = [0], []
    for i, gap in enumerate(gaps, 1):
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if gap > max(least, mean + factor * spread):
            cuts.append(i)
            recent = []
        else:
            recent = [*recent[1 - window :], gap]
    return list(zip(cuts, [*cuts[1:], len(histograms)], strict=True))


def media_histograms(avi: Avi) -> np.ndarray:
    """A histogram of the first component of each frame that can be decoded."""
    try:
        _, block = avi_payload(avi)
        levels = pixels(block).reshape(len(block) // BLOCKS, -1) >> 3
        n = len(levels)
        return np.bincount((np.arange(n)[:, None] * BINS + levels).reshape(-1), minlength=n * BINS).reshape(n, BINS) / levels.shape[1]
    except (ValueError, IndexError):
        pass
    out = []
    for frame in avi.frames():
        try:
            out.append(histogram(Jpeg(frame).planes[0]))
        except (ValueError, KeyError, IndexError, struct.error):
            break
    return np.array(out).reshape(-1, BINS)


def clip_rows(media: DataFrame, id_column: str = "media_id", column: str = "media") -> DataFrame:
    """One row per clip of each AVI value: id, clip, frames and times."""
    schema = "media_id string, clip int, first_frame int, n_frames int, start_s double, end_s double, mean_level double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            rows = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                avi = Avi(value.as_py() or b"")
                h = media_histograms(avi)
                for k, (a, b) in enumerate(shots(h)):
                    level = float((h[a:b].mean(axis=0) * (np.arange(BINS) * 8 + 4)).sum())
                    rows.append((name, k, a, b - a, a / avi.fps, b / avi.fps, level))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return media.selectExpr(f"cast(`{id_column}` as string) media_id", f"cast(`{column}` as binary) media").mapInArrow(run, schema)


DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _digest(text: str) -> tuple:
    raw = text.encode()
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    media = bytes_to_avi(raw.ljust(size))
    avi = Avi(media)
    payload, block = avi_payload(avi)
    levels = pixels(block).reshape(len(block) // BLOCKS, -1) >> 3
    n = len(levels)
    h = np.bincount((np.arange(n)[:, None] * BINS + levels).reshape(-1), minlength=n * BINS).reshape(n, BINS) / levels.shape[1]
    clips = ";".join(f"{a / avi.fps:.2f}-{b / avi.fps:.2f}" for a, b in shots(h))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={n} clips={clips}"


def media_documents(docs: DataFrame) -> DataFrame:
    """Each text stored as AVI, read back and digested."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        for batch in arrow_rows(batches):
            rows = [_digest(v.as_py() or "") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], names=names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, DIGEST)
