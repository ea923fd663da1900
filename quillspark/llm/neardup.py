"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact links.

1. Each text becomes its set of word shingles (64-bit hashes) and a MinHash signature.
   Texts with the same set share a node, named by the least document id with the set and a
   128-bit digest of it.
2. Nodes that agree in all hashes of a band share a bucket; all pairs in a bucket are
   candidates.  Candidate nodes keep their signature and shingle hashes in a table, so texts
   are read once more for them and never again.
3. Members of a bucket are first compared with its smallest node alone.  A comparison goes
   signature batch by signature batch; after each batch the posterior probability that the
   similarity reaches the threshold (uniform prior) is bounded, and pairs below the miss
   probability are dropped.  Survivors are verified on the full sets.
4. Components of these links leave few buckets whose members are not connected yet.  There,
   pairs of different components are compared: a bucket's members are dealt to chunks of one
   component each, small components share chunks, and a pair of chunks is a unit of work
   unless both hold the same single component.  No pair is ever a row, and no unit holds more
   than about two chunks of ``CHUNK_BYTES`` however large a bucket is.
5. Connected components of all verified links are the result.

Misses can only come from the bands or the posterior bound.  With the default ``miss`` each
is below 1e-5 at the threshold itself and far lower above.

Defined cases: null or blank texts have an empty set, are linked with nothing and form
their own component; texts with fewer words than a shingle have their whole sequence as
one shingle; repeated rows are equal texts; null ids never name a component unless all ids
are null; extra columns are ignored; an empty table gives an empty result.
``deduplicated`` keeps exactly one row of each component, also where ids are null or repeated
and where rows are, and all rows without words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, arrow_rows, taken_rows, text_hash, written
from .components import components

BATCH = 32
#: Signatures and shingle hashes in a chunk.
CHUNK_BYTES = 16 << 20
#: Ties of one hub in a task.
HUB_TIES = 512
BLOCK_BYTES = 1 << 20
NODES = "doc_id bigint, th bigint, n_shingles bigint, node binary, bands array<bigint>"


@lru_cache(1)
def _random() -> dict[str, np.ndarray]:
    """Fixed random odd multipliers."""
    rng = np.random.default_rng(424242)
    odd = lambda n: rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return {"bytes": odd(256), "words": odd(1024), "short": odd(1024), "band": odd(64), "a": odd(4096).astype(np.uint32) | np.uint32(1), "b": odd(4096).astype(np.uint32), "places": odd(1 << 12)}


def _places(n: int) -> np.ndarray:
    own = _random()
    while len(own["places"]) < n:
        more = np.random.default_rng(len(own["places"])).integers(0, 1 << 63, len(own["places"]), np.uint64)
        own["places"] = np.concatenate([own["places"], more * np.uint64(2) + np.uint64(1)])
    return own["places"]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits (a fixed 64-bit finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _lowered() -> np.ndarray:
    return np.frombuffer(bytes(range(256)).lower(), np.uint8)


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    begin = 0
    while begin < len(texts):
        size, end = 0, begin
        while end < len(texts) and (end == begin or size + len(texts[end]) < BLOCK_BYTES):
            size, end = size + len(texts[end]), end + 1
        yield from _block_sets(texts[begin:end], k)
        begin = end


def _block_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    own = _random()
    raw = np.frombuffer(b"\xff".join([t.encode() for t in texts]) + b"\xff", np.uint8)
    raw = _lowered()[raw]
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13)) | (raw == 255)
    inside = np.flatnonzero(~gap)
    marks = np.flatnonzero(raw == 255)
    if not len(inside):
        yield from (np.zeros(0, np.uint64) for _ in texts)
        return
    first = np.flatnonzero(np.diff(inside, prepend=-2) != 1)  # places in ``inside`` where words begin
    lengths = np.diff(first, append=len(inside))
    rel = np.arange(len(inside)) - np.repeat(first, lengths)
    words = _mixed(np.add.reduceat(own["bytes"][raw[inside]] * _places(int(lengths.max()))[rel], first) + lengths.astype(np.uint64))
    upto = np.searchsorted(inside[first], marks)  # words before each text's end
    n = len(words)
    if n >= k:
        rolled = sum((words[j : n - k + 1 + j] * own["words"][j] for j in range(1, k)), words[: n - k + 1] * own["words"][0])
        rolled = _mixed(rolled)
    start = 0
    for end in upto.tolist():
        if end - start >= k:
            yield np.unique(rolled[start : end - k + 1])
        elif end > start:
            yield _mixed((words[start:end] * own["words"][: end - start]).sum(keepdims=True) + own["short"][end - start : end - start + 1])
        else:
            yield np.zeros(0, np.uint64)
        start = end


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """n minima of multiply-add hashes (uint32)."""
    own = _random()
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = own["a"][:n, None] * x[None, i : i + 2048] + own["b"][:n, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
    return _mixed((parts * _random()["band"][:rows]).sum(axis=1) + np.arange(bands, dtype=np.uint64)).view(np.int64)


@lru_cache(8)
def plan(threshold: float, miss: float) -> tuple[int, int, tuple[int, ...]]:
    """Bands, rows, and the least matches that a pair needs after each batch to stay."""
    rows = 8 if threshold >= 0.85 else 6 if threshold >= 0.7 else 3
    bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
    size = -(-bands * rows // BATCH) * BATCH
    least, per_batch = [], miss / (size // BATCH)
    for n in range(BATCH, size + 1, BATCH):
        # uniform prior: P(similarity >= t | m of n agree) is the chance that n + 1 trials of t give at most m
        total, m = 0.0, -1
        while total < per_batch:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        least.append(m)
    return bands, rows, tuple(least)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, exactly."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def matching(sigs_a: np.ndarray, sigs_b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Which of the pairs of signatures every batch's posterior bound lets pass."""
    open_ = np.arange(len(sigs_a))
    agree = np.zeros(len(sigs_a), np.int64)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        agree[open_] += (sigs_a[open_, part] == sigs_b[open_, part]).sum(axis=1)
        open_ = open_[agree[open_] >= need]
    return open_


def unit_links(sigs: np.ndarray, sets: list[np.ndarray], components: list[bytes], side: np.ndarray, band: int, percent: int, miss: float) -> list[tuple[int, int]]:
    """Verified links that connect different components among the members of a bucket.

    Pairs whose first common band is another one are left to that band's bucket.  Where side
    holds 0 and 1, only pairs across count.
    """
    bands_n, rows, least = plan(percent / 100, miss)
    bands = np.array([band_hashes(s, bands_n, rows) for s in sigs]).reshape(len(sigs), bands_n)
    number: dict[bytes, int] = {}
    label = np.array([number.setdefault(c, len(number)) for c in components])
    across, places = bool(side.any()), np.arange(len(sigs))
    found = []
    for i in range(len(sigs)):
        if across and side[i]:
            continue
        mates = np.flatnonzero(((side == 1) if across else (places > i)) & (label != label[i]))
        if len(mates):
            mates = mates[(bands[mates] == bands[i]).argmax(axis=1) == band]
            mates = mates[matching(np.broadcast_to(sigs[i], (len(mates), sigs.shape[1])), sigs[mates], least)]
            found.append(np.stack([np.full(len(mates), i), mates], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    agree = (sigs[pairs[:, 0]] == sigs[pairs[:, 1]]).sum(axis=1)
    root = list(range(len(number)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in np.argsort(-agree, kind="stable").tolist():
        a, b = pairs[i].tolist()
        if (x := find(label[a])) != (y := find(label[b])) and linked(sets[a], sets[b], percent):
            root[x] = y
            out.append((a, b))
    return out


def _nodes(docs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    bands, rows, least = plan(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            counts, nodes, keys = [], [], []
            done: dict[bytes, list[int]] = {}
            for s in shingle_sets([t or "" for t in batch.column(2).to_pylist()], k):
                node = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                if node and node not in done:
                    done[node] = band_hashes(signature(s, bands * rows), bands, rows).tolist()
                counts.append(len(s))
                nodes.append(node)
                keys.append(done[node] if node else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "th", "n_shingles", "node", "bands"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "xxhash64(cast(text as string)) th", "cast(text as string) text").mapInArrow(run, NODES)


def _members(texts: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """key, signature and shingle hashes of nodes (key, text)."""
    size = len(plan(percent / 100, miss)[2]) * BATCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            sets = list(shingle_sets(batch.column(1).to_pylist(), k))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signature(s, size).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "sig", "shingles"])

    return texts.select("key", "text").mapInArrow(run, "key binary, sig binary, shingles binary")


def _hub_links(ties: DataFrame, members: DataFrame, percent: int, miss: float) -> DataFrame:
    """Verified links among ties (key, hub): a plain join on both sides, a hub's row repeated where it has many ties."""
    least = plan(percent / 100, miss)[2]
    parts = ties.groupBy("hub").agg(F.ceil(F.count("*") / HUB_TIES).cast("int").alias("parts"))
    hubs = members.join(parts, F.col("key") == F.col("hub")).select("hub", F.col("sig").alias("hub_sig"), F.col("shingles").alias("hub_shingles"), "parts")
    hubs = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = ties.join(parts, "hub").select("hub", "key", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    pairs = dealt.join(members, "key").join(hubs, ["hub", "part"]).select("key", "hub", "sig", "hub_sig", "shingles", "hub_shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            sigs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in (2, 3)]
            good = [i for i in matching(*sigs, least).tolist() if linked(np.frombuffer(batch.column(4)[i].as_py(), np.uint64), np.frombuffer(batch.column(5)[i].as_py(), np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def _bucket_links(found: DataFrame, members: DataFrame, percent: int, miss: float) -> DataFrame:
    """Verified links among members (band, h, key, component) of buckets that hold several components."""
    held = members.select("key", (F.octet_length("sig") + F.octet_length("shingles")).cast("long").alias("bytes"))
    sizes = found.join(held, "key").groupBy("band", "h", "component").agg(F.sum("bytes").alias("size"))
    # chunks of a large component are its own, small components share some by their hash
    pooled = sizes.withColumn("small", F.col("size") < CHUNK_BYTES)
    totals = pooled.groupBy("band", "h").agg(F.sum(F.when(F.col("small"), F.col("size")).otherwise(0)).alias("pool"))
    own = pooled.where("not small").select("band", "h", F.col("component").alias("group"), F.ceil(F.col("size") / CHUNK_BYTES).cast("int").alias("chunks"))
    pool = totals.where("pool > 0").select("band", "h", F.lit(None).cast("binary").alias("group"), F.ceil(F.col("pool") / CHUNK_BYTES).cast("int").alias("chunks"))
    groups = own.unionByName(pool)
    placed = found.join(pooled.select("band", "h", "component", F.when(~F.col("small"), F.col("component")).alias("group")), ["band", "h", "component"])
    same = lambda a, b: (F.col(f"{a}.band") == F.col(f"{b}.band")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    dealt = placed.alias("p").join(groups.alias("g"), same("p", "g") & F.col("p.group").eqNullSafe(F.col("g.group"))).select("p.band", "p.h", "p.key", "p.component", "p.group", F.pmod(F.xxhash64(F.lit(3), F.when(F.col("p.group").isNull(), F.col("p.component")).otherwise(F.col("p.key"))), F.col("g.chunks")).cast("int").alias("chunk"))
    # the other chunks of the bucket that a member meets; a large component never meets itself
    others = groups.select("band", "h", F.col("group").alias("other"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other_chunk")).groupBy("band", "h").agg(F.collect_list(F.struct("other", "other_chunk")).alias("others"))
    wide = dealt.join(others, ["band", "h"]).select("band", "h", "key", "component", "group", "chunk", F.explode("others").alias("o"))
    wide = wide.where(F.col("group").isNull() | ~F.col("group").eqNullSafe(F.col("o.other")))
    name = lambda group, chunk: F.concat_ws("/", F.coalesce(F.hex(group), F.lit("")), chunk.cast("string"))
    mine, theirs = name(F.col("group"), F.col("chunk")), name(F.col("o.other"), F.col("o.other_chunk"))
    units = wide.select("band", "h", F.least(mine, theirs).alias("i"), F.greatest(mine, theirs).alias("j"), (mine > theirs).cast("int").alias("side"), "key", "component")
    full = units.join(members, "key")

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        keys = table.column("key").to_pylist()
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(keys), -1)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        links = unit_links(sigs, sets, table.column("component").to_pylist(), table.column("side").to_numpy(), table.column("band")[0].as_py(), percent, miss)
        return pa.table({"a": pa.array([keys[x] for x, _ in links], pa.binary()), "b": pa.array([keys[y] for _, y in links], pa.binary())})

    return full.groupBy("band", "h", "i", "j").applyInArrow(verify, "a binary, b binary")


_SIGN = -(1 << 63)


def _key(doc_id, node):
    """Bytes that sort by id (nulls last), then by digest."""
    turned = F.unhex(F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(_SIGN))), 16, "0"))
    return F.concat(F.when(doc_id.isNull(), F.unhex(F.lit("01" + "00" * 8))).otherwise(F.concat(F.unhex(F.lit("00")), turned)), node)


def _key_id(key):
    """The id in a key, or null."""
    number = F.conv(F.hex(F.substring(key, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))
    return F.when(F.hex(F.substring(key, 1, 1)) == "00", number)


def _joined(docs: DataFrame, k: int, percent: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, n_shingles, node), and nodes: node, key, component, doc_id, th, and how many rows have both."""
    if not 1 <= k <= len(_random()["words"]):
        raise ValueError(f"shingles have 1 to {len(_random()['words'])} words")
    rows = written(_nodes(docs, k, percent, miss), "nd-rows")
    some = rows.where("node is not null").groupBy("node", "doc_id", "th").agg(F.count("*").alias("rows"), F.first("bands").alias("bands"))
    reps = some.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "rows", "bands")).alias("r")).select("node", "r.doc_id", "r.th", "r.rows", "r.bands")
    reps = written(reps.withColumn("key", _key(F.col("doc_id"), F.col("node"))), "nd-nodes")
    banded = reps.select("key", F.posexplode("bands").alias("band", "h"))
    buckets = banded.groupBy("band", "h").agg(F.min("key").alias("hub"), F.count("*").alias("size")).where("size > 1").drop("size")
    shared = written(banded.join(buckets, ["band", "h"]), "nd-shared")
    candidates = reps.join(shared.select("key").distinct(), "key").select("key", F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    found = text.join(candidates, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    members = written(_members(found, k, percent, miss), "nd-members").dropDuplicates(["key"])
    ties = shared.where("key <> hub").select("key", "hub").distinct()
    first = written(_hub_links(ties, members, percent, miss), "nd-hub-links")
    joined = components(first, "a", "b")
    named = shared.join(joined, F.col("key") == F.col("node"), "left").select("band", "h", "key", F.coalesce("component", "key").alias("component"))
    named = written(named, "nd-named")
    several = named.groupBy("band", "h").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("band", "h")
    more = written(_bucket_links(written(named.join(several, ["band", "h"]), "nd-open"), members, percent, miss), "nd-links")
    final = components(first.unionByName(more), "a", "b").select(F.col("node").alias("_k"), "component")
    nodes = reps.join(final, F.col("key") == F.col("_k"), "left").select("node", "key", F.coalesce("component", "key").alias("component"), "doc_id", "th", "rows")
    return rows, nodes


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, and ``node`` (null: empty set)."""
    rows, nodes = _joined(docs, shingle_words, percent, miss)
    named = nodes.select(F.col("node").alias("_n"), _key_id(F.col("component")).alias("component_id"))
    out = rows.drop("bands", "th").join(named, F.col("node") == F.col("_n"), "left").drop("_n")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "node").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, shingle_words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """The rows of docs, all columns as they are: one of each component, and all without words."""
    _, nodes = _joined(docs, shingle_words, percent, miss)
    wanted = nodes.where("key = component").select("doc_id", F.col("th").alias("text_hash"), F.lit(1).alias("times"), "rows")
    words = F.coalesce(F.col("text").cast("string").rlike(WORD_PATTERN), F.lit(False))
    keys = {"doc_id": F.col("doc_id").cast("long"), "text_hash": text_hash(F.col("text"))}
    return taken_rows(docs.where(words), keys, wanted).unionByName(docs.where(~words))
