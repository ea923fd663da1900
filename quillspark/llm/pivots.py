"""Exact top-k search by inner product, with pivot-table elimination.

Vectors become integers floor(256 x).  The pivot table holds each vector's precomputed
distances to the pivots and to the origin.  The largest lower bound of |v - q| that these
distances allow is that of the simplex over the pivots (which is never below any single
pivot's | |v - p| - |q - p| |): with a and r for what a vector has inside and outside the
pivots' span, q v <= a_q a_v + r_q r_v.  Candidates are evaluated in the order of that bound,
in batches that double, until the k-th score exceeds all bounds left, so the answer is exact
whatever the pivots.

Distribution: a candidate belongs to the cell of its nearest pivot, and a cell is dealt to
parts of about ``GROUP_ROWS`` rows.  A query's k-th score in the pivots' sample is a floor of
its final one; with the cell's least and largest distances to every pivot it rules out whole
cells, whose parts that query is never sent to.  Queries go in blocks of about ``QUERY_ROWS``;
a task gets one (part, block), so a stated query set meets all rows in blocks and nothing
unbounded meets in one place.  Each keeps its k + 1 best rows per query, and these are ranked
per query.  Pivots are chosen by farthest-first from a bounded sample (the ``SAMPLE`` rows of
smallest hash); they and the sample only affect speed.

Defined cases: vectors that are null, empty, or hold null or non-finite components (also
after the factor 256) take no part; vectors meet only vectors of their own length; scores are
exact whole numbers of any size, and one beyond 64 bits is returned as the nearest 64-bit
number; a query leaves out one row that equals it in id and vector (itself), so other rows
with its id stay candidates; each repeated query row has its own ranks; null ids take part as
candidates (last on ties) but not as queries; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, written

GROUP_ROWS, QUERY_ROWS, PIVOTS, SAMPLE = 16_384, 8_192, 56, 2_048
FIRST_BATCH = 64
#: What float32 bounds may be off, as a share of both lengths.
MARGIN = 2e-5
PACKED = "dim int, cell int, part bigint, block bigint, query boolean, wide boolean, ids binary, nulls binary, vectors binary, units binary, floors binary, rows binary"
FOUND = "row bigint, query_id bigint, vec_id bigint, score bigint, self boolean, evaluated bigint"
_NAMES = [c.split()[0] for c in PACKED.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.binary()] * 6]


def integers(vectors: Column) -> Column:
    """floor(256 x) of a vector as whole doubles (exact), or null where a component is null or not finite."""
    wide = F.transform(vectors, lambda x: x.cast("double") * 256)
    fit = F.forall(wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    # a double beyond 2^52 is whole already
    return F.when((F.size(wide) > 0) & fit, F.transform(wide, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)))


def _lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x**2).sum(1))


@dataclass
class Pivots:
    """Pivots of one vector length, an orthonormal basis of their span, and the sample they are from."""

    points: np.ndarray
    basis: np.ndarray
    sample: np.ndarray

    @classmethod
    def of(cls, values: list, count: int) -> Pivots:
        x = np.array(values, np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            far, chosen = np.full(len(x), np.inf), []
            while len(chosen) < min(count, len(x)) and np.nanmax(far) > 0:
                at = int(np.nanargmax(far))
                chosen.append(at)
                far = np.minimum(far, ((x - x[at]) ** 2).sum(axis=1))
        points = x[chosen]
        top = np.abs(points).max(axis=1, keepdims=True)
        _, s, basis = np.linalg.svd(points / np.where(top > 0, top, 1), full_matrices=False)
        return cls(points, basis[s > 1e-9 * max(1.0, s.max(initial=0.0))], x)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """The pivot table's rows."""
        p = self.points
        with np.errstate(over="ignore", invalid="ignore"):
            return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * x @ p.T))

    def cells(self, dist: np.ndarray) -> np.ndarray:
        """The nearest pivot of each row."""
        return np.nan_to_num(dist, nan=np.inf).argmin(axis=1) if dist.shape[1] else np.zeros(len(dist), np.int64)

    def units(self, x: np.ndarray) -> np.ndarray:
        """Of each vector at length 1: coordinates in the pivots' span, and last the length outside it."""
        top = np.abs(x).max(axis=1, keepdims=True)
        y = x / np.where(top > 0, top, 1)
        size = np.sqrt((y**2).sum(1, keepdims=True))
        y = y / np.where(size > 0, size, 1)
        inside = y @ self.basis.T
        outside = np.sqrt(np.maximum(0, (y**2).sum(1) - (inside**2).sum(1)))
        return np.column_stack([inside, outside]).astype(np.float32)


def _pivots(rows: DataFrame, count: int) -> dict[int, Pivots]:
    """Farthest-first pivots of each vector length, from a sample of bounded size."""
    sample = rows.orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE).select("v").collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r.v), []).append(r.v)
    return {size: Pivots.of(values, count) for size, values in by_size.items()}


def _by_size(batch: pa.RecordBatch, column: int, pivots: dict[int, Pivots]) -> Iterator[tuple[int, np.ndarray, np.ndarray, Pivots]]:
    """(length, places of its rows, their vectors, its pivots) for each vector length in a batch."""
    vectors = batch.column(column)
    offsets = vectors.offsets.to_numpy()
    flat, sizes = vectors.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        x = flat[offsets[:-1][own][:, None] + np.arange(size)].astype(np.float64)
        yield size, own, x, pivots.get(size) or Pivots(np.zeros((0, size)), np.zeros((0, size)), np.zeros((0, size)))


@dataclass
class Cell:
    """How many rows a cell has, their greatest length, and their least and greatest distances to all pivots."""

    rows: int
    length: float
    least: np.ndarray
    most: np.ndarray

    def with_(self, other: Cell) -> Cell:
        return Cell(self.rows + other.rows, max(self.length, other.length), np.minimum(self.least, other.least), np.maximum(self.most, other.most))

    def reach(self, length: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """The greatest score that a row here can have with each query."""
        gap = np.maximum(np.maximum(self.least - dist, dist - self.most), 0).max(axis=1, initial=0.0)
        with np.errstate(over="ignore", invalid="ignore"):
            bound = (length**2 + self.length**2 - (gap * (1 - 1e-9)) ** 2) / 2
            return np.nan_to_num(np.minimum(bound, length * self.length), nan=np.inf) + 1e-9 * (length**2 + self.length**2) + 1


def _cells(rows: DataFrame, pivots: dict[int, Pivots]) -> dict[tuple[int, int], Cell]:
    """All cells: one partial row a task and cell, so at most tasks x pivots x vector lengths rows arrive here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], Cell] = {}
        for batch in arrow_rows(batches):
            for size, _, x, p in _by_size(batch, 0, pivots):
                dist, lengths = p.distances(x), _lengths(x)
                cell = p.cells(dist)
                for c in np.unique(cell).tolist():
                    own = cell == c
                    new = Cell(int(own.sum()), float(lengths[own].max()), dist[own].min(axis=0), dist[own].max(axis=0))
                    found[size, c] = found[size, c].with_(new) if (size, c) in found else new
        keys = list(found)
        columns = [[k[0] for k in keys], [k[1] for k in keys], [c.rows for c in found.values()], [c.length for c in found.values()], [c.least for c in found.values()], [c.most for c in found.values()]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), *[pa.list_(pa.float64())] * 2]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["dim", "cell", "n", "length", "least", "most"])

    partial = rows.select("v").mapInArrow(run, "dim int, cell int, n bigint, length double, least array<double>, most array<double>")
    width = range(max((len(p.points) for p in pivots.values()), default=0))
    each = lambda name, of: F.array(*[of(F.get(name, F.lit(i))) for i in width]).cast("array<double>").alias(name)
    sums = partial.groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.max("length").alias("length"), each("least", F.min), each("most", F.max))
    clean = lambda values: np.array([x for x in values if x is not None], np.float64)
    return {(r.dim, r.cell): Cell(r.n, r.length, clean(r.least), clean(r.most)) for r in sums.collect()}


def _blob(head: tuple, query: bool, ids: np.ndarray, nulls: np.ndarray, x: np.ndarray, units: np.ndarray, floors: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    wide = bool(np.abs(x).max(initial=0) >= 1 << 31)
    blobs = (ids, nulls, x if wide else x.astype(np.int32), units, floors, rows)
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*head, query, wide, *(np.ascontiguousarray(b).tobytes() for b in blobs)), _KINDS, strict=True)], names=_NAMES)


def _packed(rows: DataFrame, pivots: dict[int, Pivots], cells: dict[tuple[int, int], Cell], k: int, query: bool, blocks: int) -> DataFrame:
    """Candidates as blobs of their cell's parts, or queries as blobs of a block for every cell they can't rule out."""

    def floors_of(x: np.ndarray, lengths: np.ndarray, p: Pivots) -> np.ndarray:
        """What the k-th score of each query is at least: the sample's, where the query itself may be one more."""
        if len(p.sample) <= k:
            return np.full(len(x), -np.inf)
        with np.errstate(over="ignore", invalid="ignore"):
            scores = x @ p.sample.T
            least = np.partition(scores, -k - 1, axis=1)[:, -k - 1] - 1 - 1e-9 * lengths * _lengths(p.sample).max()
        return np.nan_to_num(least, nan=-np.inf, posinf=-np.inf, neginf=-np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            names, nulls = batch.column(0).to_numpy(), np.array(batch.column(1).is_null())
            ids = batch.column(1).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            spread = batch.column(3).to_numpy()
            for size, own, x, p in _by_size(batch, 2, pivots):
                dist, units, lengths = p.distances(x), p.units(x), _lengths(x)
                floors = floors_of(x, lengths, p) if query else np.zeros(0)
                cell = p.cells(dist)
                for (dim, c), box in cells.items():
                    if dim != size:
                        continue
                    deal = blocks if query else max(1, -(-box.rows // GROUP_ROWS))
                    fits = np.flatnonzero(box.reach(lengths, dist) >= floors) if query else np.flatnonzero(cell == c)
                    for number in np.unique(spread[own[fits]] % deal).tolist():
                        part = fits[spread[own[fits]] % deal == number]
                        head = (size, c, -1, number) if query else (size, c, number, -1)
                        yield _blob(head, query, ids[own[part]], nulls[own[part]], x[part], units[part], floors[part] if query else floors, names[own[part]])

    return rows.select("row", "vec_id", "v", F.pmod(F.xxhash64("row"), F.lit(1 << 40)).alias("spread")).mapInArrow(run, PACKED)


def _rows_of(table: pa.Table, dim: int) -> tuple[np.ndarray, ...]:
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    parts = [np.frombuffer(v, np.float64 if w else np.int32).reshape(-1, dim) for v, w in zip(table.column("vectors").to_pylist(), table.column("wide").to_pylist(), strict=True)]
    x = np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, dim))
    units = join("units", np.float32).reshape(len(x), -1) if len(x) else np.zeros((0, 1), np.float32)
    return join("ids", np.int64), join("nulls", bool), x, units, join("floors", np.float64), join("rows", np.int64)


def _best(scores: np.ndarray, k: int):
    """The k-th greatest score."""
    return sorted(scores.tolist())[-k] if scores.dtype == object else np.partition(scores, -k)[-k]


def _search(ids: np.ndarray, x: np.ndarray, q: np.ndarray, bound: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best rows for one query, in bound order until none left can be one, and how many rows were evaluated."""
    seen, scores = np.zeros(0, np.int64), np.zeros(0, x.dtype)
    open_ = np.flatnonzero(bound >= floor)
    if len(open_) > FIRST_BATCH:
        first = open_[np.argpartition(-bound[open_], FIRST_BATCH - 1)[:FIRST_BATCH]]
        seen, scores = first, x[first] @ q
        least = max(floor, _best(scores, k)) if len(scores) >= k else floor
        left = np.ones(len(bound), bool)
        left[first] = False
        open_ = open_[left[open_] & (bound[open_] >= least)]
    open_ = open_[np.argsort(-bound[open_], kind="stable")]
    size, at = 2 * FIRST_BATCH, 0
    while at < len(open_) and (len(scores) < k or bound[open_[at]] >= _best(scores, k)):
        new = open_[at : at + size]
        seen, scores = np.concatenate([seen, new]), np.concatenate([scores, x[new] @ q])
        at, size = at + size, 2 * size
    if scores.dtype == object:
        best = np.array(sorted(range(len(seen)), key=lambda i: (-scores[i], ids[seen[i]]))[:k], np.int64)
    else:
        best = np.lexsort((ids[seen], -scores))[:k]
    return seen[best], scores[best], len(seen)


def top_k(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", every: int = 50, k: int = 5, pivots: int = PIVOTS, figures: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row whose id is divisible by ``every``.

    With ``figures`` there are two more columns: how many rows were evaluated for the query, and how many there are.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), integers(F.col(column)).alias("v")).where("v is not null")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "pivot-rows")
    is_query = F.col("vec_id") % every == 0
    n, nq = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks = max(1, math.ceil(nq / QUERY_ROWS))
    chosen = _pivots(rows, pivots)
    cells = _cells(rows, chosen)
    asked = written(_packed(rows.where(is_query), chosen, cells, k, True, blocks), "pivot-queries")
    parts = F.lit(1)
    for (dim, c), box in cells.items():
        if box.rows > GROUP_ROWS:
            parts = F.when((F.col("dim") == dim) & (F.col("cell") == c), -(-box.rows // GROUP_ROWS)).otherwise(parts)
    right = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1).cast("array<bigint>")))
    # only cells that some query of a block can't rule out are sent to it; Catalyst sees the small side's size
    visits = asked.select("dim", "cell", "block").distinct()
    left = _packed(rows, chosen, cells, k, False, blocks).drop("block").join(visits, ["dim", "cell"]).select(*_NAMES)

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        mask = table.column("query")
        ids, nulls, x, units, _, _ = _rows_of(table.filter(pa.compute.invert(mask)), dim)
        qids, _, q, qunits, floors, qrows = _rows_of(table.filter(mask), dim)
        out: list[tuple] = []
        if len(x) and len(q):
            lengths, qlengths = _lengths(x), _lengths(q)
            # every partial sum is at most |q| |v| times a small factor: exact in the chosen type
            top = lengths.max() * qlengths.max() * 2
            kind = np.float32 if top < 1 << 23 else np.float64 if top < 1 << 52 else np.int64 if top < 1 << 62 else object
            whole = lambda m: np.array([[int(c) for c in r] for r in m.tolist()], object) if kind is object else m.astype(kind)
            x, numbers = whole(x), whole(q)
            for begin in range(0, len(q), 128):
                cosines = (qunits[begin : begin + 128] @ units.T).astype(np.float64) + MARGIN
                for i in range(begin, min(begin + 128, len(q))):
                    with np.errstate(over="ignore", invalid="ignore"):
                        bound = np.nan_to_num(cosines[i - begin] * (lengths * qlengths[i]), nan=np.inf) + 1
                    at, scores, evaluated = _search(ids, x, numbers[i], bound, floors[i], k + 1)
                    for v, z, s, place in zip(ids[at].tolist(), nulls[at].tolist(), scores.tolist(), at.tolist(), strict=True):  # the figure stands on the first row
                        same = not z and v == qids[i] and bool((x[place] == numbers[i]).all())
                        out.append((int(qrows[i]), int(qids[i]), None if z else v, max(-(1 << 63), min((1 << 63) - 1, int(s))), same, evaluated))
                        evaluated = 0
        kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64()]
        columns = zip(*out, strict=True) if out else [[]] * 6
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

    found = left.unionByName(right.select(*_NAMES)).groupBy("dim", "cell", "part", "block").applyInArrow(run, FOUND)
    # one row that equals the query is the query itself
    own = Window.partitionBy("row").orderBy(F.desc("self"), F.desc("score"), F.asc_nulls_last("vec_id"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    if figures:
        found = found.withColumn("evaluated", F.sum("evaluated").over(Window.partitionBy("row")))
    found = found.withColumn("_own", F.row_number().over(own)).where("not (self and _own = 1)")
    ranked = found.withColumn("rank", F.row_number().over(order))
    more = [F.col("evaluated"), F.lit(n).alias("candidates")] if figures else []
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *more)
