"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Each text is reduced to statistics; random Fourier features of the standardised statistics
approximate a Gaussian kernel.  Workers sum X'X and X'y over their rows, the sums are added
up, and the ridge solution is one small linear system.  Isotonic regression of the labels on
ridge scores (of other folds than a row's own) maps scores to probabilities.

Defined cases: null and empty texts have the statistics of an empty text and are scored as
such; without labelled rows every score is 0.5, with one kind of label all scores are that
label; repeated rows and null ids keep one result row each (null ids are not held out);
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, written
from .labelled import SAMPLE, held_out, training_rows

FEATURES, WIDTH, RIDGE, FOLDS = 256, 3.0, 1.0, 4
WITHIN = 1e-3
_SIGNS = re.compile(rb"[!-/:-@\[-`{-~]{2,}")


def statistics(text: str) -> list[float]:
    """What a text looks like, in numbers that don't depend on its language."""
    raw = text.encode()
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = raw.split(b"\n")
    w = max(1, len(words))
    tally = Counter(words)
    common = tally.most_common(1)[0][1] if tally else 0
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    signs = counts[33:127].sum() - upper - lower - digits
    share = counts[counts > 0] / n
    filled = [x for x in lines if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(lines)), len(raw) / w,
        upper / n, lower / n, digits / n, signs / n, counts[128:].sum() / n, counts[10] / n,
        sum(map(len, _SIGNS.findall(raw))) / n, sum(counts[list(b"|#%&*$!<>{}=_~^@+")]) / w, counts[ord(".")] / w, counts[ord(",")] / w,
        len(tally) / w, common / w, same / w, len(set(filled)) / max(1, len(filled)), max(map(len, words), default=0) / 50, float(-(share * np.log2(share)).sum()),
        sum(x[-1:] in b"!%&*$#|" for x in words) / w, sum(x.isupper() for x in words) / w,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    steps: np.ndarray  # ridge scores
    values: np.ndarray  # calibrated values at them

    def expand(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated values; within a block of equal ones, the ridge score still ranks by ``WITHIN`` at most."""
        ridge = self.expand(x) @ self.beta
        level = np.interp(ridge, self.steps, self.values)
        rank = 1 / (1 + np.exp(-np.clip(4 * (ridge - 0.5), -30, 30)))
        return np.clip(level * (1 - WITHIN) + WITHIN * (rank if self.beta.any() else level), 0, 1)


def expand(z: np.ndarray, features: int = FEATURES, seed: int = 99) -> np.ndarray:
    """Intercept, the statistics themselves, and random Fourier features (fixed seed)."""
    rng = np.random.default_rng(seed)
    z = np.clip(z, -6, 6)
    w = rng.normal(0, 1 / WIDTH, (z.shape[1], features))
    phase = rng.uniform(0, 2 * np.pi, features)
    return np.column_stack([np.ones(len(z)), z, np.sqrt(2 / features) * np.cos(z @ w + phase)])


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; ties are pooled first.  Scores and values of the blocks' ends."""
    order = np.argsort(scores, kind="stable")
    at, first = np.unique(scores[order], return_index=True)
    sums, sizes = np.add.reduceat(labels[order], first), np.diff(first, append=len(order))
    blocks: list[list[float]] = []
    for x, total, n in zip(at.tolist(), sums.tolist(), sizes.tolist(), strict=True):
        blocks.append([total, n, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n, _, end = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += n
            blocks[-1][3] = end
    # a little prior keeps small end blocks off 0 and 1
    prior = float(labels.mean())
    values = [(t + prior) / (n + 1) for t, n, _, _ in blocks]
    values = np.maximum.accumulate(values)
    return np.array([e for b in blocks for e in b[2:]]), np.repeat(values, 2)


def _sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """X'X and X'y of each fold: summed in the workers, then in a few groups, then here."""

    def pack(parts: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        keys = sorted(parts)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array([parts[k][i].tobytes() for k in keys], pa.binary()) for i in (0, 1))], names=["fold", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for batch in arrow_rows(batches):
            x = expand((np.array(batch.column(0).to_pylist()) - mean) / scale)
            y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in np.unique(fold).tolist():
                own = x[fold == k]
                a, b = own.T @ own, own.T @ y[fold == k]
                parts[k] = [parts[k][0] + a, parts[k][1] + b] if k in parts else [a, b]
        yield pack(parts)

    def add(table: pa.Table) -> pa.Table:
        parts: dict[int, list[np.ndarray]] = {}
        for row in table.to_pylist():
            new = [np.frombuffer(row["a"]), np.frombuffer(row["b"])]
            parts[row["fold"]] = [p + q for p, q in zip(parts[row["fold"]], new, strict=True)] if row["fold"] in parts else new
        return pa.Table.from_batches([pack(parts)])

    partial = rows.select("f", F.col("label").cast("double"), "fold").mapInArrow(run, "fold int, a binary, b binary")
    partial = partial.withColumn("g", F.pmod(F.xxhash64("a"), F.lit(8))).groupBy("fold", "g").applyInArrow(lambda t: add(t.select(["fold", "a", "b"])), "fold int, a binary, b binary")
    found: dict[int, list[np.ndarray]] = {}
    for r in partial.collect():  # at most FOLDS * 8 rows
        new = [np.frombuffer(bytes(r.a)), np.frombuffer(bytes(r.b))]
        found[r.fold] = [p + q for p, q in zip(found[r.fold], new, strict=True)] if r.fold in found else new
    size = len(next(iter(found.values()))[1])
    zero = [np.zeros(size * size), np.zeros(size)]
    return [(a.reshape(size, size), b) for a, b in (found.get(k, zero) for k in range(FOLDS))]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """The classifier, from a bounded sample of labelled rows."""

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            x = [statistics(t) for t in batch.column(0).to_pylist()]
            fold = [len(t) * 7919 % 104729 % FOLDS for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), pa.array(fold, pa.int32())], names=["f", "label", "fold"])

    rows = written(training_rows(docs, labels, label, sample).mapInArrow(stats, "f array<double>, label int, fold int"), "quality-stats")
    size = len(statistics(""))
    moments = rows.agg(*[F.avg(F.get("f", F.lit(i))) for i in range(size)], *[F.stddev_pop(F.get("f", F.lit(i))) for i in range(size)], F.count("*"), F.avg("label")).first()
    n, share = moments[-2], moments[-1]
    if not n or share in (0.0, 1.0):
        level = 0.5 if not n else share
        return Model(np.zeros(size), np.ones(size), np.zeros(1 + size + FEATURES), np.array([0.0]), np.array([level]))
    mean, scale = np.array(moments[:size]), np.array([x if x > 1e-9 else 1.0 for x in moments[size : 2 * size]])
    sums = _sums(rows, mean, scale)

    def solve(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        a, b = sum(p[0] for p in parts), sum(p[1] for p in parts)
        penalty = np.full(len(b), RIDGE)
        penalty[0] = 1e-6
        return np.linalg.solve(a + np.diag(penalty), b)

    others = [solve([s for j, s in enumerate(sums) if j != k]) for k in range(FOLDS)]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            x = expand((np.array(batch.column(0).to_pylist()) - mean) / scale)
            fold = batch.column(2).to_numpy()
            s = np.einsum("ij,ij->i", x, np.stack(others)[fold])
            yield pa.RecordBatch.from_arrays([pa.array(s), batch.column(1)], names=["s", "label"])

    pairs = np.array([tuple(r) for r in rows.mapInArrow(judged, "s double, label int").collect()])  # at most ``sample`` rows
    steps, values = isotonic(pairs[:, 0], pairs[:, 1])
    return Model(mean, scale, solve(sums), steps, values)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            x = np.array([statistics(t or "") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filtered(docs: DataFrame, model: Model, keep, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, for which ``keep(score >= threshold)`` holds; no join, one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            x = np.array([statistics(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
            yield batch.filter(pa.array(keep(model.score(x) >= threshold)))

    return docs.mapInArrow(run, docs.schema)
