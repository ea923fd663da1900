"""Toxicity: a learned lexicon, matched with misspellings, scored in context.

Learning (on a bounded sample of labelled rows): words, and stems that open several words,
that occur far more often in toxic documents make the lexicon.  Matching: a token is walked
through the intersection of the lexicon's trie with the terms' Levenshtein automata, so a
term counts at edit distance 1 (5 letters or more) or 2 (10 letters or more); a word opens
with a stem only exactly, but words under stems, and stems as words, count misspelt as well.  Context: an
occurrence between quotation marks or near a word of reporting counts as quotation, one near
a word of address as abuse.  A logistic model over these sums gives the score.

Defined cases: null and empty texts have no terms and get the score of such texts; without
labelled rows, or with clean ones alone, every score is 0 (to 17 digits), with toxic ones
alone 1; repeated rows and null ids keep one result row each (null ids
are not held out); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows
from .labelled import SAMPLE, held_out, training_rows

TOKEN = re.compile(r"[\w@$]+")
LEET = str.maketrans("01345@$7", "oieasast")
#: A term needs so many toxic documents, and so large a log ratio at the lower end of its 95 % interval
#: (and so large a part of the best term's; less for stems, which stand for many words).
MIN_DOCS, MIN_RATIO, MIN_PART, STEM_PART, MAX_TERMS = 4, 1.5, 0.5, 0.3, 4_000
STEMS = (4, 5, 6, 7, 8)
WINDOW = 6
# Fixed word lists: verbs of reporting, and words of address.
REPORTING = frozenset("said says quoted quote called wrote word words term dit disait écrit sagte sagt schrieb dijo dice escribió".split())
ADDRESS = frozenset("you your you're u du dich dir ihr euch tu te toi vous usted tú ti".split())
OPENING, CLOSING = "\"“«„", "\"”»“"
#: Verdicts on tokens that one worker remembers.
CACHE = 400_000
#: States of the automaton that one worker remembers.
STATES = 50_000


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def plain(token: str) -> str:
    """Digits and signs that stand for letters, where the token has letters as well."""
    return token if token.isalpha() or token.isdigit() else token.translate(LEET).strip("_")


def edits_allowed(term: str) -> int:
    return 2 if len(term) >= 10 else 1 if len(term) >= 5 else 0


class TrieAutomaton:
    """The Levenshtein automaton of all terms at once: its states are sets of trie nodes with edits so far.

    Sets are made deterministic as tokens ask for them and remembered, so a token costs one
    lookup a character, and most tokens fall out after a few.
    """

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.allowed, self.ends = [0], [""]
        for t in terms:
            node, most = 0, edits_allowed(t)
            for c in t:
                self.allowed[node] = max(self.allowed[node], most)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                    self.ends.append("")
                node = self.children[node][c]
            self.allowed[node] = max(self.allowed[node], most)
            self.ends[node] = t
        self.forget()

    def forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.moves: list[dict[str, int]] = []
        self.begin = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """Number of a set, after adding what skipped letters of terms reach."""
        stack = list(nodes.items())
        while stack:
            node, e = stack.pop()
            if nodes.get(node) == e:
                for below in self.children[node].values():
                    if e + 1 <= self.allowed[below] and e + 1 < nodes.get(below, 9):
                        nodes[below] = e + 1
                        stack.append((below, e + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            ends = [(e, self.ends[n]) for n, e in nodes.items() if self.ends[n] and e <= edits_allowed(self.ends[n])]
            self.accepts.append(min(ends, default=None))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, e in self.sets[state].items():
            for letter, below in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.allowed[below] and cost < after.get(below, 9):
                    after[below] = cost
            if e + 1 <= self.allowed[node] and e + 1 < after.get(node, 9):
                after[node] = e + 1
        self.moves[state][c] = to = self._state(after) if after else -1
        return to

    def find(self, token: str) -> tuple[int, str] | None:
        """Edits and term of the nearest term within its own limit."""
        if len(self.sets) > STATES:
            self.forget()
        state = self.begin
        for c in token:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return None
        return self.accepts[state]


class Lexicon:
    """Terms and stems with weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.words, self.stems = words, stems
        self.weights = stems | words
        self.automaton = TrieAutomaton(sorted(self.weights))
        self.stem_sizes = sorted({len(x) for x in stems})
        self.seen: dict[str, tuple[str, float] | None] = {}

    def match(self, token: str) -> tuple[str, float] | None:
        """The term that a token stands for, with its weight; less for more edits."""
        if token in self.seen:
            return self.seen[token]
        if len(self.seen) > CACHE:
            self.seen.clear()
        self.seen[token] = out = self._match(plain(token))
        return out

    def _match(self, token: str) -> tuple[str, float] | None:
        for n in self.stem_sizes:
            if token[:n] in self.stems:
                return token[:n], self.stems[token[:n]]
        found = self.automaton.find(token)
        return (found[1], self.weights[found[1]] * 0.7 ** found[0]) if found else None

    def features(self, text: str) -> list[float]:
        """Sums over the matched occurrences: abuse, quotation, address, different terms, and their density."""
        low = text.lower()
        tokens = TOKEN.findall(low)
        seen = self.seen
        hits = []
        for t in set(tokens):
            if (m := seen[t] if t in seen else self.match(t)) is not None:
                hits.append((t, m))
        if not hits:
            return [0.0] * 5
        found = dict(hits)
        places = [(m.start(), i, found[m[0]]) for i, m in enumerate(TOKEN.finditer(low)) if m[0] in found]
        quotes = self._quoted(low)
        abuse = quoted = address = 0.0
        for at, i, (_, weight) in places:
            near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            inside = any(a < at < b for a, b in quotes) if quotes else False
            if inside or any(t in REPORTING for t in near):
                quoted += weight
            else:
                abuse += weight
            if any(t in ADDRESS for t in near):
                address += weight
        terms = len({term for _, _, (term, _) in places})
        return [math.log1p(abuse), math.log1p(quoted), math.log1p(address), math.log1p(terms), math.sqrt(len(places) / len(tokens))]

    @staticmethod
    def _quoted(text: str) -> list[tuple[int, int]]:
        """Spans between quotation marks, of any length, within a line."""
        return [m.span() for m in re.finditer(r"[\"“«„][^\"“”«»„\n]+[\"”»“]", text)] if any(c in text for c in OPENING) else []


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * 6)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _counts(rows: DataFrame, of, schema: str) -> DataFrame:
    """Documents of each label that have a term, summed; ``of`` gives the terms of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in arrow_rows(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[label].update(of(text))
        terms = sorted({*sums[0], *sums[1]})
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([sums[k][t] for t in terms], pa.int64()) for k in (1, 0))], names=["term", "pos", "neg"])

    return rows.mapInArrow(run, schema).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _terms(text: str) -> set[str]:
    """Words, and their stems with a star."""
    words = {w for w in map(plain, set(tokens_of(text))) if len(w) >= 3}
    stems = {w[:n] for n in STEMS for w in words if len(w) > n}
    return words | {f"{x}*" for x in stems}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Lexicon and weights from labelled rows."""
    rows = training_rows(docs, labels, label, sample)
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        share = pos / (pos + neg) if pos else 0.0
        return Model(weights=[40.0 if share == 1 else -40.0, 0, 0, 0, 0, 0])
    p, n = F.col("pos") + 0.5, F.col("neg") + 0.5
    ratio = F.log(p / (pos + 1)) - F.log(n / (neg + 1)) - 1.96 * F.sqrt(1 / p + 1 / n)
    schema = "term string, pos bigint, neg bigint"
    # terms of toxic rows first, so that the counts over all rows stay small: those that reach the ratio if no clean row has them
    best = F.log(p / (pos + 1)) - math.log(0.5 / (neg + 1)) - 1.96 * F.sqrt(1 / p + 2)
    likely = _counts(rows.where("label = 1"), _terms, schema).where((F.col("pos") >= MIN_DOCS) & (best >= MIN_RATIO))
    seen = {r.term: r.pos for r in likely.orderBy(F.desc("pos"), "term").limit(50 * MAX_TERMS).select("term", "pos").collect()}
    wanted = frozenset(seen)
    counted = _counts(rows, lambda text: _terms(text) & wanted, schema)
    strong = counted.withColumn("ratio", ratio).where((F.col("ratio") >= MIN_RATIO) & (F.col("pos") >= MIN_DOCS)).orderBy(F.desc("ratio"), "term").limit(MAX_TERMS).collect()
    weight = {r.term: r.ratio / 2 for r in strong if r.ratio >= (STEM_PART if r.term.endswith("*") else MIN_PART) * strong[0].ratio}
    words = [t for t in weight if not t.endswith("*")]
    most: Counter = Counter()  # documents of the most frequent word under a stem
    for t in seen:
        if not t.endswith("*"):
            for k in STEMS:
                most[t[:k]] = max(most[t[:k]], seen[t])
    stems: dict[str, float] = {}
    for t in sorted((t[:-1] for t in weight if t.endswith("*")), key=lambda t: (len(t), t)):
        if seen[f"{t}*"] > 1.5 * most[t] and not any(t[:k] in stems for k in STEMS):
            stems[t] = weight[f"{t}*"]
    model = Model({w: weight[w] for w in words}, stems)
    kept = rows.select("text", F.col("label").cast("double").alias("label"))
    table = np.array([[r.label, *r.f] for r in kept.mapInArrow(_featured(model, 1), "label double, f array<double>").collect()])
    model.weights = _logistic(table[:, 1:], table[:, 0])
    return model


def _featured(model: Model, label_column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.words, model.stems)
        for batch in arrow_rows(batches):
            rows = [lexicon.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(label_column), pa.array(rows, pa.list_(pa.float64()))], names=["label", "f"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> list[float]:
    """Newton steps for a logistic model with a small ridge and an intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.words, model.stems)
        for batch in arrow_rows(batches):
            x = np.array([lexicon.features(t or "") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filtered(docs: DataFrame, model: Model, keep, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, for which ``keep(score >= threshold)`` holds; no join, one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.words, model.stems)
        for batch in arrow_rows(batches):
            x = np.array([lexicon.features(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
            yield batch.filter(pa.array(keep(model.score(x) >= threshold)))

    return docs.mapInArrow(run, docs.schema)
