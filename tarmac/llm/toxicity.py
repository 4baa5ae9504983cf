"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear SVM.

A text is its units: white-space tokens without punctuation (so ``i.d.i.o.t`` is
one unit), and runs of single letters set apart (``i d i o t``).  Units are
compared by the gap-weighted subsequence kernel of order three, normalised, which
tolerates inserted and left-out characters.  A bounded sample of labelled
documents is cut into labelled sentences, and a squared-hinge SVM is fitted on their units,
embedded by Nystroem's method on landmark units.  Which unit makes a toxic document
toxic isn't known (multiple-instance learning): the first round starts from the units that
stand out in toxic sentences, and every further round adds, from each toxic
document that has none of them, the unit that the last SVM places highest.  The SVM, linear in the kernel with the landmarks, is
folded into one weight per character triple, so scoring needs no landmarks: the
margin of a unit is a weighted sum over its triples divided by its own norm.  A
document's score is a calibrated sigmoid of its largest margin.

Scoring is one pass over the text without any shuffle.

Defined cases: null and empty texts have no unit and get the score of the lowest
margin; units of fewer than three characters are neutral; rows with a null id are
scored and not held out; if the labels hold one class only (or none), every score
is that class's rate.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import text_of

#: Documented bounds: the model is fitted on at most this many labelled documents, of at most this many bytes each.
TRAIN_DOCUMENTS = 3000
TRAIN_BYTES = 1 << 20
LANDMARKS = 120
DECAY = 0.6
THRESHOLD = 0.3
#: Character codes: a-z, then 38 classes for all other letters and digits.
CODES = 64
#: Longer units are seen through overlapping windows of this length.
LONGEST = 24
#: Units whose margins a worker remembers.
REMEMBERED = 500_000

_STRIP = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<!\S)[^\W\d_](?:[ \t.\-_*]+[^\W\d_]){2,}(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_TABLE = np.array([ord(c) - 97 if "a" <= (c := chr(p).lower()[0]) <= "z" else 26 + p % 38 for p in range(0x250)], dtype=np.int64)


def clean(token: str) -> str:
    return _STRIP.sub("", token)


def units_of(text: str) -> set[str]:
    text = text.lower()
    found = set(text.split())
    found.update(m[0] for m in _SPELLED.finditer(text))
    return found


def _windows(unit: str) -> list[str]:
    if len(unit) <= LONGEST:
        return [unit]
    step = LONGEST // 2
    return [unit[i : i + LONGEST] for i in range(0, len(unit) - step, step)]


def pieces(token: str) -> list[str]:
    """What is learned and scored of a token: its windows of three characters or more."""
    return [w for w in _windows(clean(token)) if len(w) >= 3]


def encode(units: list[str], length: int) -> np.ndarray:
    points = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).reshape(len(units), length).astype(np.int64)
    return np.where(points < 0x250, _TABLE[np.minimum(points, 0x24F)], 26 + points % 38)


@cache
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    t = np.array(list(itertools.combinations(range(length), 3)))
    return t, DECAY ** (t[:, 2] - t[:, 0] + 1.0)


def triple_ids(codes: np.ndarray) -> np.ndarray:
    t, _ = _triples(codes.shape[1])
    return (codes[:, t[:, 0]] * CODES + codes[:, t[:, 1]]) * CODES + codes[:, t[:, 2]]


def norms(codes: np.ndarray) -> np.ndarray:
    """sqrt K(s, s) of equally long units: K sums, over pairs of places with equal
    characters, what three such pairs in a row decay to."""
    n, length = codes.shape
    step = np.tril(DECAY ** (np.arange(length)[:, None] - np.arange(length)[None, :]).astype(float), -1)
    same = (codes[:, :, None] == codes[:, None, :]).astype(float)
    s = same * DECAY**2
    for _ in range(2):
        s = (s.reshape(n * length, length) @ step.T).reshape(n, length, length).transpose(0, 2, 1)
        s = (np.ascontiguousarray(s).reshape(n * length, length) @ step.T).reshape(n, length, length).transpose(0, 2, 1) * same
    return np.sqrt(s.sum(axis=(1, 2)))


def feature_rows(units: list[str], columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised explicit features of units of at most LONGEST characters, and their columns.

    ``columns`` (sorted triple ids) are all that the units have, unless given;
    triples outside them are left out, though not from the norm.
    """
    coded = [encode([u], len(u)) for u in units]
    ids = [triple_ids(c)[0] for c in coded]
    if columns is None:
        columns = np.unique(np.concatenate(ids))
    out = np.zeros((len(units), len(columns)), dtype=np.float32)
    for i, (c, found) in enumerate(zip(coded, ids)):
        at = np.minimum(np.searchsorted(columns, found), len(columns) - 1)
        own = columns[at] == found
        np.add.at(out[i], at[own], (_triples(c.shape[1])[1] / norms(c)[0])[own])
    return out, columns


class Scorer:
    """Margins of units and texts under folded weights."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float, constant: float | None = None):
        self.weights, self.bias, self.slope, self.offset, self.constant = weights, bias, slope, offset, constant
        self.known: dict[str, float] = {}

    def margins(self, units: list[str]) -> np.ndarray:
        out = np.full(len(units), -np.inf)
        by_length: dict[int, tuple[list[int], list[str]]] = {}
        for i, u in enumerate(units):
            for w in _windows(u):
                if len(w) >= 3:
                    at, ws = by_length.setdefault(len(w), ([], []))
                    at.append(i)
                    ws.append(w)
        for length, (at, ws) in by_length.items():
            decay = _triples(length)[1].astype(np.float32)
            block = max(1, 2_000_000 // max(len(decay), length * length))
            for start in range(0, len(ws), block):
                codes = encode(ws[start : start + block], length)
                raw = self.weights[triple_ids(codes)] @ decay
                np.maximum.at(out, at[start : start + block], raw / norms(codes))
        return np.where(np.isfinite(out), out, 0.0) + self.bias

    def learn(self, tokens: set[str]) -> None:
        """Remember the margins of tokens."""
        new = [t for t in tokens if t not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(tokens)
        if new:
            self.known.update(zip(new, self.margins([clean(t) for t in new]).tolist()))

    def score(self, margin: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * margin + self.offset))))

    def texts(self, texts: list[str]) -> Iterator[float]:
        if self.constant is not None:
            yield from [self.constant] * len(texts)
            return
        found = [units_of(t) for t in texts]
        for f in self._groups(found):
            self.learn(set().union(*f))
            yield from (self.score(max(map(self.known.__getitem__, u), default=self.bias)) for u in f)

    @staticmethod
    def _groups(found: list[set[str]]) -> Iterator[list[set[str]]]:
        """Lists of texts that together have at most REMEMBERED units (or one text alone)."""
        group, held = [], 0
        for units in found:
            if group and held + len(units) > REMEMBERED:
                yield group
                group, held = [], 0
            group.append(units)
            held += len(units)
        if group:
            yield group

    def of(self, text: str) -> list[float]:
        """Margins of the text's units."""
        units = units_of(text)
        self.learn(units)
        return [self.known[u] for u in units]


def _fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weighted squared-hinge SVM by Newton steps over the violating rows."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        on = y * (x @ w) < 1
        a = x[on] * weight[on, None]
        new = np.linalg.solve(a.T @ x[on] + ridge * np.eye(x.shape[1]), a.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def lower_bound(hits: int, of: int, z: float = 2.0) -> float:
    """Wilson's lower bound of a rate."""
    if not of:
        return 0.0
    p = hits / of
    return (p + z * z / (2 * of) - z * math.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def fit(rows: list[tuple[str, int]], landmarks: int = LANDMARKS, rounds: int = 3) -> Scorer:
    """A Scorer from (text, label) pairs.

    Sentences carry their document's label.  The first positive examples are units whose
    share of toxic places (documents, or different units before them if those are
    fewer, so copies count once) is surely above half, or three times the rate of all
    documents.  Later rounds choose by margin: the witness of a toxic document without
    such a unit is that of the largest margin, if it is positive and the unit isn't
    in more clean documents than toxic ones.  The negatives are the units of the
    other documents, the common ones and, round by round, those that the last SVM
    places highest, which also become landmarks.
    """
    labels = np.array([y for _, y in rows], dtype=int)
    if len(set(labels.tolist())) < 2:
        return Scorer(np.zeros(CODES**3, dtype=np.float32), 0.0, 1.0, 0.0, constant=float(labels[0]) if len(labels) else 0.0)
    clean_in: Counter = Counter()
    toxic_in: Counter = Counter()
    contexts: dict[str, set[str]] = {}  # of units in toxic sentences: the units before them
    sentences: set[frozenset[str]] = set()
    bags: list[list[str]] = []  # the units of each toxic document
    for text, label in rows:
        found = {w for t in units_of(text) for w in pieces(t)}
        if not label:
            clean_in.update(found)
            continue
        toxic_in.update(found)
        bags.append(sorted(found))
        for part in _SENTENCE.split(text):
            chain = [*part.lower().split(), *(m[0] for m in _SPELLED.finditer(part.lower()))]
            for before, token in zip(["", *map(clean, chain)], chain):
                for w in pieces(token):
                    contexts.setdefault(w, set()).add(before)
            sentences.add(frozenset(w for t in chain for w in pieces(t)))
    bound = min(0.9, max(0.5, 3 * labels.mean()))
    support = {u: min(len(c), toxic_in[u]) for u, c in contexts.items()}
    rate = {u: lower_bound(c, c + clean_in[u]) for u, c in support.items()}
    telling = {u for u, c in support.items() if c >= 3 and rate[u] > bound}
    if not telling:  # weak labels: the best there are
        telling = set(sorted(rate, key=lambda u: (-rate[u], u))[:8])
    positive = Counter(u for part in sentences for u in part & telling)
    if not positive:
        return Scorer(np.zeros(CODES**3, dtype=np.float32), 0.0, 1.0, 0.0, constant=float(labels.mean()))
    first = positive
    bags = [bag for bag in bags if first.keys().isdisjoint(bag)]
    suspects = sorted({u for bag in bags for u in bag if clean_in[u] < toxic_in[u]})
    common = [u for u in sorted(clean_in, key=lambda u: (-clean_in[u], u)) if u not in positive]
    everyday = sorted(common)
    negatives = dict.fromkeys(common[:2000])
    hardest: list[str] = []
    weights, bias = np.zeros(CODES**3, dtype=np.float32), -1.0
    for turn in range(rounds):
        names = sorted(positive, key=lambda u: (-positive[u], u))
        marks = [*dict.fromkeys([*names[:landmarks], *hardest[:landmarks], *common[: landmarks // 2]])]
        features, columns = feature_rows(marks)
        values, vectors = np.linalg.eigh((features @ features.T).astype(float))
        keep = values > 1e-6
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        units = [*names, *(u for u in negatives if u not in positive)]
        x = np.vstack([feature_rows(units[i : i + 500], columns)[0] @ features.T for i in range(0, len(units), 500)]).astype(float) @ whiten
        y = np.where(np.arange(len(units)) < len(names), 1.0, -1.0)
        weight = np.where(y > 0, 0.2 * max(1, len(units) - len(names)) / len(names), 1.0)
        w, bias = _fit_svm(x, y, weight)
        weights = np.zeros(CODES**3, dtype=np.float32)
        weights[columns] = features.T @ (whiten @ w)
        if turn < rounds - 1 and everyday:
            margins = Scorer(weights, bias, 1.0, 0.0).margins(everyday)
            found = [everyday[i] for i in np.argsort(-margins, kind="stable")[:1000]]
            negatives.update(dict.fromkeys(found))
            hardest = [*dict.fromkeys([*found[: landmarks // 2], *hardest])]
        if turn < rounds - 1 and suspects:
            placed = dict(zip(suspects, Scorer(weights, bias, 1.0, 0.0).margins(suspects).tolist()))
            best = [max((u for u in bag if u in placed), key=lambda u: (placed[u], u), default=None) for bag in bags]
            witnesses = Counter(u for u in best if u is not None and placed[u] > 0)
            positive = first + witnesses
    scorer = Scorer(weights, bias, 1.0, 0.0)
    margin = np.array([max(scorer.of(t), default=bias) for t, _ in rows])
    x, base = np.column_stack((margin, np.ones(len(margin)))), np.array([1.0, 0.0])
    for _ in range(100):  # Platt scaling by Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ base, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(2), x.T @ (labels - p) - 1e-1 * base)
        base = base + np.clip(step, -1, 1)
    return Scorer(weights, bias, float(base[0]), float(base[1]))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_DOCUMENTS) -> list[tuple[str, int]]:
    """At most ``limit`` labelled documents that aren't held out, chosen by the hash of their id."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    chosen = usable.groupBy(F.col("doc_id").alias("_lid")).agg(F.max("toxic").alias("_toxic")).orderBy(F.xxhash64("_lid"), "_lid").limit(limit)
    rows = docs.where(F.octet_length(text_of(text_col)) <= TRAIN_BYTES).join(F.broadcast(chosen), F.col(id_col) == F.col("_lid"))
    rows = rows.groupBy("_lid").agg(F.min(text_of(text_col)).alias("_text"), F.first("_toxic").alias("_toxic")).collect()
    return [(r["_text"], int(r["_toxic"])) for r in sorted(rows, key=lambda r: (r["_lid"], r["_text"]))]


def score_texts(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                scores = list(scorer.texts(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, type=pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_texts(docs, fit(training_rows(docs, labels)))
