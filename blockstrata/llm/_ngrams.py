"""Logistic regression over hashed word and character n-grams, calibrated on rows held out.

Features of a text: its words, its pairs of words (a word said twice is the same pair
whatever the word) and its runs of three characters, each family hashed to 65,536 places and divided by the family's size in the text, so
a score is a mean of weights and whole batches are scored by lookups and sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockstrata.llm._base import AT_ONCE, text_chunks, tidied
from blockstrata.llm._words import U64, Texts, runs

PLACES = 1 << 16
FAMILIES = 3


def _family_places(t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family: the places of all n-grams, and each text's first and end among them."""
    words = t.words()
    yield (words >> U64(48)).astype(np.int64), t.first[:-1], t.first[1:]
    pairs = (runs(words, 2) >> U64(48)).astype(np.int64)
    pairs[words[1:] == words[:-1]] = 0  # a word said twice is one feature, whatever the word
    yield pairs, np.minimum(t.first[:-1], len(pairs)), np.minimum(np.maximum(t.first[1:] - 1, t.first[:-1]), len(pairs))
    at = np.append(np.flatnonzero((t.raw & 0xC0) != 0x80), len(t.raw))
    n = max(0, len(at) - 3)
    first = np.searchsorted(at[:-1], t.offs)
    grams = (t.spans(at[:n], at[3 : 3 + n]) >> U64(48)).astype(np.int64)
    yield grams, np.minimum(first[:-1], n), np.minimum(np.maximum(first[1:] - 2, first[:-1]), n)


def features(t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of each text."""
    families = list(_family_places(t))
    for i in range(len(t.offs) - 1):
        places, values = [], []
        for f, (grams, first, end) in enumerate(families):
            own = grams[first[i] : end[i]]
            if len(own):
                at, n = np.unique(own, return_counts=True)
                places.append(at + f * PLACES)
                values.append(n / len(own))
        yield (np.concatenate(places).astype("<u4"), np.concatenate(values).astype("<f4")) if places else (np.zeros(0, "<u4"), np.zeros(0, "<f4"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """``weights`` by place and ``bias`` give a score, ``slope`` and ``shift`` its calibrated logit, ``rate`` the share of good rows in training."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    rate: float

    def logits(self, t: Texts) -> np.ndarray:
        total = np.full(len(t.offs) - 1, self.bias)
        for f, (grams, first, end) in enumerate(_family_places(t)):
            sums = np.zeros(len(grams) + 1)
            np.cumsum(self.weights[f * PLACES : (f + 1) * PLACES][grams], out=sums[1:])
            total += (sums[end] - sums[first]) / np.maximum(end - first, 1)
        return self.slope * total + self.shift


def _descend(row: np.ndarray, place: np.ndarray, value: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.6, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias by AdaGrad over all rows, classes weighted evenly."""
    n = len(y)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max(n - y.sum(), 1))
    w, b, g2, b2 = np.zeros(FAMILIES * PLACES), 0.0, np.full(FAMILIES * PLACES, 1e-12), 1e-12
    for _ in range(rounds):
        off = weight * (sigmoid(np.bincount(row, value * w[place], n) + b) - y)
        grad = np.bincount(place, value * off[row], FAMILIES * PLACES) + decay * w
        g2 += grad * grad
        b2 += off.sum() ** 2
        w -= rate * grad / np.sqrt(g2)
        b -= rate * off.sum() / np.sqrt(b2)
    return w, b


def _calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift by Newton steps, with his smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([score, np.ones_like(score)], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ at)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (p - target) + 1e-4 * at)
        at = at - step
        if abs(step).max() < 1e-8:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def _rows(got: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of every feature of some rows."""
    row = np.repeat(np.arange(len(got)), [len(r.places) // 4 for r in got])
    return row, np.frombuffer(b"".join(r.places for r in got), "<u4").astype(np.int64), np.frombuffer(b"".join(r["values"] for r in got), "<f4")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 2000) -> Model | None:
    """A model of ``labels`` (doc_id and a 0/1 column) over the texts of ``docs`` (doc_id, text).

    At most ``most_rows`` labelled documents are drawn, by a hash of doc_id; a fourth of
    them only calibrates. Conflicting labels of a document count by majority, a draw
    as bad; of several texts of one doc_id the one with the least hash counts, so what
    reaches the driver is bounded whatever repeats. None where a class has no row: then
    there is nothing to learn.
    """
    drawn = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg((F.avg(label) > 0.5).cast("int").alias("_good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = rows.groupBy("doc_id", "_good").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")).select("doc_id", "one.text", "_good")

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, e, raw, offs in text_chunks(batch.column(1), AT_ONCE):
                found = list(features(Texts(raw, offs)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, e - a), batch.column(2).slice(a, e - a), pa.array([p.tobytes() for p, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["doc_id", "good", "places", "values"])

    got = rows.mapInArrow(tidied(extract), "doc_id long, good int, places binary, values binary").collect()
    got = sorted(got, key=lambda r: r.doc_id)
    y = np.array([r.good for r in got], float)
    held = np.arange(len(y)) % 4 == 3
    if not len(y) or min(y[~held].sum(), (1 - y[~held]).sum()) < 1:
        return None
    parts = [_rows([r for r, h in zip(got, held, strict=True) if h == side]) for side in (False, True)]
    got.clear()
    w, b = _descend(*parts[0], y[~held])
    score = np.zeros(len(y))
    for side, (row, place, value) in zip((False, True), parts, strict=True):
        score[held == side] = np.bincount(row, value * w[place], int((held == side).sum())) + b
    slope, shift = _calibrate(score[held], y[held]) if 0 < y[held].sum() < held.sum() else (1.0, 0.0)
    return Model(w.astype(np.float32), b, slope, shift, float((y.sum() + 1) / (len(y) + 2)))
