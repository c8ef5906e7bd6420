"""Toxicity severity by cumulative-link (proportional-odds) regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector, ordered thresholds. Features are the words of a
text and their beginnings, hashed, weighted (1 + log tf) * idf. An L1 penalty, solved by accelerated proximal gradient, picks the
words; a second, lightly penalised fit over those alone sets their weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fraction_for, small_batches

BITS = 20
#: Lengths of the word beginnings that are features beside the whole word.
STEMS = (4, 5, 6, 7)
#: Words whose features or weights a worker remembers; emptied when full.
REMEMBERED = 300_000
_words = re.compile(r"\w+").findall


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    parts = [word, *(f"{word[:n]}-" for n in STEMS if len(word) >= n)]
    return [crc32(p.encode("utf-8", "replace")) & ((1 << BITS) - 1) for p in parts]


def features(text: str | None) -> dict[int, float]:
    """Feature -> sum over its words of 1 + log(times the word occurs)."""
    out: dict[int, float] = {}
    for w, n in Counter(_words(text.lower())).items() if text else ():
        for k in word_features(w):
            out[k] = out.get(k, 0.0) + 1.0 + math.log(n)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


class OrdinalModel:
    """weights: feature -> weight (idf included); thresholds: ascending, one fewer than there are grades."""

    def __init__(self, weights: dict[int, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds
        self._known: dict[str, float] = {}

    def at_least(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., a column each."""
        return 1.0 - _sigmoid(np.array(self.thresholds)[None, :] - np.asarray(latent)[:, None])

    def latent(self, text: str | None) -> float:
        """w.x of a text: a sum over its words, whose own sums are remembered."""
        if not text:
            return 0.0
        known, total = self._known, 0.0
        if len(known) > REMEMBERED:
            known.clear()
        for w, n in Counter(_words(text.lower())).items():
            if (x := known.get(w)) is None:
                x = known[w] = sum(self.weights.get(k, 0.0) for k in word_features(w))
            if x:
                total += x * (1.0 + math.log(n))
        return total


def fit_ordinal(indptr: np.ndarray, index: np.ndarray, value: np.ndarray, grade: np.ndarray, n_grades: int, penalty: float = 0.5, min_df: int = 3, rounds: int = 200) -> OrdinalModel:
    """Fits on rows in compressed form. penalty: of weights, times 1/sqrt(rows). With no rows or one grade, no weights."""
    n = len(grade)
    share = np.array([(grade >= k).mean() if n else 0.5 for k in range(1, n_grades)])
    theta0 = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    theta0 = np.maximum.accumulate(theta0 + 1e-6 * np.arange(len(theta0)))
    if n == 0 or len(np.unique(grade)) < 2:
        return OrdinalModel({}, theta0.tolist())
    # only features of enough rows go on, in numbers of half the width: this is what the driver holds
    all_df = np.bincount(index)
    names = np.flatnonzero(all_df >= min_df)
    df = all_df[names]
    place = np.full(len(all_df), -1, np.int32)
    place[names] = np.arange(len(names), dtype=np.int32)
    on = all_df[index] >= min_df
    column, value = place[index[on]], value[on].astype(np.float32)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(indptr))[on]
    del on, index
    idf = np.log(n / df)

    def solve(cols: np.ndarray, strength: float, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cols) == len(names):
            r, c, v = row, column, value * idf.astype(np.float32)[column]
        else:
            new = np.full(len(names), -1, np.int32)
            new[cols] = np.arange(len(cols), dtype=np.int32)
            on = new[column] >= 0
            r, c = row[on], new[column[on]]
            v = value[on] * idf[cols].astype(np.float32)[c]
        dot = lambda w: np.bincount(r, v * w[c], n)
        back = lambda g: np.bincount(c, v * g[r], len(cols))
        x = np.ones(len(cols)) / math.sqrt(max(1, len(cols)))
        top = 1.0
        for _ in range(12):  # power iteration for the step
            y = back(dot(x)) / n
            top = float(np.linalg.norm(y)) or 1.0
            x = y / top
        step = 1.0 / (0.25 * top * 1.1 + 0.5)
        w = np.zeros(len(cols))
        z, tz, prev_w, prev_t, k = w, theta, w, theta, 1.0
        for _ in range(rounds):
            s = dot(z)
            upper, lower = np.concatenate([tz, [np.inf]]), np.concatenate([[-np.inf], tz])
            a, b = _sigmoid(upper[grade] - s), _sigmoid(lower[grade] - s)
            p = np.maximum(a - b, 1e-12)
            gw = back(1.0 - a - b) / n
            gt = np.zeros(len(theta))
            for j in range(len(theta)):
                up, down = grade == j, grade == j + 1
                gt[j] = -((a[up] * (1 - a[up]) / p[up]).sum() - (b[down] * (1 - b[down]) / p[down]).sum()) / n
            w = z - step * gw
            w = np.sign(w) * np.maximum(np.abs(w) - step * strength, 0)
            t = np.maximum.accumulate(tz - step * gt)
            t = t + 1e-6 * np.arange(len(t))
            nk = (1 + math.sqrt(1 + 4 * k * k)) / 2
            z, tz = w + (k - 1) / nk * (w - prev_w), np.maximum.accumulate(t + (k - 1) / nk * (t - prev_t))
            prev_w, prev_t, k = w, t, nk
        return w, prev_t

    cols = np.arange(len(names))
    w, theta = solve(cols, penalty / math.sqrt(n), theta0, rounds)
    cols = cols[w != 0]
    if not len(cols):
        return OrdinalModel({}, theta0.tolist())
    w, theta = solve(cols, 0.05 * penalty / math.sqrt(n), theta0, 2 * rounds)
    return OrdinalModel({int(names[c]): float(x * idf[c]) for c, x in zip(cols, w) if x}, theta.tolist())


def fit(docs: DataFrame, labels: DataFrame, n_grades: int, max_rows: int = 8_000, text_col: str = "text", id_col: str = "doc_id", grade_col: str = "grade", penalty: float = 0.5) -> OrdinalModel:
    """Learns from texts with a grade 0..n_grades-1.

    max_rows bounds the sample of labelled rows (by a hash of the id): only that many ids are broadcast to the
    texts, and only that many sparse rows reach the driver. Rows with a null grade or text are left out; of
    several labels of an id the highest grade counts.
    """
    small_batches(docs.sparkSession)
    graded = labels.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade"))
    some = graded.where(fraction_for(graded, "id", max_rows)).groupBy("id").agg(F.max("grade").alias("grade"))
    src = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").select("grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(g) for g in got], pa.list_(pa.int32())), pa.array([list(g.values()) for g in got], pa.list_(pa.float32()))], ["grade", "index", "value"])

    t = src.mapInArrow(run, "grade int, index array<int>, value array<float>").toArrow()
    flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *(x.flatten().to_numpy() for x in t[c].chunks)])
    sizes = np.concatenate([np.zeros(0, np.int64), *(x.value_lengths().to_numpy() for x in t["index"].chunks)])
    index, value, grade = flat("index", np.int32), flat("value", np.float32), np.clip(t["grade"].to_numpy().astype(np.int64), 0, n_grades - 1)
    del t
    return fit_ordinal(np.concatenate([[0], np.cumsum(sizes)]), index, value, grade, n_grades, penalty)


def predict(docs: DataFrame, model: OrdinalModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: the id, grade (the likeliest), expected_severity (sum of P(grade >= k)), p_toxic
    (P(grade >= 1)) and toxic (p_toxic >= 0.5). No shuffle; whole texts. A null or empty text is graded by the thresholds alone."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = OrdinalModel(weights, thresholds)
        for b in batches:
            p = m.at_least(np.array([m.latent(t) for t in b.column(1).to_pylist()], np.float64))
            each = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5)], [id_col, "grade", "expected_severity", "p_toxic", "toxic"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, grade int, expected_severity double, p_toxic double, toxic boolean")
