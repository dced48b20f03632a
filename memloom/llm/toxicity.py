"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Method. Features are hashed n-grams of a text's characters in lower case (present
or not). Over a bounded sample of labelled texts, each feature's log-count ratio is
the log of its smoothed share of toxic texts' features over that of other texts.
The features that separate best are kept; a logistic regression is fitted on
them, each scaled by its ratio. Weight times ratio is one number a feature, so a
text's score is one sum over its distinct features. The table of these numbers
has 2**BITS floats, whatever the corpus, and is broadcast.

Defined cases. A null or empty text, or one shorter than the shortest n-gram, has
no features: its score is the intercept's. Without labelled rows of both classes,
as with an empty table of labels, every text scores 0; an empty table of documents
gives no rows. Rows that repeat are scored each, equal texts alike. Very long texts
are read whole. Further columns, whatever their names, take no part. A score equal
to the threshold is predicted 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.labelled import labelled_sample
from memloom.llm.shared import held_out
from memloom.llm.textbytes import BASE, mix, runs

#: The classifier is fitted on at most so many labelled rows of each class.
PER_CLASS = 3000
BITS, LENGTHS = 19, (3, 4, 5, 6)
#: Features kept, the least number of sample texts that must hold one, and the
#: least standard errors by which its shares of both classes must differ.
KEPT, LEAST_TEXTS, LEAST_Z = 5000, 4, 4
STEPS, RIDGE = 400, 1e-5


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """The lower case of each character of the basic plane, where that is one character."""
    low = [chr(c).lower() for c in range(1 << 16)]
    return np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(low)], np.uint32)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points in lower case, offsets) of a run of UTF-8 texts."""
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(points < 1 << 16, _folded()[np.minimum(points, (1 << 16) - 1)], points)
    return low, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def features(points: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each n-gram length: the feature at each character of the run, -1 where a text ends too soon."""
    low = points.astype(np.uint64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(points))
    total = np.zeros(len(points), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if n > len(points):  # no text of the run is as long
            if n in LENGTHS:
                yield np.full(len(points), -1, np.int32)
            continue
        total = total * np.uint64(BASE)
        total[: len(points) - n + 1] += low[n - 1 :] + np.uint64(1)
        if n in LENGTHS:
            place = (mix(total + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32)
            yield np.where(left >= n, place, np.int32(-1))


def distinct_features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every distinct feature of each text, where wanted."""
    points, places = characters(data, offsets)
    text = np.repeat(np.arange(len(places) - 1), np.diff(places))
    found = []
    for f in features(points, places):
        keep = f >= 0
        if wanted is not None:
            keep &= wanted[f]
        at = np.flatnonzero(keep)
        found.append((text[at].astype(np.int64) << BITS) | f[at])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Model:
    table: np.ndarray  # weight times ratio, by feature
    intercept: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not np.isfinite(self.intercept):
            return np.zeros(n)
        text, f = distinct_features(data, offsets, self.table != 0)
        margin = self.intercept + np.bincount(text, self.table[f], minlength=n)
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def _logistic(row: np.ndarray, col: np.ndarray, ratio: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weights over the scaled features and an intercept, by Nesterov's accelerated descent."""
    value = ratio[col]
    scale = np.sqrt(np.bincount(row, value**2, minlength=n).mean() + 1)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))  # both classes weigh the same
    value = value / scale
    w, b, pw, pb = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio)), 0.0
    for k in range(STEPS):
        step = k / (k + 3)
        lw, lb = w + step * (w - pw), b + step * (b - pb)
        margin = np.bincount(row, value * lw[col], minlength=n) + lb
        wrong = share * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y)
        pw, pb = w, b
        w = lw - 2.0 * (np.bincount(col, value * wrong[row], minlength=len(ratio)) + RIDGE * lw)
        b = lb - 2.0 * wrong.sum()
    return w / scale, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """The model from at most `per_class` training rows of each class."""
    sample = labelled_sample(docs, labels, label, per_class).select("y", "text")
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, size), np.int32)
        texts = np.zeros(2, np.int64)
        for y, data, offsets in runs(batches):
            label_of = np.asarray(y)
            text, f = distinct_features(data, offsets)
            for k in (0, 1):
                seen[k] += np.bincount(f[label_of[text] == k], minlength=size).astype(np.int32)
                texts[k] += (label_of == k).sum()
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()]), pa.array([texts.tolist()])], ["seen", "texts"])

    parts = sample.mapInArrow(count, "seen binary, texts array<long>").toArrow()  # one row for each of few partitions
    seen = sum((np.frombuffer(x.as_py(), np.int32).reshape(2, size).astype(np.float64) for x in parts["seen"]), np.zeros((2, size)))
    texts = np.array(parts["texts"].to_pylist() or [[0, 0]]).sum(0)
    if not texts.all():
        return Model(np.zeros(size), -np.inf)
    share = (seen + 1) / (texts[:, None] + 2)
    ratio = np.log(share[1] / share[0])
    pooled = seen.sum(0) / texts.sum()
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / texts).sum())
    gain = np.abs(seen[1] / texts[1] - seen[0] / texts[0]) / spread
    gain[(seen.sum(0) < LEAST_TEXTS) | (gain < LEAST_Z)] = 0
    kept = np.sort(np.argsort(-gain, kind="stable")[:KEPT])
    kept = kept[gain[kept] > 0]
    wanted = np.zeros(size, bool)
    wanted[kept] = True
    number = np.cumsum(wanted) - 1
    sent = docs.sparkSession.sparkContext.broadcast((wanted, number.astype(np.int32)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, place = sent.value
        for b in batches:
            keys = pa.StructArray.from_arrays([b.column(0), b.column(2)], ["y", "h"])
            for key, data, offsets in runs(iter([pa.RecordBatch.from_arrays([keys, b.column(1)], ["key", "text"])])):
                text, f = distinct_features(data, offsets, use)
                at = np.searchsorted(text, np.arange(len(offsets))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(place[f]))
                yield pa.RecordBatch.from_arrays([key.field("y"), key.field("h"), lists], ["y", "h", "f"])

    got = sample.withColumn("h", F.xxhash64("text")).select("y", "text", "h").mapInArrow(rows, "y int, h long, f array<int>").toArrow()
    got = got.sort_by([("h", "ascending"), ("y", "ascending")])  # the same model whatever order the rows arrive in
    f = got["f"].combine_chunks()
    col = f.flatten().to_numpy()
    row = np.repeat(np.arange(len(got)), np.diff(f.offsets.to_numpy()))
    weights, b = _logistic(row, col, ratio[kept], np.array(got["y"].to_pylist(), np.float64), len(got))
    table = np.zeros(size)
    table[kept] = weights * ratio[kept]
    return Model(table, b)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, offsets in runs(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(model.value.score(data, offsets))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )
