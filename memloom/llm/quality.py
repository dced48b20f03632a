"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Method. A text's terms are its words and pairs of neighbouring words, hashed, and
beside them trigrams of character shapes (letter case, digit, blank, line end,
each punctuation mark) and marks for repeated words. A bounded sample of labelled
texts gives the terms' weights (log counts times inverse document frequency) and,
by a truncated singular value decomposition, the latent space. The labelled
vectors are broadcast: at most 2 * PER_CLASS vectors of DIMENSIONS floats,
whatever the corpus. Every text is folded into the space, its exact cosines with
all labelled vectors are computed block by block, and the labels of its
NEIGHBOURS nearest are averaged with their similarities as weights. Counts are
held for at most BLOCK texts at a time.

Defined cases. A null or empty text has no terms and scores 0, as does a text
whose labelled neighbours all have a similarity of 0 or less. Without any labelled
training row, as with an empty table of labels, every text scores 0.5. An empty
table of documents gives no rows. Rows that repeat are scored each, equal texts
alike. Very long texts are read whole. Further columns, whatever their names,
take no part. The model does not depend on the order in which rows arrive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.labelled import labelled_sample
from memloom.llm.shared import held_out
from memloom.llm.textbytes import lower, mix, run_hashes, runs, word_bounds

#: The classifier is fitted on at most so many labelled rows of each class.
PER_CLASS = 2000
#: Buckets of hashed words and word pairs, and of shape trigrams.
WORD_TERMS, SHAPE_TERMS = 3072, 1024
DIMENSIONS, NEIGHBOURS = 64, 25
#: Similarities are raised to this power before they weigh a vote.
SHARPNESS = 8
#: Texts whose terms and cosines are computed at once.
BLOCK = 256
#: Two terms more: a word equal to the one before, and to the second before.
REPEATS = 2
WIDTH = WORD_TERMS + SHAPE_TERMS + REPEATS


def _shapes() -> np.ndarray:
    shape = np.zeros(256, np.int64)
    shape[128:] = 1  # parts of letters beyond ASCII
    for k, (a, b) in enumerate((("a", "z"), ("A", "Z"), ("0", "9")), 2):
        shape[ord(a) : ord(b) + 1] = k
    shape[[32, 9]], shape[[10, 13]] = 5, 6
    marks = [c for c in range(33, 127) if shape[c] == 0]
    shape[marks] = np.arange(7, 7 + len(marks))
    return shape


SHAPE = _shapes()


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of each term (columns) in each text (rows)."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    place = []
    if len(data) > 2:
        s = SHAPE[data]
        term = ((s[:-2] * 1_000_003 + s[1:-1]) * 1_000_003 + s[2:]) * 2_654_435_761 % (1 << 32) % SHAPE_TERMS
        same = text[:-2] == text[2:]
        place.append(text[:-2][same] * WIDTH + WORD_TERMS + term[same])
    starts, ends, _ = word_bounds(data, offsets)
    if len(starts):
        words, of = run_hashes(lower(data), starts, ends), text[starts]
        place.append(of * WIDTH + (words % np.uint64(WORD_TERMS)).astype(np.int64))
        next_to = of[1:] == of[:-1]
        pairs = mix(words[:-1] * np.uint64(3) + words[1:])[next_to]
        place.append(of[1:][next_to] * WIDTH + (pairs % np.uint64(WORD_TERMS)).astype(np.int64))
        for k in range(1, REPEATS + 1):
            again = (words[k:] == words[:-k]) & (of[k:] == of[:-k])
            place.append(of[k:][again] * WIDTH + WORD_TERMS + SHAPE_TERMS + k - 1)
    out = np.zeros(n * WIDTH, np.float32)
    for p in place:
        out += np.bincount(p, minlength=n * WIDTH)
    return out.reshape(n, WIDTH)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, term counts) of at most BLOCK texts at a time."""
    for keys, data, offsets in runs(batches, rows=BLOCK):
        yield keys, term_counts(data, offsets)


@dataclass
class Model:
    weights: np.ndarray  # by term
    basis: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled texts x dimensions, of unit length
    labels: np.ndarray

    def place(self, counts: np.ndarray) -> np.ndarray:
        z = weighted(counts, self.weights) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Scores of the rows of counts, BLOCK at most; counts are overwritten."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        some = counts.any(1)
        k = min(NEIGHBOURS, len(self.labels))
        cosines = self.place(counts) @ self.vectors.T
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** SHARPNESS
        votes = (weight * self.labels[near]).sum(1) / np.maximum(weight.sum(1), 1e-12)
        return np.clip(np.where(some, votes, 0.0), 0.0, 1.0)


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of unit length of log counts times weights, in place of counts."""
    np.log1p(counts, out=counts)
    counts *= weights
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    return counts


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """The model from at most `per_class` training rows of each class."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.StructArray.from_arrays([b.column(1), b.column(2)], ["h", "y"])
            for key, c in pieces(iter([pa.RecordBatch.from_arrays([keys, b.column(0)], ["key", "text"])])):
                row, col = np.nonzero(c)
                at = np.searchsorted(row, np.arange(len(c) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in (col.astype(np.int16), c[row, col])]
                yield pa.RecordBatch.from_arrays([key.field("h"), key.field("y"), *lists], ["h", "y", "term", "n"])

    sample = labelled_sample(docs, labels, label, per_class)
    rows = sample.select("text", F.xxhash64("text").alias("h"), "y").mapInArrow(terms, "h long, y int, term array<short>, n array<float>").toArrow()
    rows = rows.sort_by([("h", "ascending"), ("y", "ascending")]).combine_chunks()  # the same model whatever order the rows arrive in
    counts = np.zeros((len(rows), WIDTH), np.float32)
    if len(rows):
        term, n = rows["term"].combine_chunks(), rows["n"].combine_chunks()
        counts[np.repeat(np.arange(len(rows)), np.diff(term.offsets.to_numpy())), term.flatten().to_numpy()] = n.flatten().to_numpy()
    y = np.array(rows["y"].to_pylist(), np.float64)
    weights = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.05).astype(np.float32)
    m = Model(weights, np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), y)
    if len(counts):
        x = weighted(counts, weights)
        rank = min(DIMENSIONS, *x.shape)
        probe = x @ np.random.default_rng(7).standard_normal((WIDTH, min(rank + 16, len(x)))).astype(np.float32)
        for _ in range(4):  # power iterations of a randomised decomposition
            probe = np.linalg.qr(x @ (x.T @ np.linalg.qr(probe)[0]))[0]
        _, _, v = np.linalg.svd(probe.T @ x, full_matrices=False)
        m.basis = np.ascontiguousarray(v[:rank].T.astype(np.float32))
        z = x @ m.basis
        m.vectors = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return m


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in pieces(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(model.value.score(counts))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score at least `threshold`, in docs's columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows), b.column(names.index("text"))], ["at", "text"])
            keep = np.concatenate([model.value.score(c) >= threshold for _, c in pieces(iter([pair]))] or [np.zeros(0, bool)])
            for k in range(0, len(keep), BLOCK):  # small batches, so that no second copy of the whole one is held
                yield b.slice(k, BLOCK).filter(pa.array(keep[k : k + BLOCK]))

    return docs.mapInArrow(run, docs.schema)
