"""Whitening of vectors from an exact scatter matrix, by residue numbers.

Method. The scatter matrix of whole-number vectors is summed modulo several
primes: each task reduces its vectors modulo a prime, multiplies blocks of them
in double precision, where all partial sums are exact, and adds up the residues.
The sums over all tasks give, by the Chinese remainder theorem, the exact
count, sums and sums of products. So the covariance V is a fraction of whole
numbers, centred exactly, and rounded once. Its eigenvectors come from a
double-precision symmetric solver.

The primes are the largest below 2**21, as many as the largest possible sum
needs (twice the number of vectors times the largest component squared). A vector
has a 1 put before its components, so that the count and the sums are entries of
the same matrix.

On a cluster. The fit list is each distinct vector once: duplicates are dropped
before the shuffle where they meet in a task, and after it. A task holds one block
of rows and a matrix of width**2 residues a prime; only such matrices are
shuffled. The driver holds width**2 numbers. The fit list is cut in the shared
folder, as it is read twice: the second time to measure what the whitened fit list's
covariance is.

Defined cases. Rows whose vector is null or holds a null or a component that is
not finite are dropped. A vector shorter than the longest counts as if zeros
followed. A null id and repeated rows are kept. An empty table, or one of empty
vectors, has no result. A direction without variance (an eigenvalue below the
rounding of the trace, as with a single distinct vector) is whitened to zero and
has no part in identity_error. A component of 2**62 or more when scaled is an
error. deviation is null where it does not fit 64 bits; deviation_exact has it at
any size. Signs make the component of largest absolute value positive, the
first of equals. Further columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import cut
from memloom.llm.wholes import matrix, whole_vectors

#: Primes are below 2**21, so that PRODUCTS products of two residues of at most half of that are exact in a double.
PRIMES_BELOW, PRODUCTS = 1 << 21, 4096
LIMIT = 2.0**62
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"


def primes(most: int) -> list[int]:
    """The largest primes below PRIMES_BELOW whose product is over 2 * most."""
    out, product, p = [], 1, PRIMES_BELOW - 1
    small = [q for q in range(3, 1449, 2) if all(q % r for r in range(3, int(q**0.5) + 1, 2))]  # 1449**2 > 2**21
    while product <= 2 * most:
        if all(p % q for q in small):
            out.append(p)
            product *= p
        p -= 2
    return out


def scatter_residues(x: np.ndarray, p: int) -> np.ndarray:
    """The entries on and above the diagonal of the sum of y * y.T modulo p, y being a row of x after a 1."""
    y = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1) % p
    y = np.where(y > p // 2, y - p, y).astype(np.float64)
    total = np.zeros((y.shape[1], y.shape[1]), np.int64)
    for s in range(0, len(y), PRODUCTS):
        part = y[s : s + PRODUCTS]
        total = (total + (part.T @ part).astype(np.int64)) % p
    return total[np.triu_indices(len(total))]


def reconstructed(residues: dict[int, list[int]]) -> np.ndarray:
    """The whole numbers, of either sign, with these residues by prime."""
    product = 1
    for p in residues:
        product *= p
    total = 0
    for p, r in residues.items():
        rest = product // p
        total = total + np.array(r, dtype=object) * (rest * pow(rest, -1, p))
    total = total % product
    return np.where(total > product // 2, total - product, total)


@dataclass
class Whitener:
    """n, the sums S, the chosen components as columns, what to divide by (0: no variance), and their share of the variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    roots: np.ndarray
    explained: np.ndarray

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n * x - S)**2 of each row."""
        most = max(1, int(np.abs(x).max(initial=0)))
        top = max(map(abs, self.sums), default=0)
        if x.shape[1] * (self.n * most + top) ** 2 < 1 << 63:
            y = x * self.n - np.array(self.sums, np.int64)
            return (y * y).sum(1).tolist()
        if x.shape[1] * most * max(most, top) >= 1 << 63:
            x = x.astype(object)
        square, along = (x * x).sum(1).tolist(), (x @ np.array(self.sums, x.dtype)).tolist()
        rest = sum(s * s for s in self.sums)
        return [self.n * (self.n * int(q) - 2 * int(t)) + rest for q, t in zip(square, along, strict=True)]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """x - S/n along each component, over the root of its eigenvalue."""
        mean = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        y = (x - mean).astype(np.float64) - rest  # the whole part leaves first, exactly
        return np.where(self.roots > 0, (y @ self.axes) / np.where(self.roots > 0, self.roots, 1), 0.0)


def fitted(n: int, sums: list[int], products: np.ndarray, components: int) -> Whitener:
    """From the exact count, sums and sums of products."""
    d = len(sums)
    exact = [[n * int(products[i, j]) - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(exact[i][i] for i in range(d)) / (n * n)
    cov = np.array([[v / (n * n) for v in row] for row in exact])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    values = np.where(values > trace * d * np.finfo(float).eps, values, 0.0)
    return Whitener(n, sums, axes, np.sqrt(values), values / trace if trace else values)


def _fit(spark, fit: DataFrame, most: int, rows: int, width: int, components: int) -> Whitener:
    chosen = primes(max(1, rows) * max(1, most) ** 2)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {p: 0 for p in chosen}
        for b in batches:
            x = matrix(b.column(0), width).astype(np.int64)
            held = {p: (r + scatter_residues(x, p)) % p for p, r in held.items()}
        for p, r in held.items():
            if not np.isscalar(r):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([r.tolist()], pa.list_(pa.int64()))], ["prime", "r"])

    sums = fit.mapInArrow(residues, "prime int, r array<long>").select("prime", F.posexplode("r").alias("place", "r"))
    found = sums.groupBy("prime", "place").agg(F.sum("r").alias("r")).collect()  # width**2 / 2 numbers for each prime
    by_prime = {p: [0] * ((width + 1) * (width + 2) // 2) for p in chosen}
    for r in found:
        by_prime[r["prime"]][r["place"]] = r["r"]
    whole = np.zeros((width + 1, width + 1), dtype=object)
    whole[np.triu_indices(width + 1)] = reconstructed(by_prime)
    upper = np.triu(whole, 1)
    whole = whole + upper.T
    return fitted(int(whole[0, 0]), [int(s) for s in whole[0, 1:]], whole[1:, 1:], components)


def _identity_error(fit: DataFrame, w: Whitener, width: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    sent, c = fit.sparkSession.sparkContext.broadcast(w), len(w.roots)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((c + 1, c + 1))
        for b in batches:
            y = sent.value.whiten(matrix(b.column(0), width).astype(np.int64))  # centred already
            y = np.concatenate([np.ones((len(y), 1)), y], axis=1)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

    parts = fit.mapInArrow(sums, "s array<double>").select(F.posexplode("s").alias("place", "s"))
    total = np.zeros((c + 1) ** 2)
    for r in parts.groupBy("place").agg(F.sum("s").alias("s")).collect():  # (components + 1)**2 rows
        total[r["place"]] = r["s"]
    total = total.reshape(c + 1, c + 1)
    mean = total[0, 1:] / w.n
    rest = np.abs(total[1:, 1:] / w.n - np.outer(mean, mean) - np.eye(c))[np.ix_(w.roots > 0, w.roots > 0)]
    return float(rest.max(initial=0.0))


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row and each of the first components: n, deviation, whitened value, share of the variance, identity error."""
    spark = vectors.sparkSession
    every = whole_vectors(vectors, scale, LIMIT, id_col, vector_col)
    largest = F.array_max(F.transform("v", F.abs))
    stats = every.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("width"), F.max(largest).alias("most")).first()
    width, most = stats["width"] or 0, stats["most"] or 0
    if not width:
        return spark.createDataFrame([], RESULT)
    if stats["least"] < width:
        every = every.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), width - F.size("v"))))
    if most < 1 << 31:
        every = every.withColumn("v", F.col("v").cast("array<int>"))
    fit = cut(every.select("v").distinct())
    w = _fit(spark, fit, most, stats["n"], width, components)
    error, c = _identity_error(fit, w, width), len(w.roots)
    sent = spark.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, rows = sent.value, len(b)
            x = matrix(b.column(1), width).astype(np.int64)
            exact = w.deviations(x)
            short = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
            again = pa.array(np.repeat(np.arange(rows), c))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(again), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), rows)), pa.array(np.full(rows * c, w.n)),
                    short.take(again), pa.array(w.whiten(x).ravel()), pa.array(np.tile(w.explained, rows)), pa.array(np.full(rows * c, error)),
                    pa.array(list(map(str, exact)), pa.string()).take(again),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
            )

    return every.mapInArrow(run, RESULT)
