"""Clusters around centroids by exponion search, with exact arithmetic.

Method. A vector keeps its centroid a, an upper bound u of its distance to it
and a lower bound l of the distance to any other. When centroids have moved, u
grows by a's step and l shrinks by the longest step of the others. The vector
stays where it is while u < max(l, s(a) / 2), with s(a) the distance from a to
its nearest other centroid. Else u is made exact, and if that does not help, only
the centroids within 2 * u + s(a) around a are scanned, found in the sorted list
of distances from a. That ball holds the nearest and the second nearest
centroid; its border belongs to it, so that ties are seen. New centroids follow
from sums that change by the vectors that moved.

Components are whole numbers; distances that decide are exact integers, and
bounds are loosened by more than their rounding. Ties go to the smaller number.

On a cluster. Vectors are packed in blocks of BLOCK rows and written once, in
buckets by block; the bounds (20 bytes a vector) are a table of their own with a
row for each block, joined with it in every round, so that no round writes or
shuffles vectors. Each task adds up the moves of its own blocks. The driver
holds the centroids, their sums and their distances (k * k), and nothing of
the vectors. Each round's bounds are cut in the shared folder.

Defined cases. Vectors of another length than `width`, null or with a null or a
component that is not finite take no part. A null id is kept, but is taken for a
first centroid only after all others. Rows that repeat an id are vectors of their
own; equal vectors are always in one cluster. With fewer vectors than k, there are as many centroids as
vectors; an empty table has no result. A cluster that loses all its vectors keeps
its centroid. A component of 2**40 or more when scaled is an error, and so is a
distance that does not fit 64 bits. Further columns, whatever their names, take
no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import bucketed, cut
from memloom.llm.wholes import matrix, whole_vectors

BLOCK = 1024
#: Bounds are loosened by this share of themselves, much more than their rounding.
SLACK = 1e-9
LIMIT = 2.0**40
STATE = "block long, at binary, upper binary, lower binary, moves array<long>"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the rows of c."""
    most = x.shape[1] * (int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))) ** 2
    if most < 1 << 53:  # all sums are exact in doubles
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([_paired(x, np.broadcast_to(y, x.shape)) for y in c], axis=1)


def _paired(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the rows of c, one by one."""
    d = x.astype(np.int64) - c
    if x.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 1 << 63:
        return (d * d).sum(1)
    total = (d.astype(object) ** 2).sum(1)
    if max(total) >= 1 << 63:
        raise OverflowError("a squared distance does not fit 64 bits")
    return total.astype(np.int64)


@dataclass
class Centroids:
    """Centroids of one round, their distances, and how far each has come since the round before."""

    at: np.ndarray
    step: np.ndarray

    def __post_init__(self) -> None:
        k = len(self.at)
        self.between = np.sqrt(_squares(self.at, self.at).astype(np.float64))
        self.order = np.argsort(self.between, axis=1, kind="stable")  # itself or a twin first
        self.sorted = np.take_along_axis(self.between, self.order, axis=1)
        apart = self.between + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.nearest = apart.min(1)  # infinite where k is 1
        away = np.where(np.eye(k, dtype=bool), -np.inf, self.step[None, :])
        self.others = np.maximum(away.max(1), 0)  # the longest step of any other


def _scan(x: np.ndarray, c: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, distance, distance of the second) of the nearest of the centroids `numbers`, for each row."""
    numbers = np.sort(numbers)  # argmin takes the first, so ties go to the smaller number
    d = _squares(x, c[numbers])
    best = d.argmin(1)
    rows = np.arange(len(x))
    first = d[rows, best]
    if len(numbers) > 1:
        d[rows, best] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(1).astype(np.float64))
    else:
        second = np.full(len(x), np.inf)
    return numbers[best], np.sqrt(first.astype(np.float64)), second


def first_search(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, upper, lower) of each vector by a scan of all centroids."""
    return _scan(x, c.at, np.arange(len(c.at)))


def exponion_search(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, upper, lower) of each vector, from those of the round before."""
    at, upper, lower = at.copy(), upper + c.step[at], np.maximum(lower - c.others[at], 0)

    def open_rows(rows: np.ndarray) -> np.ndarray:
        safe = np.maximum(lower[rows], c.nearest[at[rows]] / 2)
        return rows[~(upper[rows] * (1 + SLACK) + SLACK < safe * (1 - SLACK))]

    rows = open_rows(np.arange(len(x)))
    upper[rows] = np.sqrt(_paired(x[rows], c.at[at[rows]]).astype(np.float64))
    rows = open_rows(rows)
    radius = (2 * upper[rows] + c.nearest[at[rows]]) * (1 + SLACK) + SLACK
    was = at[rows]
    for a in np.unique(was):
        mine = was == a
        reach = np.searchsorted(c.sorted[a], radius[mine], "right")  # so many of a's list lie within the ball
        for n in np.unique(reach):
            some = rows[mine][reach == n]
            at[some], upper[some], lower[some] = _scan(x[some], c.at, c.order[a, :n])
    return at, upper, lower


def _moves(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> np.ndarray:
    """By centroid: the number and the sum of the vectors that came, less those that left."""
    with_one = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
    out = np.zeros((k, with_one.shape[1]), np.int64)
    rows = np.arange(len(x)) if old is None else np.flatnonzero(old != new)
    for a in range(k):
        out[a] += with_one[rows[new[rows] == a]].sum(0)
        if old is not None:
            out[a] -= with_one[rows[old[rows] == a]].sum(0)
    return out


def _packed(rows: DataFrame, width: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for s in range(0, len(b), BLOCK):
                ids, v = b.column(0).slice(s, BLOCK), matrix(b.column(1).slice(s, BLOCK), width)
                kind = np.int32 if np.abs(v).max(initial=0) < 1 << 31 else np.int64
                held = [pa.array([block], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([v.astype(kind).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(held, ["block", "ids", "vs"])
                block += 1

    return rows.mapInArrow(pack, "block long, ids array<long>, vs binary")


def _vectors(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = np.int32 if len(data) == rows * width * 4 else np.int64
    return np.frombuffer(data, kind).reshape(rows, width).astype(np.int64)


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, salt: str = "3",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, squared distance, inertia of the cluster and of all, and the digest of the centroid."""
    spark = vectors.sparkSession
    kept = whole_vectors(vectors.filter(F.size(vector_col) == width), scale, LIMIT, id_col, vector_col)
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    seeds = kept.orderBy(key.asc_nulls_last(), "v").limit(k).collect()  # k vectors
    if not seeds:
        return spark.createDataFrame([], RESULT)
    blocks = bucketed(_packed(kept, width), "vectors", "block")
    here = np.array([r["v"] for r in seeds], np.int64)
    k = len(here)
    held = np.zeros((k, width + 1), dtype=object)  # of each centroid: number and sum of its vectors
    now, state = Centroids(here, np.zeros(k)), None

    def searched(c: Centroids, state: DataFrame | None) -> DataFrame:
        sent, known = spark.sparkContext.broadcast(c), state is not None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moves = np.zeros((k, width + 1), np.int64)
            for b in batches:
                out: list[tuple] = []
                for r in b.to_pylist():
                    x = _vectors(r["vs"], len(r["ids"]), width)
                    old = None
                    if not known:
                        at, upper, lower = first_search(x, sent.value)
                    else:
                        old = np.frombuffer(r["at"], np.int32)
                        at, upper, lower = exponion_search(x, old, np.frombuffer(r["upper"]), np.frombuffer(r["lower"]), sent.value)
                    moves += _moves(x, old, at, k)
                    out.append((r["block"], at.astype(np.int32).tobytes(), upper.tobytes(), lower.tobytes(), None))
                yield _rows(out)
            yield _rows([(None, None, None, None, moves.ravel().tolist())])

        every = blocks if state is None else blocks.join(state.filter(F.col("block").isNotNull()).drop("moves"), "block")
        return cut(every.mapInArrow(run, STATE))

    for _ in range(rounds):
        state = searched(now, state)
        change = state.select(F.posexplode("moves").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for r in change.collect():  # k * (width + 1) rows
            held[divmod(r["at"], width + 1)] += int(r["x"])
        moved = np.array([[s // h[0] for s in h[1:]] if h[0] else c for h, c in zip(held, now.at, strict=True)], dtype=np.int64)
        now = Centroids(moved, np.sqrt(_paired(moved, now.at).astype(np.float64)) * (1 + SLACK))
    return _result(blocks, state, now, width)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("block", pa.int64()), ("at", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("moves", pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def _result(blocks: DataFrame, state: DataFrame | None, c: Centroids, width: int) -> DataFrame:
    """The last assignment, with exact distances."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = _vectors(r["vs"], len(r["ids"]), width)
                if "at" in r:
                    at = exponion_search(x, np.frombuffer(r["at"], np.int32), np.frombuffer(r["upper"]), np.frombuffer(r["lower"]), sent.value)[0]
                else:
                    at = first_search(x, sent.value)[0]
                d = _paired(x, sent.value.at[at])
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(at, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    every = blocks if state is None else blocks.join(state.filter(F.col("block").isNotNull()).drop("moves"), "block")
    found = cut(every.mapInArrow(run, "vec_id long, cluster int, distance long"))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    total = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.at.tolist()]
    of_cluster = [(a, s, total, digests[a]) for a, s in sums.items()]
    named = spark.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
