"""Exact top-k search by inner product over a pivot-distance index.

Method. A vector x is lifted by one component, sqrt(M**2 - |x|**2), with M the
largest norm; the largest inner products with q are then the least Euclidean
distances to (q, 0). PIVOTS vectors, the first by hash, are pivots. Every lifted
vector is keyed by its nearest pivot and its distance to it, and the keys are
cut into annuli of fixed bounds. A query first searches the annuli nearest to it
until they hold k other vectors; the k-th distance found is a bound. By the
triangle inequality an annulus [lo, hi] of pivot p holds nothing nearer than
max(d(q, p) - hi, lo - d(q, p), 0); the search stops at annuli beyond the bound.

Components are integers (floor(256 * x)) of any size, scores are exact integer
inner products, and bounds are loosened by more than their rounding, so the
result is exact. Distances are in units of the largest norm. The pivots and the
annuli's bounds (PIVOTS * RINGS numbers) are of fixed size. Vectors are packed in
blocks of BLOCK rows of one annulus, and a pivot's blocks are dealt over shelves
of about SHELF rows, so that no task holds a large annulus whole, be all its
vectors equal. Queries are packed in groups; a group is sent once to each shelf of
a pivot, with the annuli that each of its queries wants, and not once to each annulus.

Defined cases. Vectors that are null, or hold a null or a component that is not
finite, take no part; neither do rows with a null id. A vector shorter than the
longest counts as if zeros followed. Rows that repeat an id are separate
candidates; a query is never matched with rows of its own id. Ties go to the
smaller id. With fewer than k candidates all are returned; an empty table has no
result. Further columns, whatever their names, take no part. A score that does
not fit 64 bits is an error, and so is a component beyond the doubles when scaled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.shared import cut

PIVOTS, RINGS, BLOCK, QUERIES, SHELF = 32, 16, 1024, 256, 16384
SCALE = 256
#: Components up to this are multiplied apart from larger ones, which are slower.
USUAL = 1 << 20
#: No score: below all that count.
NONE = -(1 << 63)
#: Distances are computed in double precision; bounds are loosened by this.
SLACK = 1e-6


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, the components as whole numbers in doubles, of the rows that take part."""
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) >= 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    whole = vectors.filter(sound & F.col(id_col).isNotNull())

    def whole_number(x: Column) -> Column:
        y = x.cast("double") * SCALE
        large = F.when(F.abs(y) < float("inf"), y).otherwise(F.raise_error(F.lit("a scaled component is beyond the doubles")).cast("double"))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(large)  # doubles from 2**53 on are whole

    return whole.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, whole_number).alias("v"))


def products(q: np.ndarray, x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, NONE where own; an error if another does not fit 64 bits."""
    q_most, x_most = np.abs(q).max(1, initial=0), np.abs(x).max(1, initial=0)
    out = np.empty((len(q), len(x)), np.int64)
    for i in (np.flatnonzero(q_most < USUAL), np.flatnonzero(q_most >= USUAL)):
        for j in (np.flatnonzero(x_most < USUAL), np.flatnonzero(x_most >= USUAL)):
            if not len(i) or not len(j):
                continue
            most = q.shape[1] * int(q_most[i].max()) * int(x_most[j].max())
            a, b = q[i], x[j].T
            if most < 1 << 53:  # all sums are exact in doubles
                s = (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
            elif most < 1 << 62:
                s = a.astype(np.int64) @ b.astype(np.int64)
            else:
                whole = np.frompyfunc(int, 1, 1)
                s = whole(a) @ whole(b)
                s[own[np.ix_(i, j)]] = 0
                if s.min() <= NONE or s.max() > -(NONE + 1):
                    raise OverflowError("a score does not fit 64 bits")
            out[np.ix_(i, j)] = s.astype(np.int64)
    out[own] = NONE
    return out


def _lifted(x: np.ndarray, unit: float) -> np.ndarray:
    """Rows of whole numbers over the largest norm, with the component that makes all norms 1."""
    x = x.astype(np.float64) / unit
    rest = np.maximum(1.0 - (x * x).sum(1), 0.0)
    return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k highest inner products of each query with the other rows."""
    spark = vectors.sparkSession
    every = scaled(vectors, id_col, vector_col)
    top = F.array_max(F.transform("v", F.abs))
    # The norm by its largest component, so that no square is beyond the doubles.
    norm = F.when(top > 0, top * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / top) * (x / top)))).otherwise(0.0)
    size = F.size("v")
    common = every.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.max(norm).alias("norm"), F.max(top).alias("top")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if common["most"] is None:
        return spark.createDataFrame([], result)
    width, unit = common["most"], float(common["norm"] or 0.0) or 1.0
    if common["least"] < width:
        every = every.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), width - size)))
    small = (common["top"] or 0.0) < 1 << 31
    number = np.int32 if small else np.float64
    if small:
        every = every.withColumn("v", F.col("v").cast("array<int>"))
    slack = 8 * np.sqrt(np.finfo(float).eps * (width + 8))  # the rounding of squares of distances between norms of 1
    first = every.orderBy(F.xxhash64("v"), "vec_id").limit(PIVOTS * 4).collect()  # a fixed number of vectors
    pivots = _lifted(np.unique(np.array([r["v"] for r in first], np.float64), axis=0)[:PIVOTS], unit)
    sent = spark.sparkContext.broadcast(pivots)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.array(b["v"].tolist(), number)
                d = _distances(_lifted(x, unit), sent.value)
                near = d.argmin(1)
                yield pd.DataFrame({"vec_id": b["vec_id"], "pivot": near, "dist": d[np.arange(len(b)), near], "v": [r.tobytes() for r in x]})

    keyed = cut(every.mapInPandas(key, "vec_id long, pivot int, dist double, v binary"))
    # The bounds of the annuli: for each pivot, RINGS quantiles of the distances.
    cuts = keyed.groupBy("pivot").agg(F.percentile_approx("dist", [i / RINGS for i in range(1, RINGS)], 1000).alias("q"))
    inner = {r["pivot"]: np.unique(np.array(r["q"] or [], float)) for r in cuts.collect()}
    rings = spark.sparkContext.broadcast(inner)

    def pack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows to blocks within one annulus each."""
        for b in rows:
            if not len(b):
                continue
            pivot, dist = b["pivot"].to_numpy(), b["dist"].to_numpy()
            ring = np.zeros(len(b), np.int64)
            for p in np.unique(pivot):
                ring[pivot == p] = np.searchsorted(rings.value[p], dist[pivot == p], "right")
            cell = pivot * (RINGS + 1) + ring
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            for s, e in zip(starts, [*starts[1:], len(b)], strict=True):
                for a in range(s, e, BLOCK):
                    z = min(e, a + BLOCK)
                    yield pd.DataFrame(
                        {"cell": [int(cell[a])], "n": [z - a], "lo": [float(b["dist"].iloc[a:z].min())], "hi": [float(b["dist"].iloc[a:z].max())],
                         "ids": [b["vec_id"].to_numpy(np.int64)[a:z].tobytes()], "vs": [b"".join(b["v"].iloc[a:z])]}
                    )

    parts = max(1, keyed.rdd.getNumPartitions())
    ordered = keyed.repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    blocks = cut(ordered.mapInPandas(pack, "cell int, n int, lo double, hi double, ids binary, vs binary"))
    held = blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    cells = np.array(sorted((r["cell"], r["n"], r["lo"], r["hi"]) for r in held))  # at most PIVOTS * (RINGS + 1) rows
    bounds = spark.sparkContext.broadcast(cells)
    asked = cut(keyed.filter(is_query).select("vec_id", "v"))

    def lower(x: np.ndarray) -> np.ndarray:
        """Of each query and annulus: the least possible distance."""
        lifted = np.concatenate([x.astype(np.float64) / unit, np.zeros((len(x), 1))], axis=1)
        d = _distances(lifted, sent.value)[:, of_pivot]
        return np.maximum(np.maximum(d - bounds.value[:, 3], bounds.value[:, 2] - d), 0) - SLACK * (1 + d) - slack

    ring = bounds.value[:, 0].astype(int) % (RINGS + 1)
    of_pivot = bounds.value[:, 0].astype(int) // (RINGS + 1)
    rows = np.bincount(of_pivot, bounds.value[:, 1], minlength=PIVOTS)
    shelves = np.maximum(1, np.ceil(rows / SHELF)).astype(np.int64)

    def grouped(batches: Iterator[pd.DataFrame], pick) -> Iterator[pd.DataFrame]:
        """(pivot, number of its shelves, the queries to search it, packed in groups of QUERIES, with their annuli as bits)."""
        for b in batches:
            if not len(b):
                continue
            x = np.array([np.frombuffer(v, number) for v in b["v"]])
            wanted = pick(b, x, lower(x))
            least = b["least"].to_numpy(np.int64) if "least" in b else np.full(len(b), NONE)
            for p in np.unique(of_pivot):
                bits = (wanted[:, of_pivot == p] * (1 << ring[of_pivot == p])).sum(1).astype(np.int32)
                at = np.flatnonzero(bits)
                for a in range(0, len(at), QUERIES):
                    some = at[a : a + QUERIES]
                    yield pd.DataFrame(
                        {"pivot": [int(p)], "shelves": [int(shelves[p])], "qids": [b["vec_id"].to_numpy(np.int64)[some].tobytes()],
                         "qs": [x[some].tobytes()], "least": [least[some].tobytes()], "wants": [bits[some].tobytes()]}
                    )

    def nearest(b: pd.DataFrame, x: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The nearest annuli that together hold k rows besides the query's own."""
        order = np.argsort(low, axis=1, kind="stable")
        total = np.cumsum(bounds.value[order, 1], axis=1)
        use = np.concatenate([np.ones((len(x), 1), bool), total[:, :-1] < k + 1], axis=1)
        out = np.zeros_like(use)
        np.put_along_axis(out, order, use, axis=1)
        return out

    def within(b: pd.DataFrame, x: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The annuli that may hold a row as near as the k-th found; the first ones are done."""
        norm = ((x.astype(np.float64) / unit) ** 2).sum(1)
        least = b["least"].to_numpy(np.int64)
        reach = np.where(least == NONE, np.inf, np.sqrt(np.maximum(norm + 1.0 - 2.0 * (least / unit / unit), 0)))
        return (low <= reach[:, None] * (1 + SLACK) + SLACK) & ~nearest(b, x, low)

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k best of each query in each block, if not below the bound."""
        for b in batches:
            for r in b.itertuples():
                ids, qids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.qids, np.int64)
                x = np.frombuffer(r.vs, number).reshape(len(ids), -1)
                asks = np.flatnonzero(np.frombuffer(r.wants, np.int32) >> (r.cell % (RINGS + 1)) & 1)
                if not len(asks):
                    continue
                q, least = np.frombuffer(r.qs, number).reshape(len(qids), -1)[asks], np.frombuffer(r.least, np.int64)[asks]
                qids = qids[asks]
                s = products(q, x, qids[:, None] == ids[None, :])
                keep = min(k, len(ids))
                worst = np.partition(s, len(ids) - keep, axis=1)[:, len(ids) - keep]
                row, col = np.nonzero((s >= np.maximum(worst, least)[:, None]) & (s > NONE))
                found = pd.DataFrame({"query_id": qids[row], "vec_id": ids[col], "score": s[row, col]})
                # ties at the block's k-th score beyond k rows: smaller ids first
                found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
                yield found

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    kind = "pivot int, shelves long, qids binary, qs binary, least binary, wants binary"
    out = "query_id long, vec_id long, score long"
    here = F.lit(RINGS + 1)
    dealt = blocks.join(
        F.broadcast(spark.createDataFrame([(p, int(n)) for p, n in enumerate(shelves)], "pivot int, shelves long")), F.floor(F.col("cell") / here) == F.col("pivot")
    ).select("pivot", F.pmod(F.xxhash64("cell", "ids"), "shelves").alias("shelf"), "cell", "ids", "vs")

    def searched(queries: DataFrame, pick) -> DataFrame:
        asking = queries.mapInPandas(lambda it: grouped(it, pick), kind)
        asking = asking.withColumn("shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shelves") - 1))).drop("shelves")
        return asking.join(dealt, ["pivot", "shelf"]).mapInPandas(scores, out)

    start = cut(best(searched(asked, nearest)))
    kth = start.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n"))
    least = asked.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select(
        "vec_id", "v", F.when(F.col("n") >= k, F.col("s")).otherwise(F.lit(NONE).cast("long")).alias("least")
    )
    return best(start.select("query_id", "vec_id", "score").unionAll(searched(least, within))).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
