"""Vector search over embedding columns: single-query top-k, blocked k-NN joins, merging of result lists."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block's right side that are compared at once, and queries that share a comparison.
RIGHT_ROWS, LEFT_ROWS = 4096, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; null for different lengths or a zero norm."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def top_k(vectors: DataFrame, query: list[float], k: int, threshold: float = -1.0, where: Column | None = None, id_col: str = "vec_id") -> DataFrame:
    """The k rows nearest to one query vector, by cosine; ties by id. Conditions hold before the k are taken.

    The query vector is a literal of the plan; the rows stream through one
    projection into Spark's top-k, so k rows of each task are all that moves.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if where is None else vectors.filter(where)
    return rows.withColumn("score", cosine(F.col("v"), q)).filter(F.col("score") >= threshold).orderBy(F.desc("score"), id_col).limit(k)


def knn_join(left: DataFrame, right: DataFrame, k: int, block: str, id_col: str = "vec_id") -> DataFrame:
    """For each left row its k nearest right rows of the same block, itself excluded: id, other, score, rank.

    A block is cut into pieces of at most about RIGHT_ROWS by LEFT_ROWS; each
    piece is one matrix product that returns k rows a query, so neither a hot
    block nor its pairs meet in one task or in the shuffle. Vectors must have
    one length within a block.
    """

    def pieces(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy(block).agg(F.ceil(F.count("*") / rows).alias(name))

    counts = pieces(left, LEFT_ROWS, "nl").join(pieces(right, RIGHT_ROWS, "nr"), block)
    place = F.xxhash64(id_col)
    a = left.select(block, id_col, "v").join(counts, block).withColumns({"i": F.pmod(place, "nl"), "j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr") - 1))})
    b = right.select(block, id_col, "v").join(counts, block).withColumns({"j": F.pmod(place, "nr"), "i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("nl") - 1))})
    key = [block, "i", "j"]

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = {"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "score": np.zeros(0)}
        if len(x) and len(y):
            p, q = np.array(x["v"].tolist(), float), np.array(y["_v"].tolist(), float)
            norms = np.linalg.norm(p, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
            s = np.where(norms > 0, p @ q.T / np.where(norms > 0, norms, 1), -np.inf)
            own, others = x[id_col].to_numpy(np.int64), y["_id"].to_numpy(np.int64)
            s[own[:, None] == others[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(others, s.shape), -s), axis=1)[:, :k]
            best = np.take_along_axis(s, order, 1)
            row, col = np.nonzero(best > -np.inf)
            out = {"id": own[row], "other": others[order[row, col]], "score": best[row, col]}
        return pd.DataFrame(out)

    others = b.select(F.col(block).alias("_block"), F.col("i").alias("_i"), F.col("j").alias("_j"), F.col(id_col).alias("_id"), F.col("v").alias("_v"))
    found = a.select(*key, id_col, "v").groupBy(*key).cogroup(others.groupBy("_block", "_i", "_j")).applyInPandas(compare, "id long, other long, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def merged(parts: dict[str, DataFrame], k: int) -> DataFrame:
    """The k best rows (kind, id, score) of several searches; a missing score counts as 0, ties by kind and id."""
    rows = [df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.coalesce("score", F.lit(0.0)).alias("score")) for kind, df in parts.items()]
    return reduce(DataFrame.unionAll, rows).orderBy(F.desc("score"), "kind", "id").limit(k)


def round_robin(hits: DataFrame, kinds: list[str], k: int) -> DataFrame:
    """k rows of (kind, id, score): each kind's best first, then each kind's second, and so on, in the kinds' order."""
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "id"))
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return hits.withColumns({"rank": rank, "order": order}).filter(F.col("rank") <= k).orderBy("rank", "order").limit(k).drop("order")


def whole_tool_calls(messages: DataFrame) -> DataFrame:
    """Messages (id, role, call_ids, call_id): calls of which some id has no response go, and responses without a call.

    An assistant's message lists its calls in call_ids; a tool's message answers call_id.
    """
    asked = messages.filter(F.size("call_ids") > 0).select("id", F.explode("call_ids").alias("call_id"))
    answered = messages.filter("role = 'tool' and call_id is not null").select("call_id").distinct().withColumn("answered", F.lit(True))
    broken = asked.join(answered, "call_id", "left").groupBy("id").agg(F.bool_and(F.coalesce("answered", F.lit(False))).alias("whole")).filter("not whole")
    kept = messages.join(broken.select("id"), "id", "left_anti")
    calls = asked.join(broken.select("id"), "id", "left_anti").select("call_id").distinct()
    plain = kept.filter("role <> 'tool'")
    return plain.unionByName(kept.filter("role = 'tool'").join(calls, "call_id", "left_semi").select(*plain.columns))


def route(question: str, graph_words: tuple[str, ...] = ("related", "connected", "relationship", "between")) -> str:
    """The layer that a question's words point to: graph, long_term or short_term."""
    words = set(question.lower().split())
    if words & set(graph_words):
        return "graph"
    return "long_term" if words & {"prefer", "like", "always", "know", "who"} else "short_term"
