"""Duplicates found when rows are written: what comes first stays, later rows that are too like it are folded into it.

The rule is sequential: rows come in the order of their ids, and one is dropped if
a row of its group that was kept before is at least `threshold` alike. That is the
lexicographically first independent set of the graph of like pairs, and it is found in
rounds for all rows at once: a row is kept when none of its earlier neighbours is
still open or kept, and dropped as soon as one is kept. Rounds are as
many as the longest run of rows that wait for each other; each is cut in the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.sources.shared import cut

#: Rows of a block of neighbours in a ring.
BLOCK = 1024


def like_pairs(vectors: DataFrame, threshold: float, group: str, id_col: str = "vec_id") -> DataFrame:
    """(a, b, score): pairs a < b of one group whose cosine is at least `threshold` (above 0); vectors has id_col, group and v of one length.

    Each group has a pivot, its least vector by id. Unit vectors that alike are at most
    sqrt(2 - 2 * threshold) apart, and so their distances to the pivot differ by no more: only
    rows of one ring of that width, or of the next, can be a pair. Rings are dealt in
    blocks of about BLOCK rows; a pair of blocks is one matrix product. Nothing is left out.
    """
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-9
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.filter(norm > 0).select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.transform("v", lambda x: x / norm).alias("v"))
    pivot = unit.groupBy("g").agg(F.min_by("v", "id").alias("p"))
    away = F.sqrt(F.aggregate(F.zip_with("v", "p", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    ringed = cut(unit.join(pivot, "g").select("g", "id", "v", F.floor(away / width).alias("ring")))
    sizes = ringed.groupBy("g", "ring").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    after = sizes.select("g", (F.col("ring") - 1).alias("ring"), F.col("blocks").alias("next_blocks"))
    dealt = ringed.join(sizes, ["g", "ring"]).join(after, ["g", "ring"], "left").withColumn("i", F.pmod(F.xxhash64("id"), "blocks"))
    none = F.array().cast("array<struct<ring:bigint,i:bigint,j:bigint>>")

    def keys(blocks, make) -> F.Column:
        return F.when(blocks.isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), make)).otherwise(none)

    def key(ring, i, j) -> F.Column:
        return F.struct(ring.cast("long").alias("ring"), i.cast("long").alias("i"), j.cast("long").alias("j"))

    ring, i = F.col("ring"), F.col("i")
    # Within a ring blocks meet as (i, j >= i), j numbered from 0; blocks of the next ring have numbers below 0.
    own = keys(F.col("blocks"), lambda j: key(ring, F.least(i, j), F.greatest(i, j)))
    ahead = keys(F.col("next_blocks"), lambda j: key(ring, i, -1 - j))
    left = dealt.withColumn("k", F.explode(F.concat(own, ahead))).select("g", "k", "id", "v", F.lit(0).alias("side"))
    before = sizes.select("g", (F.col("ring") + 1).alias("ring"), F.col("blocks").alias("before_blocks"))
    right = dealt.join(before, ["g", "ring"]).withColumn("k", F.explode(keys(F.col("before_blocks"), lambda j: key(ring - 1, j, -1 - i)))).select("g", "k", "id", "v", F.lit(1).alias("side"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["side"] == 0], rows[rows["side"] == 1]
        b = a if rows["k"].iloc[0]["j"] >= 0 else b
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "score": np.zeros(0)})
        s = np.array(a["v"].tolist()) @ np.array(b["v"].tolist()).T
        x, y = a["id"].to_numpy(np.int64), b["id"].to_numpy(np.int64)
        row, col = np.nonzero(s >= threshold)
        pairs = pd.DataFrame({"a": np.minimum(x[row], y[col]), "b": np.maximum(x[row], y[col]), "score": s[row, col]})
        return pairs[pairs["a"] < pairs["b"]]

    found = left.unionAll(right).groupBy("g", "k").applyInPandas(compare, "a long, b long, score double")
    return found.groupBy("a", "b").agg(F.max("score").alias("score"))


def first_kept(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, kept_id, score) of rows (id): itself and null for a kept row, else the kept row before it that is most like it (the least id on ties)."""
    edges = cut(pairs.select("a", "b", "score"))
    links, kept = edges.select("a", "b"), None
    ids = rows.select("id").distinct()
    late = links.select(F.col("b").alias("id")).distinct()
    kept, waiting = cut(ids.join(late, "id", "left_anti")), cut(late)
    decided = kept
    while not waiting.isEmpty():
        # those with a neighbour kept in the last round go, and all their links with them
        gone = links.join(decided.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        links = links.join(gone.withColumnRenamed("id", "b"), "b", "left_anti").join(gone.withColumnRenamed("id", "a"), "a", "left_anti")
        links = cut(links.join(decided.select(F.col("id").alias("a")), "a", "left_anti"))
        rest = waiting.join(gone, "id", "left_anti")
        decided = cut(rest.join(links.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
        kept = kept.unionAll(decided)
        waiting = cut(rest.join(decided, "id", "left_anti"))
    kept = cut(kept)
    chosen = edges.join(kept.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.max(F.struct("score", (-F.col("a")).alias("n"))).alias("best"))
    folded = chosen.join(kept, "id", "left_anti").select("id", (-F.col("best.n")).alias("kept_id"), "best.score")
    return kept.select("id", F.col("id").alias("kept_id"), F.lit(None).cast("double").alias("score")).unionAll(folded)


def folded_facts(facts: DataFrame, found: DataFrame) -> DataFrame:
    """Kept facts (id, subject, predicate) with the greatest confidence of those folded into them, and its object; the earliest on ties.

    found is first_kept of the facts. The object changes only with a higher confidence.
    """
    best = F.struct("confidence", (-F.col("id")).alias("n"))
    rows = facts.join(found.select("id", "kept_id"), "id")
    return rows.groupBy("kept_id").agg(
        F.min_by("subject", "id").alias("subject"), F.min_by("predicate", "id").alias("predicate"), F.max_by("object", best).alias("object"),
        F.max("confidence").alias("confidence"), F.count("*").alias("written"),
    ).withColumnRenamed("kept_id", "id")


def backfilled_vectors(entities: DataFrame, found: DataFrame) -> DataFrame:
    """(id, v) of kept entities: their own vector, or the first known one of what was folded into them."""
    rows = entities.join(found.select("id", "kept_id"), "id").groupBy("kept_id").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("id"))).alias("v"))
    return rows.withColumnRenamed("kept_id", "id")
