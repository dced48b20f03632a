"""Queries over duplicates found on writing, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import dedup as dd
from memloom.sources import views as v
from memloom.sources.shared import cut

ALIKE = 0.3


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return dd.like_pairs(v.vectors(s, d), ALIKE, "label")


def _found(s: SparkSession, d: str) -> DataFrame:
    return dd.first_kept(v.vectors(s, d).select(F.col("vec_id").alias("id")), _pairs(s, d))


def _facts(s: SparkSession, d: str) -> DataFrame:
    return v.vectors(s, d).select(
        F.col("vec_id").alias("id"), F.concat(F.lit("s"), "label").alias("subject"), F.lit("knows").alias("predicate"), F.concat(F.lit("o"), F.col("vec_id") % 7).alias("object"),
        (F.col("vec_id") * 37 % 101).cast("double").alias("confidence"),
    )


def _backfilled(s: SparkSession, d: str) -> DataFrame:
    """Of every third vector it is not known."""
    some = v.vectors(s, d).select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 > 0, F.col("v")).alias("v"))
    return dd.backfilled_vectors(some, cut(_found(s, d))).select("id", F.round(F.get("v", F.lit(0)), 6).alias("first"))


#: The sequential rule as a recursion over the rows in order; ids follow the pairs, with their scores.
SEQUENCE = f"""WITH RECURSIVE e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  pair AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS score FROM e x JOIN e y ON x.label = y.label AND x.id < y.id WHERE list_cosine_similarity(x.v, y.v) >= {ALIKE}),
  nb AS (SELECT b, list(a) AS l FROM pair GROUP BY b),
  o AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM e),
  walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL
    SELECT o.k, CASE WHEN l IS NOT NULL AND len(list_intersect(kept, l)) > 0 THEN kept ELSE list_append(kept, o.id) END FROM walk JOIN o ON o.k = walk.k + 1 LEFT JOIN nb ON b = o.id),
  kept AS (SELECT unnest(kept) AS id FROM walk WHERE k = (SELECT max(k) FROM walk)),
  found AS (SELECT id, id AS kept_id, NULL::DOUBLE AS score FROM kept
    UNION ALL SELECT b, arg_max(a, (score, -a)), max(score) FROM pair WHERE a IN (SELECT id FROM kept) AND b NOT IN (SELECT id FROM kept) GROUP BY b) """
QUERIES = {
    "LT-09_like_pairs": lambda s, d: _pairs(s, d).select("a", "b", F.round("score", 6).alias("score")),
    "LT-10_preferences_on_write": lambda s, d: _found(s, d).select("id", "kept_id", F.round("score", 6).alias("score")),
    "LT-14_facts_on_write": lambda s, d: dd.folded_facts(_facts(s, d), cut(_found(s, d))),
    "LT-25_backfilled_vectors": _backfilled,
}
ORACLES = {
    "LT-09_like_pairs": SEQUENCE + "SELECT a, b, round(score, 6) AS score FROM pair",
    "LT-10_preferences_on_write": SEQUENCE + "SELECT id, kept_id, round(score, 6) AS score FROM found",
    "LT-14_facts_on_write": SEQUENCE + """, f AS (SELECT id, kept_id, (id * 37 % 101)::DOUBLE AS confidence, 'o' || (id % 7) AS object, label FROM found JOIN e USING (id))
      SELECT kept_id AS id, 's' || arg_min(label, id) AS subject, 'knows' AS predicate, arg_max(object, (confidence, -id)) AS object, max(confidence) AS confidence, count(*) AS written
      FROM f GROUP BY kept_id""",
    "LT-25_backfilled_vectors": SEQUENCE + "SELECT kept_id AS id, round(arg_min(v[1], id) FILTER (id % 3 > 0), 6) AS first FROM found JOIN e USING (id) GROUP BY kept_id",
}
