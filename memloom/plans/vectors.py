"""Vector queries with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import vectors as vec
from memloom.sources import views as v

W = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0)"
C = "list_cosine_similarity(v, q)"


def _query(s, d) -> list[float]:
    return v.vectors(s, d).filter("vec_id = 0").first()["v"]


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


def _knn(s, d, k=5):
    e = v.vectors(s, d)
    return vec.knn_join(e.filter("vec_id % 25 = 0"), e, k, "label")


def _hits(s, d):
    """Hits of three kinds: vectors by label, scored against vector 0."""
    kind = F.element_at(F.array(F.lit("message"), F.lit("entity"), F.lit("trace")), F.col("label") % 3 + 1)
    hits = vec.top_k(v.vectors(s, d), _query(s, d), 40)
    return hits.select(kind.alias("kind"), F.col("vec_id").alias("id"), "score")


def _tool_messages(s, d):
    """Every fourth event asks for two calls; odd events answer the call of their own number."""
    e = v.table(s, d, "events")
    calls = F.when(F.col("event_id") % 4 == 0, F.array(F.col("event_id") + 1, F.col("event_id") + 2 + F.col("event_id") % 3)).otherwise(F.array().cast("array<long>"))
    role = F.when(F.col("event_id") % 4 == 0, "assistant").when(F.col("event_id") % 2 == 1, "tool").otherwise("user")
    return e.select(F.col("event_id").alias("id"), role.alias("role"), calls.alias("call_ids"), F.when(F.col("event_id") % 2 == 1, F.col("event_id")).alias("call_id"))


KNN = """, p AS (SELECT a.vec_id AS id, b.vec_id AS other, list_cosine_similarity(a.v, b.v) AS score FROM e a JOIN e b
    ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 25 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM p)"""
HITS = f""", h AS (SELECT CASE label % 3 WHEN 0 THEN 'message' WHEN 1 THEN 'entity' ELSE 'trace' END AS kind, vec_id AS id, {C} AS score
  FROM e, q ORDER BY score DESC, id LIMIT 40)"""

QUERIES = {
    "VEC-01_top_k": lambda s, d: _rounded(vec.top_k(v.vectors(s, d), _query(s, d), 10).select("vec_id", "label", "score")),
    "VEC-01_top_k_filtered": lambda s, d: _rounded(vec.top_k(v.vectors(s, d), _query(s, d), 10, 0.05, F.col("label") == 3).select("vec_id", "score")),
    "VEC-02_knn_join": lambda s, d: _rounded(_knn(s, d).select("id", "other", "score", "rank")),
    "VEC-05_merged_layers": lambda s, d: _rounded(vec.merged(
        {f"label{n}": vec.top_k(v.vectors(s, d), _query(s, d), 5, where=F.col("label") == n).select(F.col("vec_id").alias("id"), "score") for n in range(3)}, 8
    )),
    "VEC-08_round_robin": lambda s, d: _rounded(vec.round_robin(_hits(s, d), ["entity", "message", "trace"], 9)),
    "VEC-10_whole_tool_calls": lambda s, d: vec.whole_tool_calls(_tool_messages(s, d)).select("id", "role"),
    "DD-01_similar_entities": lambda s, d: _rounded(_knn(s, d).filter("score >= 0.3").select("id", "other", "score")),
}
ORACLES = {
    "VEC-01_top_k": f"{W} SELECT vec_id, label, round({C}, 6) AS score FROM e, q ORDER BY {C} DESC, vec_id LIMIT 10",
    "VEC-01_top_k_filtered": f"{W} SELECT vec_id, round({C}, 6) AS score FROM e, q WHERE label = 3 AND {C} >= 0.05 ORDER BY {C} DESC, vec_id LIMIT 10",
    "VEC-02_knn_join": f"{W}{KNN} SELECT id, other, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5",
    "VEC-05_merged_layers": f"""{W}, t AS (SELECT concat('label', label) AS kind, CAST(vec_id AS VARCHAR) AS id, {C} AS score FROM e, q WHERE label < 3
      QUALIFY row_number() OVER (PARTITION BY label ORDER BY {C} DESC, vec_id) <= 5)
      SELECT kind, id, round(score, 6) AS score FROM t ORDER BY t.score DESC, kind, id LIMIT 8""",
    "VEC-08_round_robin": f"""{W}{HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS rank FROM h)
      SELECT kind, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r ORDER BY r.rank, kind LIMIT 9""",
    "VEC-10_whole_tool_calls": """WITH m AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'assistant' WHEN event_id % 2 = 1 THEN 'tool' ELSE 'user' END AS role
      FROM events),
      a AS (SELECT id, unnest([id + 1, id + 2 + id % 3]) AS call_id FROM m WHERE role = 'assistant'),
      broken AS (SELECT DISTINCT id FROM a WHERE call_id NOT IN (SELECT id FROM m WHERE role = 'tool')),
      ok AS (SELECT call_id FROM a WHERE id NOT IN (SELECT id FROM broken))
      SELECT id, role FROM m WHERE (role <> 'tool' AND id NOT IN (SELECT id FROM broken)) OR (role = 'tool' AND id IN (SELECT call_id FROM ok))""",
    "DD-01_similar_entities": f"{W}{KNN} SELECT id, other, round(score, 6) AS score FROM r WHERE rank <= 5 AND score >= 0.3",
}
