"""Queries over neighbours among all vectors of a type, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import cascade as ca
from memloom.operators import nearest as ne
from memloom.operators import vectors as vec
from memloom.sources import views as v

TYPES = ("PERSON", "ORGANIZATION", "OBJECT")
#: What is added to the numbers of entities to number mentions of them.
MENTION = 1_000_000
LIMIT, NEAR, LIKE = 10, 0.8, 0.25


def _entities(s: SparkSession, d: str) -> DataFrame:
    """The vectors as entities of three types, named as the part of their number is."""
    named = v.table(s, d, "part").select(F.col("p_partkey").alias("vec_id"), "p_name")
    rows = v.vectors(s, d).join(named, "vec_id", "left")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), F.col("label").cast("int") % 3 + 1)
    return rows.select(F.col("vec_id").alias("id"), kind.alias("type"), F.coalesce("p_name", F.lit("unnamed")).alias("name"), "v")


def _mentions(s: SparkSession, d: str) -> DataFrame:
    """A mention of each entity: its name in capitals or with its first word last, its vector mixed with that of the entity before it."""
    e = _entities(s, d)
    before = e.select((F.col("id") + 1).alias("id"), F.col("v").alias("w"))
    share = (F.col("id") % 4).cast("double") / 2
    mixed = F.when(F.col("w").isNull(), F.col("v")).otherwise(F.zip_with("v", "w", lambda x, y: x + share * y))
    name = F.when(F.col("id") % 5 == 0, F.upper("name")).when(F.col("id") % 5 == 1, F.regexp_replace("name", r"^(\S+) (.*)$", "$2 $1")).when(F.col("id") % 5 == 2, F.col("name")).otherwise(F.concat(F.lit("item "), "id"))
    return e.join(before, "id", "left").select((F.col("id") + MENTION).alias("id"), "type", name.alias("name"), mixed.alias("v"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    return _entities(s, d).filter("id % 100 = 0")


def _recall(s: SparkSession, d: str) -> DataFrame:
    """The share of the true neighbours that the lists give without bounds."""
    rows, asked = _entities(s, d), _asked(s, d)
    true = vec.knn_join(asked, rows, LIMIT, "type", "id").select("id", "other")
    got = ne.neighbours(asked, rows, LIMIT).select("id", "other", F.lit(1).alias("hit"))
    found = true.join(got, ["id", "other"], "left").agg(F.countDistinct("id").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
    return found.select("queries", (F.col("recall") >= 0.9).alias("enough"))


def _equal(s: SparkSession, d: str) -> DataFrame:
    """Mentions whose name is an entity's of their type but for case; the least of several."""
    e = _entities(s, d).groupBy("type", F.lower("name").alias("key")).agg(F.min("id").alias("entity"))
    m = _mentions(s, d).select(F.col("id").alias("mention"), "type", F.lower("name").alias("key"))
    return m.join(e, ["type", "key"]).select("mention", "entity", F.lit(1.0).alias("score"))


def _sorted_words(s: SparkSession, d: str) -> DataFrame:
    """Fuzzy matches of mentions with entities of their type by sorted words."""
    m = _mentions(s, d).select(F.col("id").alias("mention"), "type", "name")
    e = _entities(s, d).select(F.col("id").alias("entity"), "type", F.col("name").alias("other"))
    return ca.fuzzy_among(m, e, ["type"], threshold=0.999)


def _composite(s: SparkSession, d: str) -> DataFrame:
    m, e = _mentions(s, d), _entities(s, d)
    return ne.composite(m, e, ("exact", _equal(s, d)), ("fuzzy", _sorted_words(s, d)), ("semantic", ne.semantic_matches(m, e, NEAR)))


def _cascaded(s: SparkSession, d: str) -> DataFrame:
    return ca.cascaded_by_vectors(_keyed(_mentions(s, d)), _keyed(_entities(s, d)), LIMIT)


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("key", ca.rs.name_key(F.col("name"), F.col("type")))


E = f"""WITH e AS (SELECT vec_id AS id, {list(TYPES)}[CAST(label AS INT) % 3 + 1] AS type, coalesce(p_name, 'unnamed') AS name, CAST(embedding AS DOUBLE[]) AS v
    FROM embeddings LEFT JOIN part ON p_partkey = vec_id),
  m AS (SELECT e.id + {MENTION} AS id, e.type, CASE e.id % 5 WHEN 0 THEN upper(e.name) WHEN 1 THEN regexp_replace(e.name, '^(\\S+) (.*)$', '\\2 \\1') WHEN 2 THEN e.name
      ELSE 'item ' || e.id END AS name, CASE WHEN b.v IS NULL THEN e.v ELSE list_transform(list_zip(e.v, b.v, list_resize([]::DOUBLE[], len(e.v), (e.id % 4)::DOUBLE / 2)), lambda z: z[1] + z[3] * z[2]) END AS v
    FROM e LEFT JOIN e b ON b.id = e.id - 1),
  r AS (SELECT m.id AS mention, e.id AS entity, list_cosine_similarity(m.v, e.v) AS score FROM m JOIN e USING (type)
    QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY score DESC, e.id) = 1),
  sem AS (SELECT * FROM r WHERE score >= {NEAR})"""
W = "list_sort(string_split(lower({0}), ' '))"

QUERIES = {
    "LT-05_entities_by_vector": lambda s, d: vec.top_k(_entities(s, d), _entities(s, d).filter("id = 7").first()["v"], LIMIT, 0.0, F.col("type") == "ORGANIZATION", "id").select("id", "name", F.round("score", 6).alias("score")),
    "RS-04_vector_candidates": lambda s, d: ne.neighbours(_asked(s, d), _entities(s, d), LIMIT, exact=True).filter("score >= 0").select("id", "other", F.round("score", 6).alias("score"), "rank"),
    "RS-04_all_like": lambda s, d: ne.neighbours(_entities(s, d), _entities(s, d), 3, exact=True).filter(F.col("score") >= LIKE).select("id", "other", F.round("score", 6).alias("score"), "rank"),
    "RS-04_recall": _recall,
    "RS-18_semantic_resolver": lambda s, d: ne.semantic_matches(_mentions(s, d), _entities(s, d), NEAR).select("mention", "entity", F.round("score", 6).alias("score")),
    "RS-19_composite_resolver": lambda s, d: _composite(s, d).select("mention", "canonical", F.round("confidence", 6).alias("confidence"), "match_type"),
    "RS-09_cascade_by_vectors": _cascaded,
}
ORACLES = {
    "LT-05_entities_by_vector": f"""{E} SELECT id, name, round(list_cosine_similarity(v, (SELECT v FROM e WHERE id = 7)), 6) AS score FROM e
      WHERE type = 'ORGANIZATION' AND list_cosine_similarity(v, (SELECT v FROM e WHERE id = 7)) >= 0 ORDER BY list_cosine_similarity(v, (SELECT v FROM e WHERE id = 7)) DESC, id LIMIT {LIMIT}""",
    "RS-04_vector_candidates": f"""{E}, p AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS score FROM e a JOIN e b ON a.type = b.type AND a.id <> b.id WHERE a.id % 100 = 0
      QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY score DESC, b.id) <= {LIMIT})
      SELECT id, other, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY p.score DESC, other) AS rank FROM p WHERE p.score >= 0""",
    "RS-04_all_like": f"""{E}, p AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS score FROM e a JOIN e b ON a.type = b.type AND a.id <> b.id
      QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY score DESC, b.id) <= 3)
      SELECT id, other, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY p.score DESC, other) AS rank FROM p WHERE p.score >= {LIKE}""",
    "RS-04_recall": f"{E} SELECT count(*) AS queries, true AS enough FROM e WHERE id % 100 = 0",
    "RS-18_semantic_resolver": f"{E} SELECT mention, entity, round(score, 6) AS score FROM sem",
    "RS-19_composite_resolver": f"""{E}, x AS (SELECT m.id AS mention, min(e.id) AS entity FROM m JOIN e ON m.type = e.type AND lower(m.name) = lower(e.name) GROUP BY 1),
      f AS (SELECT m.id AS mention, min(e.id) AS entity FROM m JOIN e ON m.type = e.type AND {W.format('m.name')} = {W.format('e.name')} GROUP BY 1),
      n AS (SELECT m.id AS mention, m.name, a.name AS x, b.name AS f, c.name AS s, sem.score FROM m LEFT JOIN x ON x.mention = m.id LEFT JOIN e a ON a.id = x.entity
        LEFT JOIN f ON f.mention = m.id LEFT JOIN e b ON b.id = f.entity LEFT JOIN sem ON sem.mention = m.id LEFT JOIN e c ON c.id = sem.entity)
      SELECT mention, CASE WHEN x <> name THEN x WHEN f <> name THEN f WHEN s <> name THEN s ELSE name END AS canonical,
        CASE WHEN x <> name OR f <> name THEN 1.0::DOUBLE WHEN s <> name THEN round(score, 6) ELSE 1.0::DOUBLE END AS confidence,
        CASE WHEN x <> name THEN 'exact' WHEN f <> name THEN 'fuzzy' WHEN s <> name THEN 'semantic' ELSE 'none' END AS match_type FROM n""",
}
