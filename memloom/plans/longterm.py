"""Queries of the long-term layer with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import longterm as lt
from memloom.operators.shortterm import latest
from memloom.sources import views as v

E, R, P, G = v.with_sql("entity_obs"), v.with_sql("relation_obs"), v.with_sql("preference"), v.with_sql("edge")
AS_OF = "TIMESTAMP '2024-01-15 12:00:00'"
#: Entities are observed once more under their name with another description, so that folds have work.
AGAIN = """, obs AS (SELECT * FROM entity_obs UNION ALL
  SELECT 100000000 + seq, name, type, NULL, concat('again ', seq), confidence / 2 FROM entity_obs WHERE seq % 3 = 0)"""
KEYS = "list_sort(list_distinct([lower(name), lower(replace(name, '#', ' '))]))"


def _observed(s, d):
    once = v.entity_observations(s, d)
    again = once.filter("seq % 3 = 0").select(
        (F.col("seq") + 100_000_000).alias("seq"), "name", "type", F.lit(None).cast("string").alias("subtype"),
        F.concat(F.lit("again "), "seq").alias("description"), (F.col("confidence") / 2).alias("confidence"),
    )
    return once.unionAll(again)


def _keyed(s, d):
    e = lt.fold_entities(v.entity_observations(s, d))
    return e.withColumn("keys", lt.entity_keys(F.col("name"), F.array(F.translate("name", "#", " "))))


def _facts(s, d):
    return v.table(s, d, "orders").select(
        F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderkey").alias("object"),
        F.round(F.col("o_totalprice") % 100, 0).alias("confidence"), F.col("o_orderkey").alias("seq"),
    )


FACT = """WITH fact AS (SELECT o_custkey AS subject, o_orderpriority AS predicate, o_orderkey AS object,
  round(o_totalprice % 100, 0) AS confidence, o_orderkey AS seq FROM orders)"""


def _pairs(s, d):
    return v.preferences(s, d).filter("id % 7 = 0").select(F.col("id").alias("old"), (F.col("id") + 1).alias("new"))


def _named_relations(s, d):
    edge = v.table(s, d, "supplier").join(v.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return edge.select(F.col("s_suppkey").alias("message_id"), F.upper("s_name").alias("source"), F.lit("HEADQUARTERS_AT").alias("type"), F.lower("n_name").alias("target"))


def _mentions(s, d):
    return v.table(s, d, "supplier").filter("s_suppkey % 2 = 0").select(
        F.col("s_suppkey").alias("message_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") + 500).alias("entity_id")
    )


QUERIES = {
    "LT-01_fold_entities": lambda s, d: lt.fold_entities(_observed(s, d)),
    "LT-02_entity_keys": lambda s, d: _keyed(s, d).select("id", F.array_join("keys", "|").alias("surface_keys")),
    "LT-03_entity_by_name": lambda s, d: lt.by_name(_keyed(s, d), "Supplier 000000007").select("id", "name", "type"),
    "LT-04_types_of_pairs": lambda s, d: lt.fold_entities(v.entity_observations(s, d)).filter(F.col("id").isin(7, 10000007)).select("id", "type"),
    "LT-06_newest_of_type": lambda s, d: v.entity_observations(s, d).filter("type = 'OBJECT'").orderBy(F.desc("seq")).limit(20).select("seq", "name"),
    "LT-07_entities_without_description": lambda s, d: v.entity_observations(s, d).filter("description is null").orderBy("seq").offset(5).limit(25).select("seq", "name"),
    "LT-11_preferences_by_category": lambda s, d: v.preferences(s, d).filter("category = 'click'").orderBy(F.desc("value"), F.desc("valid_from"), "id").limit(20).select("id", "value"),
    "LT-12_preferences_as_of": lambda s, d: lt.valid_at(lt.active(v.preferences(s, d), _pairs(s, d)), F.expr(AS_OF)).select("id", "user_id", "category"),
    "LT-13_supersede": lambda s, d: lt.supersede(v.preferences(s, d), _pairs(s, d), F.expr(AS_OF)).select("id", "valid_until"),
    "LT-14_fold_facts": lambda s, d: lt.fold_facts(_facts(s, d)),
    "LT-15_facts_of_subject": lambda s, d: _facts(s, d).filter("subject = 7").orderBy(F.desc("confidence"), F.desc("seq")).limit(50).select("object", "predicate", "confidence"),
    "LT-16_fold_relations": lambda s, d: lt.fold_relations(v.relation_observations(s, d)).select(
        "source", "type", "target", "confidence", "support", "derived",
        F.concat_ws(",", F.transform("source_message_ids", lambda x: x.cast("string"))).alias("source_message_ids"), F.concat_ws(",", "evidence").alias("evidence"),
    ),
    "LT-17_resolve_relation_ends": lambda s, d: lt.resolve_ends(
        _named_relations(s, d), _mentions(s, d), lt.fold_entities(v.entity_observations(s, d))
    ).select("message_id", "source_id", "type", "target_id"),
    "LT-19_neighbours": lambda s, d: lt.neighbours(v.edges(s, d), v.edges(s, d).filter("src % 1000 < 40").select(F.col("src").alias("id"))),
    "LT-19_all_neighbours": lambda s, d: lt.neighbours(v.edges(s, d), v.edges(s, d).select(F.explode(F.array("src", "dst")).alias("id"))),
    "LT-20_first_link": lambda s, d: lt.first_links(v.relation_observations(s, d), ["source", "evidence"], "seq").select("source", "evidence", "seq"),
    "LT-24_add_aliases": lambda s, d: lt.add_aliases(
        v.entity_observations(s, d).filter("type = 'LOCATION'").select(F.col("seq").alias("id"), F.array("name").alias("aliases")),
        v.entity_observations(s, d).filter("type = 'LOCATION'").select(F.col("seq").alias("id"), F.explode(F.array(F.lower("name"), "name")).alias("alias")),
    ).select("id", F.array_join("aliases", "|").alias("aliases")),
    "LT-16_latest_relation_of_source": lambda s, d: latest(v.relation_observations(s, d), ["source"], [F.desc("seq")]).select("source", "target", "seq"),
}

ORACLES = {
    "LT-01_fold_entities": f"""{E}{AGAIN} SELECT name, type, min(seq) AS id, arg_max(subtype, seq) FILTER (subtype IS NOT NULL) AS subtype,
      arg_max(description, seq) FILTER (description IS NOT NULL) AS description, max(confidence) AS confidence, count(*) AS observed FROM obs GROUP BY name, type""",
    "LT-02_entity_keys": f"{E} SELECT min(seq) AS id, array_to_string({KEYS}, '|') AS surface_keys FROM entity_obs GROUP BY name, type",
    "LT-03_entity_by_name": f"""{E} SELECT min(seq) AS id, name, type FROM entity_obs
      WHERE list_contains({KEYS}, 'supplier 000000007') GROUP BY name, type""",
    "LT-04_types_of_pairs": f"{E}, f AS (SELECT min(seq) AS id, name, type FROM entity_obs GROUP BY name, type) SELECT id, type FROM f WHERE id IN (7, 10000007)",
    "LT-06_newest_of_type": f"{E} SELECT seq, name FROM entity_obs WHERE type = 'OBJECT' ORDER BY seq DESC LIMIT 20",
    "LT-07_entities_without_description": f"{E} SELECT seq, name FROM entity_obs WHERE description IS NULL ORDER BY seq LIMIT 25 OFFSET 5",
    "LT-11_preferences_by_category": f"{P} SELECT id, value FROM preference WHERE category = 'click' ORDER BY value DESC, valid_from DESC, id LIMIT 20",
    "LT-12_preferences_as_of": f"""{P} SELECT id, user_id, category FROM preference WHERE id % 7 <> 0 AND valid_from <= {AS_OF}
      AND (valid_until IS NULL OR valid_until > {AS_OF})""",
    "LT-13_supersede": f"{P} SELECT id, coalesce(valid_until, CASE WHEN id % 7 = 0 THEN {AS_OF} END) AS valid_until FROM preference",
    "LT-14_fold_facts": f"""{FACT} SELECT subject, predicate, arg_max(object, (confidence, -seq)) AS object, max(confidence) AS confidence,
      count(*) AS support FROM fact GROUP BY subject, predicate""",
    "LT-15_facts_of_subject": f"{FACT} SELECT object, predicate, confidence FROM fact WHERE subject = 7 ORDER BY confidence DESC, seq DESC LIMIT 50",
    "LT-16_fold_relations": f"""{R}, r AS (SELECT * FROM relation_obs WHERE source <> target),
      m AS (SELECT source, type, target, message_id, min(seq) AS seq FROM r GROUP BY ALL),
      m2 AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY source, type, target ORDER BY seq, message_id) <= 25),
      e AS (SELECT source, type, target, evidence, min(seq) AS seq FROM r GROUP BY ALL),
      e2 AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source, type, target ORDER BY seq, evidence) <= 3)
      SELECT * FROM (SELECT source, type, target, max(confidence) AS confidence, count(*) AS support, bool_and(derived) AS derived FROM r GROUP BY ALL)
      JOIN (SELECT source, type, target, string_agg(message_id, ',' ORDER BY seq, message_id) AS source_message_ids FROM m2 GROUP BY ALL) USING (source, type, target)
      JOIN (SELECT source, type, target, string_agg(evidence, ',' ORDER BY seq, evidence) AS evidence FROM e2 GROUP BY ALL) USING (source, type, target)""",
    "LT-17_resolve_relation_ends": f"""{E}, w AS (SELECT lower(name) AS n, min(seq) AS id FROM entity_obs GROUP BY 1)
      SELECT s_suppkey AS message_id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 500 ELSE a.id END AS source_id, 'HEADQUARTERS_AT' AS type, b.id AS target_id
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN w a ON a.n = lower(s_name) JOIN w b ON b.n = lower(n_name)""",
    "LT-19_neighbours": f"""{G}, ids AS (SELECT DISTINCT src AS id FROM edge WHERE src % 1000 < 40),
      b AS (SELECT src AS id, dst AS neighbour, type, true AS outgoing FROM edge UNION ALL SELECT dst, src, type, false FROM edge)
      SELECT b.* FROM b JOIN ids USING (id)""",
    "LT-19_all_neighbours": f"""{G} SELECT src AS id, dst AS neighbour, type, true AS outgoing FROM edge
      UNION ALL SELECT dst, src, type, false FROM edge""",
    "LT-20_first_link": f"{R} SELECT source, evidence, min(seq) AS seq FROM relation_obs GROUP BY source, evidence",
    "LT-24_add_aliases": f"""{E} SELECT seq AS id, array_to_string(list_sort(list_distinct([name, lower(name)])), '|') AS aliases
      FROM entity_obs WHERE type = 'LOCATION'""",
    "LT-16_latest_relation_of_source": f"{R} SELECT source, arg_max(target, seq) AS target, max(seq) AS seq FROM relation_obs GROUP BY source",
}
