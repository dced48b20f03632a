"""Queries over provenance, places and duplicates with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import longterm as lt
from memloom.operators import provenance as pv
from memloom.sources import views as v

L = """WITH link AS (SELECT l_partkey AS entity_id, l_orderkey AS message_id, concat(l_returnflag, l_linestatus) AS extractor, 1 - l_discount AS confidence,
  l_linenumber AS start_pos FROM lineitem)"""
PLACE, R, P = v.with_sql("place"), v.with_sql("relation_obs"), v.with_sql("preference")
HAVERSINE = """2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians(10 - latitude) / 2), 2) +
  cos(radians(latitude)) * cos(radians(10)) * pow(sin(radians(20 - longitude) / 2), 2))))"""


def _links(s, d):
    return v.table(s, d, "lineitem").select(
        F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("message_id"), F.concat("l_returnflag", "l_linestatus").alias("extractor"),
        (1 - F.col("l_discount")).alias("confidence"), F.col("l_linenumber").alias("start_pos"),
    )


def _extractors(s, d):
    return v.table(s, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("extractor")).distinct().unionAll(s.createDataFrame([("unused",)], "extractor string"))


def _candidates(s, d):
    """Pairs of parts by supplier and line number, in either order."""
    r = v.relation_observations(s, d)
    return r.select(F.col("source").alias("a"), (F.col("target") % 97).alias("b"), "confidence")


def _known(s, d):
    return s.range(0, 97).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))


def _merges(s, d):
    """Part p with p % 10 = 3 is merged into p - 1, and p % 10 = 2 into p - 2: chains of two."""
    p = v.table(s, d, "part").select(F.col("p_partkey").alias("source"))
    return p.filter("source % 10 in (2, 3)").select("source", F.when(F.col("source") % 10 == 3, F.col("source") - 1).otherwise(F.col("source") - 2).alias("target"))


def _folded(s, d):
    return lt.fold_relations(v.relation_observations(s, d)).select("source", "type", "target", "confidence", "support", "derived")


def _neighbours(s, d):
    """Of each preference, those whose id is one, two or three greater."""
    p = v.preferences(s, d).select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    return p.select("id", (F.col("id") + F.col("k")).alias("other"), (1 / F.col("k")).alias("score"))


def _counts(s, d):
    tables = {"conversations": "conversations", "events": "steps", "customer": "entities", "orders": "facts"}
    rows = [v.table(s, d, t).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n") for t, name in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


QUERIES = {
    "PV-02_fold_links": lambda s, d: pv.fold_links(_links(s, d)),
    "PV-03_provenance": lambda s, d: pv.provenance(_links(s, d)).withColumn("extractors", F.array_join("extractors", ",")),
    "PV-04_entities_of_message": lambda s, d: _links(s, d).filter("message_id = 7").orderBy("start_pos").select("entity_id", "start_pos", "confidence"),
    "PV-05_entities_of_extractor": lambda s, d: _links(s, d).filter("extractor = 'NO'").orderBy(F.desc("message_id"), "start_pos").limit(50).select("entity_id", "message_id"),
    "PV-06_extraction_stats": lambda s, d: _links(s, d).agg(
        F.count_distinct("entity_id").alias("entities"), F.count_distinct("message_id").alias("messages"), F.array_join(F.array_sort(F.collect_set("extractor")), ",").alias("extractors")
    ),
    "PV-07_extractor_stats": lambda s, d: pv.extractor_stats(_extractors(s, d), _links(s, d)).withColumn("confidence", F.round("confidence", 6)),
    "PV-08_delete_provenance": lambda s, d: _links(s, d).join(s.range(0, 1000).select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select("entity_id", "message_id", "start_pos"),
    "PV-09_memory_stats": _counts,
    "PV-10_touched_entities": lambda s, d: v.steps(s, d).select(F.col("id").alias("step_id"), (F.col("id") % 1500 + 1).alias("c_custkey")).join(
        v.table(s, d, "customer").select("c_custkey", "c_name"), "c_custkey").groupBy("c_name").agg(F.count("*").alias("steps")),
    "GEO-01_near": lambda s, d: pv.near(v.places(s, d), 10.0, 20.0, 6_000_000.0).select("id", "name", F.round("distance_m", 3).alias("distance_m")),
    "GEO-02_in_box": lambda s, d: pv.in_box(v.places(s, d), -30.0, 100.0, 60.0, -100.0).select("id", "name"),
    "GEO-03_without_coordinates": lambda s, d: pv.geocode(v.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.upper("n_name").alias("name")), v.places(s, d).filter("id % 4 <> 0"))
    .filter("latitude is null").select("id", "name"),
    "GEO-05_geocode": lambda s, d: pv.geocode(
        v.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("  "), F.lower("n_name")).alias("name")), v.places(s, d)
    ).select("id", "latitude", "longitude"),
    "DD-02_same_as": lambda s, d: pv.same_as(_candidates(s, d), _known(s, d)),
    "DD-03_potential_duplicates": lambda s, d: pv.same_as(_candidates(s, d), _known(s, d)).orderBy(F.desc("confidence"), "a", "b").limit(100).select("a", "b", "confidence"),
    "DD-05_merge_entities": lambda s, d: lt.refold_relations(pv.rewritten(_folded(s, d), pv.final_targets(_merges(s, d)), "target")),
    "DD-06_reviewed": lambda s, d: pv.reviewed(
        pv.same_as(_candidates(s, d), _known(s, d)), s.range(0, 97).select(F.col("id").alias("a"), (F.col("id") + 2).alias("b"), (F.col("id") % 2 == 0).alias("confirmed"))
    ).groupBy("status").agg(F.count("*").alias("n")),
    "DD-08_dedup_stats": lambda s, d: v.table(s, d, "part").select("p_partkey").join(
        pv.final_targets(_merges(s, d)).select(F.col("source").alias("p_partkey"), "target"), "p_partkey", "left"
    ).agg(F.count("*").alias("total"), F.count("target").alias("merged"), F.count_distinct("target").alias("targets")),
    "DD-10_superseded": lambda s, d: pv.superseded_pairs(v.preferences(s, d), _neighbours(s, d)).select("old", "new", F.round("score", 6).alias("score")),
    "DD-11_long_traces": lambda s, d: v.steps(s, d).groupBy("trace_id").agg(F.count("*").alias("steps")).filter("steps >= 60"),
    "DD-12_expired": lambda s, d: v.messages(s, d).groupBy("conversation_id").agg(F.max("ts").alias("updated_at")).filter("updated_at < timestamp'2024-01-04 12:00:00' - interval 1 day"),
}

PAIR = """, c AS (SELECT least(source, target % 97) AS a, greatest(source, target % 97) AS b, max(confidence) AS confidence FROM relation_obs
  WHERE source <> target % 97 GROUP BY 1, 2), s AS (SELECT a, b, confidence, 'pending' AS status FROM c WHERE NOT (b = a + 1 AND a < 97))"""
ORACLES = {
    "PV-02_fold_links": f"{L} SELECT entity_id, message_id, extractor, max(confidence) AS confidence, min(start_pos) AS start_pos FROM link GROUP BY 1, 2, 3",
    "PV-03_provenance": f"""{L} SELECT entity_id, count(DISTINCT message_id) AS n_sources, max(confidence) AS confidence,
      array_to_string(list_sort(list(DISTINCT extractor)), ',') AS extractors FROM link GROUP BY entity_id""",
    "PV-04_entities_of_message": f"{L} SELECT entity_id, start_pos, confidence FROM link WHERE message_id = 7",
    "PV-05_entities_of_extractor": f"{L} SELECT entity_id, message_id FROM link WHERE extractor = 'NO' ORDER BY message_id DESC, start_pos LIMIT 50",
    "PV-06_extraction_stats": f"""{L} SELECT count(DISTINCT entity_id) AS entities, count(DISTINCT message_id) AS messages,
      array_to_string(list_sort(list(DISTINCT extractor)), ',') AS extractors FROM link""",
    "PV-07_extractor_stats": f"""{L} SELECT extractor, count(DISTINCT entity_id) AS entities, round(avg(confidence), 6) AS confidence FROM link GROUP BY extractor
      UNION ALL SELECT 'unused', 0, NULL""",
    "PV-08_delete_provenance": f"{L} SELECT entity_id, message_id, start_pos FROM link WHERE NOT entity_id BETWEEN 0 AND 999",
    "PV-09_memory_stats": """SELECT 'conversations' AS kind, count(*) AS n FROM conversations UNION ALL SELECT 'steps', count(*) FROM events
      UNION ALL SELECT 'entities', count(*) FROM customer UNION ALL SELECT 'facts', count(*) FROM orders""",
    "PV-10_touched_entities": "SELECT c_name, count(*) AS steps FROM events JOIN customer ON c_custkey = event_id % 1500 + 1 GROUP BY c_name",
    "GEO-01_near": f"{PLACE} SELECT id, name, round({HAVERSINE}, 3) AS distance_m FROM place WHERE {HAVERSINE} <= 6000000",
    "GEO-02_in_box": f"{PLACE} SELECT id, name FROM place WHERE latitude BETWEEN -30 AND 60 AND (longitude >= 100 OR longitude <= -100)",
    "GEO-03_without_coordinates": "SELECT n_nationkey AS id, upper(n_name) AS name FROM nation WHERE n_nationkey % 4 = 0",
    "GEO-05_geocode": f"{PLACE} SELECT id, latitude, longitude FROM place",
    "DD-02_same_as": f"{R}{PAIR} SELECT * FROM s",
    "DD-03_potential_duplicates": f"{R}{PAIR} SELECT a, b, confidence FROM s ORDER BY confidence DESC, a, b LIMIT 100",
    "DD-05_merge_entities": f"""{R}, r AS (SELECT source, type, CASE WHEN target % 10 = 3 THEN target - 3 WHEN target % 10 = 2 THEN target - 2 ELSE target END AS target,
      confidence, derived FROM relation_obs WHERE source <> target)
      SELECT source, type, target, max(confidence) AS confidence, CAST(count(*) AS BIGINT) AS support, bool_and(derived) AS derived
      FROM r WHERE source <> target GROUP BY source, type, target""",
    "DD-06_reviewed": f"""{R}{PAIR} SELECT CASE WHEN b = a + 2 AND a < 97 THEN CASE WHEN a % 2 = 0 THEN 'confirmed' ELSE 'rejected' END ELSE status END AS status,
      count(*) AS n FROM s GROUP BY 1""",
    "DD-08_dedup_stats": """WITH m AS (SELECT p_partkey, CASE p_partkey % 10 WHEN 3 THEN p_partkey - 3 WHEN 2 THEN p_partkey - 2 END AS target FROM part)
      SELECT count(*) AS total, count(target) AS merged, count(DISTINCT target) AS targets FROM m""",
    "DD-10_superseded": f"""{P} SELECT a.id AS old, b.id AS new, round(1.0 / (b.id - a.id), 6) AS score FROM preference a JOIN preference b
      ON b.id - a.id BETWEEN 1 AND 3 AND a.category = b.category AND a.value <> b.value AND b.valid_from > a.valid_from""",
    "DD-11_long_traces": "SELECT user_id AS trace_id, count(*) AS steps FROM events GROUP BY user_id HAVING count(*) >= 60",
    "DD-12_expired": f"""{v.with_sql('message')} SELECT conversation_id, max(ts) AS updated_at FROM message GROUP BY conversation_id
      HAVING max(ts) < TIMESTAMP '2024-01-03 12:00:00'""",
}
