"""Queries of adoption, backfills, versions, retrieval scores and exact resolution with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import graph
from memloom.operators import resolution as rs
from memloom.operators import upkeep as up
from memloom.operators import vectors as vec
from memloom.sources import views as v

LIMITS = (("A", 0.7, None), ("N", 0.95, 0.5))
MOVES = (("person", "ACTOR", "HUMAN"), ("LOCATION", "SITE", None))
MENTIONS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'Unknown ' || p_partkey ELSE '  ' || upper(replace(p_name, ' ', '   ')) END AS name, CASE WHEN p_partkey % 7 = 0 THEN 'PERSON' ELSE 'OBJECT' END AS type FROM part"


def _sessions(s, d):
    c = v.table(s, d, "events").select(F.concat(F.lit("s"), F.col("user_id")).alias("session_id")).distinct()
    return c.withColumn("title", F.lower("session_id"))


def _mentions(s, d):
    p = v.table(s, d, "part")
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("Unknown "), k.cast("string"))).otherwise(F.concat(F.lit("  "), F.upper(F.replace("p_name", F.lit(" "), F.lit("   ")))))
    return p.select(k.alias("id"), name.alias("name"), F.when(k % 7 == 0, "PERSON").otherwise("OBJECT").alias("type"))


def _products(s, d):
    return v.entity_observations(s, d).filter("type = 'OBJECT'").select("name", "type")


def _versions(s, d):
    return v.table(s, d, "orders").select(
        F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").alias("revision"), F.md5(F.col("o_orderkey").cast("string")).alias("hash"),
        (F.col("o_orderkey") % 3 == 0).alias("active"),
    )


def _changes(s, d):
    e = F.col("event_id")
    return v.table(s, d, "events").select(
        (F.col("user_id") + 1).alias("id"), e.alias("seq"), F.when(e % 3 == 0, F.col("event_type")).alias("description"), F.when(e % 50 == 0, F.col("event_type")).alias("name"),
    )


def _customers(s, d):
    return v.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"))


def _query(s, d) -> list[float]:
    return v.vectors(s, d).filter("vec_id = 7").first()["v"]


def _vector_messages(s, d):
    """Messages in id order hold the vectors of equal place; the later ones have none."""
    return v.messages(s, d).withColumn("vec_id", F.col("conversation_id") * 8 + F.col("turn")).join(v.vectors(s, d).select("vec_id", "v"), "vec_id", "left")


def _found(s, d):
    k = F.col("l_orderkey")
    return v.table(s, d, "lineitem").select(k.alias("case"), F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("rank"))


def _expected(s, d):
    return v.table(s, d, "lineitem").filter("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("case"), F.col("l_suppkey").alias("id"))


def _name_pairs(s, d):
    """Each part's name with parts of it and its initials, in either order; odd parts are persons, even ones organisations."""
    kind = F.when(F.col("p_partkey") % 2 == 0, "ORGANIZATION").otherwise("PERSON")
    more = F.concat("p_name", F.lit(" "), F.lower("p_brand"), F.lit(" house"))
    p = v.table(s, d, "part").select("p_partkey", kind.alias("type"), F.regexp_replace(F.lower(more), "#", " ").alias("long"))
    w = F.split("long", " ")
    first = F.array_join(F.transform(w, lambda x: F.upper(F.substring(x, 1, 1))), "")
    short = F.array(F.element_at(w, 1), F.array_join(F.slice(w, 2, 2), " "), F.regexp_replace(first, "[0-9]", ""), first, F.substring(first, 1, 2), F.lower(first), F.col("long"))
    rows = p.select("p_partkey", "type", "long", F.explode(short).alias("short"))
    turned = F.col("p_partkey") % 3 == 0
    return rows.select("p_partkey", "type", F.when(turned, F.col("long")).otherwise(F.col("short")).alias("name_a"), F.when(turned, F.col("short")).otherwise(F.col("long")).alias("name_b"))


def _name_relations(s, d):
    named = rs.name_relations(F.col("type"), F.col("name_a"), F.lower("name_a"), F.col("name_b"), F.lower("name_b"))
    return _name_pairs(s, d).select("*", *[c.alias(n) for c, n in zip(named, ("prefix", "inside", "acronym"), strict=True)])


def _linked(s, d):
    """Parts and suppliers seen as one entity where their numbers follow one another by a fixed step."""
    k = F.col("s_suppkey")
    return v.table(s, d, "supplier").filter(k % 4 != 0).select(k.alias("src"), (k + 1).alias("dst"), F.lit("SAME_AS").alias("type"))


COSINE = "list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"
SEEN = f"""{v.with_sql('message')}, e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 7),
  m AS (SELECT id, role, v FROM message LEFT JOIN e ON vec_id = conversation_id * 8 + turn)"""

QUERIES = {
    "ST-01_created_conversations": lambda s, d: up.created(_sessions(s, d), v.messages(s, d).select("session_id"), "session_id"),
    "ST-08_messages_by_vector": lambda s, d: vec.top_k(_vector_messages(s, d).filter("v is not null"), _query(s, d), 10, 0.0, None, "id").select("id", F.round("score", 6).alias("score")),
    "ST-09_messages_by_vector_and_role": lambda s, d: vec.top_k(_vector_messages(s, d).filter("v is not null"), _query(s, d), 10, 0.0, F.col("role") == "assistant", "id").select("id", F.round("score", 6).alias("score")),
    "ST-14_messages_without_vectors": lambda s, d: up.without_vector(v.messages(s, d).select("id"), _vector_messages(s, d).select("id", "v")),
    "IO-09_adopted_parts": lambda s, d: up.adopted(v.table(s, d, "part").withColumn("n", F.when(F.col("p_partkey") % 10 != 0, F.col("p_name"))).withColumn("own", F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey"))), "Part", "OBJECT", "n", "own")[0],
    "IO-09_adoption_report": lambda s, d: up.adopted(v.table(s, d, "part").withColumn("n", F.when(F.col("p_partkey") % 10 != 0, F.col("p_name"))), "Part", "OBJECT", "n")[1],
    "LT-22_backfilled_types": lambda s, d: up.backfilled(v.relation_observations(s, d).select("seq", F.when(F.col("seq") % 3 == 0, F.col("type")).alias("type"), F.when(F.col("seq") % 2 == 0, F.col("evidence")).alias("evidence")), {"type": F.lit("RELATED_TO"), "evidence": F.col("seq").cast("string")}),
    "HO-01_updated_entities": lambda s, d: up.updated(_customers(s, d), _changes(s, d), ["name", "description"]),
    "ON-06_active_versions": lambda s, d: up.active_versions(_versions(s, d)),
    "SC-01_version_list": lambda s, d: up.version_list(_versions(s, d)),
    "ON-07_migrated": lambda s, d: up.migrated(v.entity_observations(s, d).select("seq", "type", "subtype"), s.createDataFrame(MOVES, "old_type string, new_type string, new_subtype string"))[0],
    "ON-07_dry_run": lambda s, d: up.migrated(v.entity_observations(s, d).select("seq", "type", "subtype"), s.createDataFrame(MOVES, "old_type string, new_type string, new_subtype string"))[1],
    "EV-01_recall_at_3": lambda s, d: up.recall_at(_expected(s, d), _found(s, d), 3).withColumn("recall", F.round("recall", 6)),
    "RS-10_name_relations": _name_relations,
    "RS-12_bands_by_type": lambda s, d: up.banded(v.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("type"), ((F.col("l_partkey") % 101).cast("double") / 100).alias("score")), s.createDataFrame(LIMITS, "type string, auto double, review double"), rs.AUTO, rs.REVIEW),
    "RS-16_exact_resolver": lambda s, d: up.exact_resolved(_mentions(s, d), _products(s, d)),
    "DD-04_same_as_clusters": lambda s, d: graph.reach(_linked(s, d), v.table(s, d, "supplier").select(F.col("s_suppkey").alias("id")), 3),
}
ORACLES = {
    "ST-01_created_conversations": f"""{v.with_sql('message')}, w AS (SELECT DISTINCT concat('s', user_id) AS session_id FROM events)
      SELECT session_id, lower(session_id) AS title FROM w WHERE session_id NOT IN (SELECT session_id FROM message)""",
    "ST-08_messages_by_vector": f"{SEEN} SELECT id, round({COSINE}, 6) AS score FROM m, q WHERE v IS NOT NULL AND {COSINE} >= 0 ORDER BY {COSINE} DESC, id LIMIT 10",
    "ST-09_messages_by_vector_and_role": f"{SEEN} SELECT id, round({COSINE}, 6) AS score FROM m, q WHERE v IS NOT NULL AND role = 'assistant' AND {COSINE} >= 0 ORDER BY {COSINE} DESC, id LIMIT 10",
    "ST-14_messages_without_vectors": f"{SEEN} SELECT id FROM m WHERE v IS NULL",
    "IO-09_adopted_parts": """SELECT CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'part:' || p_name END AS id, p_name AS name, 'OBJECT' AS type FROM part WHERE p_partkey % 10 <> 0""",
    "IO-09_adoption_report": "SELECT 'Part' AS label, count(*) FILTER (p_partkey % 10 <> 0) AS adopted, count(*) FILTER (p_partkey % 10 = 0) AS skipped FROM part",
    "LT-22_backfilled_types": f"""{v.with_sql('relation_obs')} SELECT seq, CASE WHEN seq % 3 = 0 THEN type ELSE 'RELATED_TO' END AS type,
      CASE WHEN seq % 2 = 0 THEN evidence ELSE CAST(seq AS VARCHAR) END AS evidence FROM relation_obs""",
    "HO-01_updated_entities": """SELECT c_custkey AS id, coalesce((SELECT arg_max(event_type, event_id) FROM events WHERE user_id + 1 = c_custkey AND event_id % 50 = 0), c_name) AS name,
      coalesce((SELECT arg_max(event_type, event_id) FROM events WHERE user_id + 1 = c_custkey AND event_id % 3 = 0), c_mktsegment) AS description FROM customer""",
    "ON-06_active_versions": "SELECT CAST(o_custkey AS VARCHAR) AS name, max(o_orderkey) AS revision FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1",
    "SC-01_version_list": """SELECT CAST(o_custkey AS VARCHAR) AS name, count(*) AS versions, max(o_orderkey) AS latest, md5(CAST(max(o_orderkey) AS VARCHAR)) AS hash,
      max(o_orderkey) FILTER (o_orderkey % 3 = 0) AS active_revision FROM orders GROUP BY 1""",
    "ON-07_migrated": f"""{v.with_sql('entity_obs')} SELECT seq, CASE type WHEN 'PERSON' THEN 'ACTOR' WHEN 'LOCATION' THEN 'SITE' ELSE type END AS type,
      CASE type WHEN 'PERSON' THEN 'HUMAN' WHEN 'LOCATION' THEN NULL ELSE subtype END AS subtype FROM entity_obs""",
    "ON-07_dry_run": f"""{v.with_sql('entity_obs')} SELECT CASE type WHEN 'PERSON' THEN 'person' ELSE type END AS old_type, CASE type WHEN 'PERSON' THEN 'ACTOR' ELSE 'SITE' END AS new_type,
      count(*) AS n FROM entity_obs WHERE type IN ('PERSON', 'LOCATION') GROUP BY ALL""",
    "EV-01_recall_at_3": """WITH w AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS id FROM lineitem WHERE l_linenumber % 2 = 0)
      SELECT k AS "case", round(avg(CASE WHEN EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = k AND l.l_suppkey = id AND l.l_linenumber <= 3) THEN 1.0 ELSE 0.0 END), 6) AS recall FROM w GROUP BY k""",
    "RS-10_name_relations": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'ORGANIZATION' ELSE 'PERSON' END AS type,
        replace(lower(p_name || ' ' || p_brand || ' house'), '#', ' ') AS long FROM part),
      i AS (SELECT *, string_split(long, ' ') AS w, array_to_string(list_transform(string_split(long, ' '), lambda x: upper(x[1])), '') AS first FROM p),
      e AS (SELECT p_partkey, type, long, first, unnest([w[1], array_to_string(w[2:3], ' '), regexp_replace(first, '[0-9]', '', 'g'), first, first[1:2], lower(first), long]) AS short FROM i),
      f AS (SELECT *, p_partkey % 3 = 0 AS turned, lower(short) AS k FROM e)
      SELECT p_partkey, type, CASE WHEN turned THEN long ELSE short END AS name_a, CASE WHEN turned THEN short ELSE long END AS name_b,
        k <> long AND starts_with(long || ' ', k || ' ') AS prefix, k <> long AND contains(' ' || long || ' ', ' ' || k || ' ') AS inside,
        type = 'ORGANIZATION' AND regexp_full_match(short, '[A-Z]{3,6}') AND short = first AS acronym FROM f""",
    "RS-12_bands_by_type": """WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag AS type, (l_partkey % 101)::DOUBLE / 100 AS score FROM lineitem)
      SELECT *, CASE WHEN score >= CASE type WHEN 'A' THEN 0.7::DOUBLE WHEN 'N' THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END THEN 'merged'
        WHEN score >= CASE type WHEN 'N' THEN 0.5::DOUBLE ELSE 0.85::DOUBLE END THEN 'review' ELSE 'created' END AS action FROM s""",
    "RS-16_exact_resolver": f"""WITH m AS ({MENTIONS}), n AS (SELECT lower(p_name) AS k, min(p_name) AS c FROM part GROUP BY 1)
      SELECT id AS mention, coalesce(CASE WHEN type = 'OBJECT' THEN c END, name) AS canonical FROM m LEFT JOIN n ON k = trim(regexp_replace(lower(name), ' +', ' ', 'g'))""",
    "DD-04_same_as_clusters": """WITH RECURSIVE l AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey + 1, s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0),
      r AS (SELECT s_suppkey AS start, s_suppkey AS node, 0 AS hops FROM supplier UNION SELECT start, b, hops + 1 FROM r JOIN l ON a = node WHERE hops < 3)
      SELECT start, node, min(hops) AS hops FROM r WHERE node <> start GROUP BY start, node""",
}
