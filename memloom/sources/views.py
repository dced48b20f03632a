"""The memory tables as projections of the star-schema test tables.

Each function takes (spark, sf_dir) and returns a lazy DataFrame with a fixed
set of columns, so column pruning and filters reach the Parquet scan. SQL holds
the same projections for the oracle engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "message": """
  SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id,
         concat('s', conv_id % 25) AS session_id, concat('u', conv_id % 10) AS user_identifier,
         turn, role, text AS content,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS BIGINT)) + to_minutes(CAST(turn AS BIGINT)) AS ts
  FROM conversations""",
    "entity_obs": """
  SELECT c_custkey AS seq, c_name AS name, 'PERSON' AS type, 'INDIVIDUAL' AS subtype, c_mktsegment AS description, 0.9::DOUBLE AS confidence FROM customer
  UNION ALL SELECT 10000000 + s_suppkey, s_name, 'ORGANIZATION', 'COMPANY', NULL, 0.8::DOUBLE FROM supplier
  UNION ALL SELECT 20000000 + n_nationkey, n_name, 'LOCATION', 'COUNTRY', NULL, 1.0::DOUBLE FROM nation
  UNION ALL SELECT 30000000 + r_regionkey, r_name, 'LOCATION', 'REGION', NULL, 1.0::DOUBLE FROM region
  UNION ALL SELECT 40000000 + p_partkey, p_name, 'OBJECT', 'PRODUCT', p_brand, 0.5::DOUBLE + (p_size % 50)::DOUBLE / 100 FROM part""",
    "relation_obs": """
  SELECT l_suppkey AS source, 'SUPPLIES' AS type, l_partkey AS target, 1 - l_discount AS confidence, l_returnflag = 'N' AS derived,
         l_orderkey AS message_id, concat(l_linestatus, l_returnflag) AS evidence, l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem""",
    "step": """
  SELECT event_id AS id, user_id AS trace_id, event_type AS tool_name, ts, value AS duration_ms,
         CASE WHEN event_type = 'error' THEN 'error' WHEN value < 1 THEN 'timeout' ELSE 'success' END AS status, props
  FROM events""",
    "preference": """
  SELECT event_id AS id, user_id, event_type AS category, value, ts AS valid_from,
         lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_until
  FROM events""",
    "edge": """
  SELECT 1000000 + c_custkey AS src, 3000000 + c_nationkey AS dst, 'LOCATED_AT' AS type FROM customer
  UNION ALL SELECT 2000000 + s_suppkey, 3000000 + s_nationkey, 'HEADQUARTERS_AT' FROM supplier
  UNION ALL SELECT 3000000 + n_nationkey, 4000000 + n_regionkey, 'PART_OF' FROM nation""",
    "place": """
  SELECT n_nationkey AS id, n_name AS name, -60 + (n_nationkey * 37 % 120)::DOUBLE AS latitude, -170 + (n_nationkey * 53 % 340)::DOUBLE AS longitude
  FROM nation""",
    "noted": """
  SELECT m.* REPLACE (m.content || CASE WHEN (m.conversation_id * 8 + m.turn) % 3 = 0 THEN '' ELSE
           ' Asked about ' || coalesce(p_name, '') || ' for ' || coalesce(c_name, '') || ' in ' || coalesce(n_name, '') || '.' END AS content)
  FROM message m LEFT JOIN part ON p_partkey = (m.conversation_id * 8 + m.turn) * 31 % 64
  LEFT JOIN customer ON c_custkey = (m.conversation_id * 8 + m.turn) * 17 % 100 LEFT JOIN nation ON n_nationkey = (m.conversation_id * 8 + m.turn) % 25""",
    "entity": """
  SELECT min(seq) AS id, name, type, min(subtype) AS subtype, CASE WHEN type = 'OBJECT' THEN [split_part(name, ' ', 2)] WHEN min(subtype) = 'REGION' THEN [name || ' area'] ELSE [] END AS aliases
  FROM entity_obs GROUP BY name, type""",
}


def with_sql(*names: str) -> str:
    """The views as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, conversation_id, session_id, user_identifier, turn, role, content, ts."""
    return as_messages(table(spark, sf_dir, "conversations"))


def as_messages(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("conversation_id"),
        F.concat(F.lit("s"), F.col("conv_id") % 25).alias("session_id"),
        F.concat(F.lit("u"), F.col("conv_id") % 10).alias("user_identifier"),
        "turn",
        "role",
        F.col("text").alias("content"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0)").alias("ts"),
    )


def entity_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq (order of arrival), name, type, subtype, description, confidence."""

    def one(name: str, base: int, key: str, label: str, kind: tuple[str, str], description, confidence) -> DataFrame:
        return table(spark, sf_dir, name).select(
            (F.lit(base) + F.col(key)).cast("long").alias("seq"), F.col(label).alias("name"), F.lit(kind[0]).alias("type"),
            F.lit(kind[1]).alias("subtype"), description.cast("string").alias("description"), confidence.cast("double").alias("confidence"),
        )

    none = F.lit(None)
    parts = [
        one("customer", 0, "c_custkey", "c_name", ("PERSON", "INDIVIDUAL"), F.col("c_mktsegment"), F.lit(0.9)),
        one("supplier", 10_000_000, "s_suppkey", "s_name", ("ORGANIZATION", "COMPANY"), none, F.lit(0.8)),
        one("nation", 20_000_000, "n_nationkey", "n_name", ("LOCATION", "COUNTRY"), none, F.lit(1.0)),
        one("region", 30_000_000, "r_regionkey", "r_name", ("LOCATION", "REGION"), none, F.lit(1.0)),
        one("part", 40_000_000, "p_partkey", "p_name", ("OBJECT", "PRODUCT"), F.col("p_brand"), F.lit(0.5) + (F.col("p_size") % 50).cast("double") / 100),
    ]
    return reduce(DataFrame.unionAll, parts)


#: The subtypes of observed entities, in order.
SUBTYPES = ("COMPANY", "COUNTRY", "INDIVIDUAL", "PRODUCT", "REGION")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, type, subtype, aliases: the observed entities, each (name, type) once. An object's second word is an alias that others share."""
    second = F.when(F.col("type") == "OBJECT", F.array(F.coalesce(F.get(F.split("name", " "), F.lit(1)), F.lit(""))))
    aliases = F.coalesce(second, F.when(F.col("subtype") == "REGION", F.array(F.concat("name", F.lit(" area")))), F.array().cast("array<string>"))
    known = F.array(*map(F.lit, SUBTYPES))  # numbers are folded in a hash table, strings by a sort
    place = F.min(F.array_position(known, F.col("subtype"))).alias("place")
    once = entity_observations(spark, sf_dir).groupBy("name", "type").agg(F.min("seq").alias("id"), place)
    return once.withColumn("subtype", F.get(known, F.col("place").cast("int") - 1)).select("id", "name", "type", "subtype", aliases.alias("aliases"))


def noted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which two in three end in a note that names a part, a customer and a nation."""
    m = messages(spark, sf_dir).withColumn("_k", F.col("conversation_id") * 8 + F.col("turn"))
    out = m
    for name, key, label, step, keys in (("part", "p_partkey", "p_name", 31, 64), ("customer", "c_custkey", "c_name", 17, 100), ("nation", "n_nationkey", "n_name", 1, 25)):
        named = table(spark, sf_dir, name).filter(F.col(key).between(1 - keys, keys - 1))  # no other key is met
        out = out.join(named.select(F.col(key).cast("long").alias("_key"), label), F.col("_k") * step % keys == F.col("_key"), "left").drop("_key")
    said = F.concat(F.lit(" Asked about "), F.coalesce("p_name", F.lit("")), F.lit(" for "), F.coalesce("c_name", F.lit("")), F.lit(" in "), F.coalesce("n_name", F.lit("")), F.lit("."))
    return out.withColumn("content", F.concat("content", F.when(F.col("_k") % 3 == 0, "").otherwise(said))).select(*[c for c in m.columns if c != "_k"])


def relation_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, type, target, confidence, derived, message_id, evidence, seq."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source"), F.lit("SUPPLIES").alias("type"), F.col("l_partkey").alias("target"),
        (1 - F.col("l_discount")).alias("confidence"), (F.col("l_returnflag") == "N").alias("derived"), F.col("l_orderkey").alias("message_id"),
        F.concat("l_linestatus", "l_returnflag").alias("evidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls as steps: id, trace_id, tool_name, ts, duration_ms, status, props."""
    return as_steps(table(spark, sf_dir, "events"))


def as_steps(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "error").when(F.col("value") < 1, "timeout").otherwise("success")
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("trace_id"), F.col("event_type").alias("tool_name"), "ts",
        F.col("value").alias("duration_ms"), status.alias("status"), "props",
    )


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, category, value, valid_from, valid_until (null while it holds)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("category"), "value", F.col("ts").alias("valid_from"),
        F.lead("ts").over(w).alias("valid_until"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed relations src, dst, type between customers, suppliers, nations and regions."""

    def one(name: str, a: int, source: str, b: int, target: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            (F.lit(a) + F.col(source)).cast("long").alias("src"), (F.lit(b) + F.col(target)).cast("long").alias("dst"), F.lit(kind).alias("type")
        )

    return (
        one("customer", 1_000_000, "c_custkey", 3_000_000, "c_nationkey", "LOCATED_AT")
        .unionAll(one("supplier", 2_000_000, "s_suppkey", 3_000_000, "s_nationkey", "HEADQUARTERS_AT"))
        .unionAll(one("nation", 3_000_000, "n_nationkey", 4_000_000, "n_regionkey", "PART_OF"))
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, latitude, longitude."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.lit(-60) + F.col("n_nationkey") * 37 % 120).cast("double").alias("latitude"),
        (F.lit(-170) + F.col("n_nationkey") * 53 % 340).cast("double").alias("longitude"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, v (components as doubles)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
