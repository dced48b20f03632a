"""Queries over merged entities, kind by kind, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import longterm as lt
from memloom.operators import merging as mg
from memloom.operators import provenance as pv
from memloom.sources import views as v
from memloom.sources.shared import cut


def _merges(s: SparkSession, d: str) -> DataFrame:
    """Part p with p % 10 = 3 is merged into p - 1, and p % 10 = 2 into p - 2: chains of two."""
    p = v.table(s, d, "part").select(F.col("p_partkey").alias("source")).filter("source % 10 in (2, 3)")
    return pv.final_targets(p.select("source", F.when(F.col("source") % 10 == 3, F.col("source") - 1).otherwise(F.col("source") - 2).alias("target")))


def _entities(s: SparkSession, d: str) -> DataFrame:
    return v.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"))


def _parts(s: SparkSession, d: str) -> int | None:
    return mg.parts_of(v.table(s, d, "lineitem"))


def _tables(s: SparkSession, d: str, parts: int | None) -> dict[str, DataFrame]:
    """Edges of every kind from order lines: parts are the entities, orders the messages, suppliers and other parts the neighbours.

    Few lines share a key, so large tables are dealt by key before they are folded.
    """
    line = v.table(s, d, "lineitem")
    part, order, number = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")

    def by(rows: DataFrame, **key: Column):
        return mg.dealt(rows.withColumns(key), parts, *key).groupBy(*key)

    said = by(line, entity_id=part, message_id=order).agg(F.max(1 - F.col("l_discount")).alias("confidence"), F.min(number).cast("int").alias("start_pos"))
    other = F.floor(part / 10) * 10 + number % 5
    return {
        "MENTIONS": said, "EXTRACTED_FROM": said.withColumn("end_pos", F.col("start_pos") + 5),
        "EXTRACTED_BY": line.groupBy(part.alias("entity_id"), F.concat("l_returnflag", "l_linestatus").alias("extractor")).agg(F.max(1 - F.col("l_tax")).alias("confidence")),
        "APPLIES_TO": mg.dealt(line.filter(number == 1).select(order.alias("preference_id"), part.alias("entity_id")), parts, "preference_id", "entity_id").distinct(),
        "TOUCHED": by(line.filter(number <= 3), step_id=order * 10 + number % 2, entity_id=part).agg(F.min("l_shipdate").alias("recorded_at")),
        "SAME_AS": by(line.filter(part != other), a=F.least(part, other), b=F.greatest(part, other)).agg(F.max(1 - F.col("l_discount")).alias("confidence")),
        "RELATED_TO": lt.fold_relations(line.select(
            part.alias("source"), F.col("l_returnflag").alias("type"), (F.floor(part / 10) * 10 + F.col("l_suppkey") % 10).cast("long").alias("target"),
            (1 - F.col("l_discount")).alias("confidence"), (F.col("l_linestatus") == "F").alias("derived"), order.alias("message_id"),
            F.concat("l_linestatus", number).alias("evidence"), (order * 10 + number).alias("seq"),
        ), parts),
    }


def _kind(name: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        parts = _parts(s, d)
        return mg.moved_edges(_tables(s, d, parts)[name], _merges(s, d), mg.CATALOGUE[name], parts)

    return run


def _related(s: SparkSession, d: str) -> DataFrame:
    return _kind("RELATED_TO")(s, d)


def _after(s: SparkSession, d: str) -> DataFrame:
    """What is left at merged ids, by kind, and the relations that a repeated merge would change."""
    merges, known, parts = _merges(s, d), _entities(s, d), _parts(s, d)
    entities, tables = mg.merge(known, _tables(s, d, parts), merges, parts)
    plain = {name: t.drop("migrated_from") for name, t in tables.items()}
    plain["RELATED_TO"] = cut(plain["RELATED_TO"])  # read four times below
    _, again = mg.merge(entities, {"RELATED_TO": plain["RELATED_TO"]}, merges, parts)
    changed = again["RELATED_TO"].drop("migrated_from").exceptAll(plain["RELATED_TO"]).agg(F.count("*").alias("n")).select(F.lit("changed by a repeated merge").alias("kind"), "n")
    return mg.dangling(plain, merges).unionAll(changed)


M = """WITH g AS (SELECT p_partkey AS source, p_partkey // 10 * 10 AS target FROM part WHERE p_partkey % 10 IN (2, 3)),
said AS (SELECT l_partkey AS entity_id, l_orderkey AS message_id, max(1 - l_discount) AS confidence, min(l_linenumber)::INT AS start_pos FROM lineitem GROUP BY 1, 2)"""


def _first(table: str, other: str, rest: str) -> str:
    """SQL of one entity column: the survivor's own row, else that of the least source."""
    cols = f", {rest}" if rest else ""
    return f"""SELECT coalesce(target, entity_id) AS entity_id, {other}{cols}, source AS migrated_from FROM {table} t LEFT JOIN g ON source = entity_id
      QUALIFY row_number() OVER (PARTITION BY coalesce(target, entity_id), {other} ORDER BY source NULLS FIRST) = 1"""


QUERIES = {
    "DD-05_merged_mentions": _kind("MENTIONS"),
    "DD-05_merged_extracted_from": _kind("EXTRACTED_FROM"),
    "DD-05_merged_extracted_by": _kind("EXTRACTED_BY"),
    "DD-05_merged_applies_to": _kind("APPLIES_TO"),
    "DD-05_merged_touched": _kind("TOUCHED"),
    "DD-05_merged_same_as": _kind("SAME_AS"),
    "DD-05_merged_related_to": lambda s, d: _related(s, d).drop("source_message_ids", "evidence"),
    "DD-05_merged_related_lists": lambda s, d: _related(s, d).select("source", "type", "target", "source_message_ids", "evidence"),
    "DD-05_merged_entities": lambda s, d: mg.merged_entities(_entities(s, d), _merges(s, d)),
    "HO-03_edges_at_merged_ids": _after,
}
RELATED = """, obs AS (SELECT l_partkey AS source, l_returnflag AS type, l_partkey // 10 * 10 + l_suppkey % 10 AS target, 1 - l_discount AS confidence,
    l_linestatus = 'F' AS derived, l_orderkey AS message_id, l_linestatus || l_linenumber AS evidence, l_orderkey * 10 + l_linenumber AS seq FROM lineitem
    WHERE l_partkey <> l_partkey // 10 * 10 + l_suppkey % 10),
  r AS (SELECT o.*, coalesce(g.target, o.source) AS s, coalesce(h.target, o.target) AS t, least(g.source, h.source) AS origin
    FROM obs o LEFT JOIN g ON g.source = o.source LEFT JOIN g h ON h.source = o.target)"""


def _lists(column: str, most: int) -> str:
    """SQL of the lists of a folded relation: the first of each old relation, then the first of those by origin."""
    return f"""{column}_1 AS (SELECT source, type, target, {column}, min(seq) AS seq FROM obs GROUP BY 1, 2, 3, 4),
  {column}_2 AS (SELECT *, row_number() OVER (PARTITION BY source, type, target ORDER BY seq, {column}) AS place FROM {column}_1 QUALIFY place <= {most}),
  {column}_l AS (SELECT source, type, target, list({column} ORDER BY place) AS l FROM {column}_2 GROUP BY 1, 2, 3),
  {column}_m AS (SELECT coalesce(g.target, l.source) AS s, l.type, coalesce(h.target, l.target) AS t, least(g.source, h.source) AS origin, l
    FROM {column}_l l LEFT JOIN g ON g.source = l.source LEFT JOIN g h ON h.source = l.target),
  {column}_n AS (SELECT s, type, t, flatten(list(l ORDER BY origin NULLS FIRST, l)) AS l FROM {column}_m WHERE s <> t GROUP BY 1, 2, 3),
  {column}_f AS (SELECT s, type, t, list_filter(l, lambda x, i: list_position(l, x) = i)[:{most}] AS l FROM {column}_n)"""


ORACLES = {
    "DD-05_merged_mentions": M + _first("said", "message_id", "confidence, start_pos"),
    "DD-05_merged_extracted_from": M + _first("(SELECT *, start_pos + 5 AS end_pos FROM said)", "message_id", "confidence, start_pos, end_pos"),
    "DD-05_merged_extracted_by": M + _first("(SELECT l_partkey AS entity_id, l_returnflag || l_linestatus AS extractor, max(1 - l_tax) AS confidence FROM lineitem GROUP BY 1, 2)", "extractor", "confidence"),
    "DD-05_merged_applies_to": M + _first("(SELECT DISTINCT l_orderkey AS preference_id, l_partkey AS entity_id FROM lineitem WHERE l_linenumber = 1)", "preference_id", ""),
    "DD-05_merged_touched": M + _first("(SELECT l_orderkey * 10 + l_linenumber % 2 AS step_id, l_partkey AS entity_id, min(l_shipdate) AS recorded_at FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2)",
      "step_id", "recorded_at"),
    "DD-05_merged_same_as": M + """, e AS (SELECT least(l_partkey, o) AS a, greatest(l_partkey, o) AS b, max(1 - l_discount) AS confidence
      FROM (SELECT *, l_partkey // 10 * 10 + l_linenumber % 5 AS o FROM lineitem) WHERE l_partkey <> o GROUP BY 1, 2),
      x AS (SELECT coalesce(g.target, a) AS p, coalesce(h.target, b) AS q, confidence, least(g.source, h.source) AS migrated_from FROM e LEFT JOIN g ON g.source = a LEFT JOIN g h ON h.source = b)
      SELECT least(p, q) AS a, greatest(p, q) AS b, confidence, migrated_from FROM x WHERE p <> q
      QUALIFY row_number() OVER (PARTITION BY least(p, q), greatest(p, q) ORDER BY migrated_from NULLS FIRST, confidence) = 1""",
    "DD-05_merged_related_to": M + RELATED + """ SELECT s AS source, type, t AS target, max(confidence) AS confidence, count(*) AS support, bool_and(derived) AS derived,
      CASE WHEN count(*) FILTER (origin IS NULL) = 0 THEN min(origin) END AS migrated_from FROM r WHERE s <> t GROUP BY 1, 2, 3""",
    "DD-05_merged_related_lists": M + RELATED + f""", {_lists('message_id', 25)}, {_lists('evidence', 3)}
      SELECT m.s AS source, m.type, m.t AS target, m.l AS source_message_ids, e.l AS evidence FROM message_id_f m JOIN evidence_f e ON e.s = m.s AND e.type = m.type AND e.t = m.t""",
    "DD-05_merged_entities": M + """, n AS (SELECT target AS id, list_distinct(flatten(list([p_name, p_brand]))) AS more FROM g JOIN part ON p_partkey = source GROUP BY target)
      SELECT p_partkey AS id, p_name AS name, target AS merged_into,
        CASE WHEN target IS NULL THEN list_sort(list_distinct(list_append(list_filter(coalesce(more, []), lambda x: x <> p_name), p_brand))) ELSE [p_brand] END AS aliases
      FROM part LEFT JOIN g ON source = p_partkey LEFT JOIN n ON n.id = p_partkey""",
    "HO-03_edges_at_merged_ids": "SELECT unnest(['MENTIONS', 'EXTRACTED_FROM', 'EXTRACTED_BY', 'APPLIES_TO', 'TOUCHED', 'SAME_AS', 'RELATED_TO', 'changed by a repeated merge']) AS kind, 0::BIGINT AS n",
}
