"""Queries of extraction results, ontologies and observations with their SQL oracles.

The extractors' results are the words of the conversations, some replaced by
names that are not valid; each turn's stage is its number modulo 3.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import extraction as ex
from memloom.operators import observations as ob
from memloom.operators import ontology as on
from memloom.operators import reasoning as re
from memloom.operators import resolution as rs
from memloom.plans import resolution
from memloom.sources import views as v

TYPES = ((0, "Customer", "PERSON", "INDIVIDUAL"), (1, "Person", "PERSON", None), (2, "Company", "ORGANIZATION", "COMPANY"), (3, "Project", "OBJECT", "PROJECT"), (4, "Vendor", "ORGANIZATION", "VENDOR"))
LATER = ((0, "customer", "PERSON", "INDIVIDUAL"), (1, "Person", "PERSON", "AGENT"), (2, "Company", "ORGANIZATION", "COMPANY"), (3, "Project", "EVENT", None), (4, "Site", "LOCATION", None))
LINKS = (("Person", "works at", "Company"), ("Customer", "KNOWS", "Person"), ("Company", "Near By", "Company"))
ENDS, VERBS = ("Person", "customer", "COMPANY"), ("WORKS AT", "knows", "near by")
FLOOR = 0.4


def _types(s, rows=TYPES):
    return s.createDataFrame(rows, "place int, label string, pole_type string, subtype string")


def _links(s):
    return s.createDataFrame(LINKS, "source string, type string, target string")


def _words(s, d):
    words = F.split("text", " ")
    t = v.table(s, d, "conversations").select(F.col("conv_id").alias("doc"), "turn", words.alias("ws"))
    return t.select("doc", "turn", "ws", F.posexplode("ws").alias("i", "w")).withColumn("pos", F.col("turn") * 1_000_000 + F.col("i"))


def _entities(s, d):
    i = F.col("i")
    name = F.when(i % 9 == 0, "The").when(i % 9 == 1, "12.5%").when(i % 9 == 2, "--").when(i % 9 == 3, "The Projects").otherwise(F.col("w"))
    kind = F.when(i % 9 == 3, "Project").when(i % 2 == 0, "PERSON").otherwise("ORGANIZATION")
    sub = F.when(i % 4 == 0, "Individual").when(i % 4 == 1, "COMPANY").when(i % 4 == 2, "ALIAS")
    sure = ((i * 7 + F.col("turn") * 13) % 100).cast("double") / 100
    return _words(s, d).select("doc", (F.col("turn") % 3).alias("stage"), "pos", name.alias("name"), kind.alias("type"), sub.alias("subtype"), sure.alias("confidence"))


def _relations(s, d):
    i = F.col("i")
    verb = F.when(i % 3 == 0, "works at").when(i % 3 == 1, "KNOWS").otherwise("near-by")
    sure = ((i * 11 + F.col("turn") * 5) % 100).cast("double") / 100
    rows = _words(s, d).filter(i + 1 < F.size("ws"))
    return rows.select("doc", "pos", F.col("w").alias("source"), verb.alias("type"), F.element_at("ws", i + 2).alias("target"), sure.alias("confidence"))


def _stating(s, d):
    more = F.when(F.col("id") % 4 == 0, " I decided to order it. Later.").when(F.col("id") % 4 == 1, " Actually, it turns out fine! We should wait").otherwise("")
    return v.messages(s, d).select("id", F.concat("content", more).alias("content"))


def _triples(s, d):
    def one(values, by):
        return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % 3 + 1).cast("int"))

    return v.table(s, d, "lineitem").select(one(ENDS, "l_linenumber").alias("source"), one(VERBS, "l_orderkey").alias("type"), one(ENDS, "l_partkey").alias("target"))


def _merged(strategy):
    return lambda s, d: ex.merged(_entities(s, d), strategy).withColumn("confidence", F.round("confidence", 6))


def _counted(s, d):
    """Counters of the calls before an id, then raised by the others."""
    calls = v.steps(s, d)
    return re.raised_counters(re.tool_counters(calls.filter("id % 2 = 0")), calls.filter("id % 2 = 1"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


SQL = f"""WITH words AS (SELECT conv_id AS doc, turn, string_split(text, ' ') AS ws, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM conversations),
  entities AS (SELECT doc, turn % 3 AS stage, turn * 1000000 + i AS pos, CASE i % 9 WHEN 0 THEN 'The' WHEN 1 THEN '12.5%' WHEN 2 THEN '--' WHEN 3 THEN 'The Projects' ELSE w END AS name,
    CASE WHEN i % 9 = 3 THEN 'Project' WHEN i % 2 = 0 THEN 'PERSON' ELSE 'ORGANIZATION' END AS type,
    CASE i % 4 WHEN 0 THEN 'Individual' WHEN 1 THEN 'COMPANY' WHEN 2 THEN 'ALIAS' END AS subtype, ((i * 7 + turn * 13) % 100)::DOUBLE / 100 AS confidence FROM words),
  relations AS (SELECT doc, turn * 1000000 + i AS pos, w AS source, CASE i % 3 WHEN 0 THEN 'works at' WHEN 1 THEN 'KNOWS' ELSE 'near-by' END AS type, ws[i + 2] AS target,
    ((i * 11 + turn * 5) % 100)::DOUBLE / 100 AS confidence FROM words WHERE i + 1 < len(ws)),
  keyed AS (SELECT *, lower(regexp_replace(name, '^\\s+|\\s+$', '', 'g')) AS key FROM entities),
  ends AS (SELECT *, lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS sk, lower(regexp_replace(target, '^\\s+|\\s+$', '', 'g')) AS tk FROM relations),
  valid AS (SELECT *, length(key) >= 2 AND key NOT IN ({', '.join(f"'{w}'" for w in ex.STOP_WORDS)}) AND NOT regexp_matches(key, '^[\\d\\s.,%-]+$')
    AND NOT regexp_matches(key, '^[^\\pL\\pN_]+$') AS valid FROM keyed),
  types AS (SELECT * FROM (VALUES {_values(TYPES)}) t(place, label, pole_type, subtype)), links AS (SELECT * FROM (VALUES {_values(LINKS)}) t(source, type, target)),
  pairs AS (SELECT DISTINCT type, subtype FROM entities),
  labels AS (SELECT type, subtype, coalesce(
      (SELECT min_by(t.label, t.place) FROM types t WHERE t.pole_type = upper(p.type) AND t.subtype IS NOT DISTINCT FROM upper(p.subtype)),
      (SELECT min_by(t.label, t.place) FROM types t WHERE t.pole_type = upper(p.type) AND t.subtype IS NULL),
      (SELECT min_by(t.label, t.place) FROM types t WHERE t.pole_type = upper(p.type) AND p.subtype IS NULL),
      (SELECT min_by(t.label, t.place) FROM types t WHERE upper(t.label) = upper(p.type) AND (p.subtype IS NULL OR t.subtype = upper(p.subtype)))) AS label FROM pairs p),
  labelled AS (SELECT k.*, l.label FROM keyed k JOIN labels l ON k.type = l.type AND k.subtype IS NOT DISTINCT FROM l.subtype)"""
_BY = "PARTITION BY doc, key, type ORDER BY"
_ROW = "SELECT doc, key, type, stage, pos, round(confidence, 6) AS confidence"
_LATER = f"later AS (SELECT * FROM (VALUES {_values(LATER)}) t(place, label, pole_type, subtype))"
_UNION = f"{SQL} {_ROW} FROM (SELECT *, row_number() OVER ({_BY} confidence DESC, stage, pos) AS r FROM keyed) WHERE r = 1"
_COUNTERS = """SELECT tool_name, count(*) AS total_calls, count(*) FILTER (status = 'success') AS successful_calls,
    count(*) FILTER (status IN ('error', 'failure', 'timeout')) AS failed_calls, round(sum(duration_ms), 4) AS total_duration_ms FROM step GROUP BY tool_name"""

QUERIES = {
    "EX-01_valid_names": lambda s, d: _entities(s, d).select("doc", "pos", ex.valid_name(F.col("name")).alias("valid")),
    "EX-02_type_name_mentions": lambda s, d: _entities(s, d).filter(ex.names_its_type(F.col("name"), F.col("type"), F.col("subtype"))).select("doc", "pos", "name"),
    "EX-03_relations_of_valid_entities": lambda s, d: ex.without_invalid(_entities(s, d), _relations(s, d))[1].select("doc", "pos"),
    "EX-04_judged_relations": lambda s, d: ex.judged_relations(_relations(s, d), on.labelled(_entities(s, d), _types(s)), _links(s)).select("doc", "pos", "permitted"),
    **{f"EX-05_{k}": _merged(k) for k in ("union", "intersection", "cascade", "first_success")},
    "EX-07_relations_above_floor": lambda s, d: ex.above_floor(_entities(s, d), _relations(s, d), FLOOR)[1].select("doc", "pos"),
    "EX-12_distinct_entities": _merged("confidence"),
    "EX-12_distinct_relations": lambda s, d: ex.distinct_relations(_relations(s, d)),
    "EX-17_declared_entities": lambda s, d: on.labelled(_entities(s, d), _types(s)).filter("label is not null").select("doc", "pos", "label"),
    "ON-01_labels": lambda s, d: on.labelled(_entities(s, d).select("type", "subtype").distinct(), _types(s)),
    "ON-02_permitted": lambda s, d: on.permitted(_triples(s, d), _links(s)).groupBy("source", "type", "target").agg(F.count("*").alias("n")),
    "ON-04_content_keys": lambda s, d: on.content_key(v.table(s, d, "nation"), ["n_regionkey"], ["n_name", "n_nationkey"]),
    "ON-05_type_differences": lambda s, d: on.differences(_types(s), _types(s, LATER), ["label"], ["pole_type", "subtype"]),
    "MT-03_averages": lambda s, d: ex.averages(rs.matched(resolution._items(s, d, "l_partkey"), resolution._items(s, d, "l_suppkey"), ["type", "item"])),
    "TX-02_observations": lambda s, d: ob.observations(_stating(s, d)),
    "RE-03_raised_counters": lambda s, d: _counted(s, d).withColumn("total_duration_ms", F.round("total_duration_ms", 4)),
    "RE-04_tool_stats_of_counters": lambda s, d: re.stats_of_counters(_counted(s, d)),
    "RE-06_rebuilt_counters": lambda s, d: re.tool_counters(v.steps(s, d)).withColumn("total_duration_ms", F.round("total_duration_ms", 4)),
}
ORACLES = {
    "EX-01_valid_names": f"{SQL} SELECT doc, pos, valid FROM valid",
    "EX-02_type_name_mentions": f"""{SQL}, n AS (SELECT *, regexp_replace(key, '^((a|an|the|my|your|our|their|his|her|its|this|that|these|those|any|all|some|each|every|new|open) )+', '') AS bare FROM keyed)
      SELECT doc, pos, name FROM n WHERE bare IN (lower(type), lower(type) || 's', lower(type) || 'es', lower(subtype), lower(subtype) || 's', lower(subtype) || 'es',
        CASE WHEN lower(subtype) LIKE '%y' THEN regexp_replace(lower(subtype), 'y$', 'ies') ELSE lower(type) END)""",
    "EX-03_relations_of_valid_entities": f"""{SQL} SELECT doc, pos FROM ends e WHERE EXISTS (SELECT 1 FROM valid n WHERE n.valid AND n.doc = e.doc AND n.key = e.sk)
      AND EXISTS (SELECT 1 FROM valid n WHERE n.valid AND n.doc = e.doc AND n.key = e.tk)""",
    "EX-04_judged_relations": f"""{SQL}, f AS (SELECT doc, key, arg_min_null(label, stage * 1000000000 + pos) AS label FROM labelled GROUP BY doc, key)
      SELECT e.doc, e.pos, coalesce(EXISTS (SELECT 1 FROM links l WHERE lower(l.source) = lower(a.label) AND lower(l.target) = lower(b.label)
        AND replace(lower(l.type), ' ', '_') = replace(replace(lower(e.type), ' ', '_'), '-', '_')), false) AS permitted
      FROM ends e LEFT JOIN f a ON a.doc = e.doc AND a.key = e.sk LEFT JOIN f b ON b.doc = e.doc AND b.key = e.tk""",
    "EX-05_union": _UNION,
    "EX-05_intersection": f"""{SQL} SELECT doc, key, type, stage, pos, round(least(1.0, confidence * 1.1), 6) AS confidence
      FROM (SELECT *, row_number() OVER ({_BY} confidence DESC, stage, pos) AS r, count(*) OVER (PARTITION BY doc, key, type) AS n FROM keyed) WHERE r = 1 AND n > 1""",
    "EX-05_cascade": f"{SQL} {_ROW} FROM (SELECT *, row_number() OVER ({_BY} stage, CASE WHEN stage = 0 THEN -pos ELSE pos END) AS r FROM keyed) WHERE r = 1",
    "EX-05_first_success": f"{SQL} {_ROW} FROM keyed k WHERE stage = (SELECT min(stage) FROM keyed x WHERE x.doc = k.doc)",
    "EX-07_relations_above_floor": f"""{SQL} SELECT doc, pos FROM ends e WHERE confidence >= {FLOOR} AND EXISTS (SELECT 1 FROM keyed n WHERE n.confidence >= {FLOOR} AND n.doc = e.doc AND n.key = e.sk)
      AND EXISTS (SELECT 1 FROM keyed n WHERE n.confidence >= {FLOOR} AND n.doc = e.doc AND n.key = e.tk)""",
    "EX-12_distinct_entities": _UNION,
    "EX-12_distinct_relations": f"""{SQL} SELECT doc, pos, source, type, target, confidence
      FROM (SELECT *, row_number() OVER (PARTITION BY doc, lower(source), type, lower(target) ORDER BY confidence DESC, pos) AS r FROM relations) WHERE r = 1""",
    "EX-17_declared_entities": f"{SQL} SELECT doc, pos, label FROM labelled WHERE label IS NOT NULL",
    "ON-01_labels": f"{SQL} SELECT * FROM labels",
    "ON-02_permitted": f"""WITH t AS (SELECT {list(ENDS)}[l_linenumber % 3 + 1] AS source, {list(VERBS)}[l_orderkey % 3 + 1] AS type, {list(ENDS)}[l_partkey % 3 + 1] AS target FROM lineitem),
      links AS (SELECT * FROM (VALUES {_values(LINKS)}) t(source, type, target))
      SELECT source, type, target, count(*) AS n FROM t WHERE (lower(source), lower(type), lower(target)) IN (SELECT (lower(source), lower(type), lower(target)) FROM links) GROUP BY ALL""",
    "ON-04_content_keys": """WITH r AS (SELECT n_regionkey, sha256(CAST(to_json(struct_pack(n_name := n_name, n_nationkey := n_nationkey)) AS VARCHAR)) AS h FROM nation)
      SELECT n_regionkey, sha256(string_agg(h, ',' ORDER BY h)) AS content_key FROM r GROUP BY 1""",
    "ON-05_type_differences": f"""{SQL}, {_LATER}, b AS (SELECT lower(coalesce(a.label, z.label)) AS label, a.label IS NULL AS added, z.label IS NULL AS removed,
        concat_ws(',', CASE WHEN a.pole_type IS DISTINCT FROM z.pole_type THEN 'pole_type' END, CASE WHEN a.subtype IS DISTINCT FROM z.subtype THEN 'subtype' END) AS fields
        FROM types a FULL JOIN later z ON lower(a.label) = lower(z.label))
      SELECT label, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' ELSE 'modified' END AS change, CASE WHEN added OR removed THEN '' ELSE fields END AS fields
      FROM b WHERE added OR removed OR fields <> ''""",
    "MT-03_averages": f"""WITH m AS ({resolution.ORACLES['MT-01_entity_scores']}), s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn,
        avg(tp / (tp + fp)) AS mp, avg(tp / (tp + fn)) AS mr, avg(2 * tp / (2 * tp + fp + fn)) AS mf FROM m)
      SELECT round(tp / (tp + fp), 6) AS micro_precision, round(tp / (tp + fn), 6) AS micro_recall, round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1,
        round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1 FROM s""",
    "TX-02_observations": f"""{v.with_sql('message')}, m AS (SELECT id, content || CASE id % 4 WHEN 0 THEN ' I decided to order it. Later.' WHEN 1 THEN ' Actually, it turns out fine! We should wait' ELSE '' END AS content FROM message),
      h AS (SELECT id, content, unnest([{{'kind': 'decision', 'confidence': 0.75::DOUBLE, 'markers': {list(x for x in ob.DECISIONS if "'" not in x)}}},
        {{'kind': 'fact', 'confidence': 0.7::DOUBLE, 'markers': {list(ob.FACTS)}}}]) AS o FROM m),
      f AS (SELECT *, list_filter(o.markers, lambda k: contains(lower(content), k))[1] AS k FROM h),
      p AS (SELECT *, strpos(lower(content), k) AS place FROM f WHERE k IS NOT NULL),
      w AS (SELECT id, o.kind AS kind, o.confidence AS confidence, regexp_replace(regexp_extract(substr(content, 1, place - 1), '[^.!?\\n]*$') || substr(content, place, length(k))
        || regexp_extract(substr(content, place + length(k)), '^[^.!?\\n]*[.!?\\n]?'), '^\\s+|\\s+$', '', 'g') AS said FROM p)
      SELECT id, kind, CASE WHEN length(said) > 300 THEN regexp_replace(substr(said, 1, 300), ' [^ ]*$', '') || '...' ELSE said END AS content, confidence FROM w WHERE length(said) > 10""",
    "RE-03_raised_counters": f"{v.with_sql('step')} {_COUNTERS}",
    "RE-04_tool_stats_of_counters": f"""{v.with_sql('step')} SELECT tool_name, count(*) AS total_calls, round(count(*) FILTER (status = 'success') / count(*), 6) AS success_rate,
      round(sum(duration_ms) / count(*), 4) AS avg_duration_ms FROM step GROUP BY tool_name""",
    "RE-06_rebuilt_counters": f"{v.with_sql('step')} {_COUNTERS}",
}
