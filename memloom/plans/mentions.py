"""Queries over the mentions of entities in messages, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import mentions as mn
from memloom.sources import views as v
from memloom.sources.shared import cut

#: The views, and what the queries share in SQL: surface forms, words with places, spans by the leftmost longest rule, links.
BASE = (
    v.with_sql("message", "entity_obs", "noted", "entity").replace("WITH ", "WITH RECURSIVE ", 1)
    + r""",
f AS (SELECT DISTINCT lower(form) AS form, id AS entity_id, type FROM (SELECT id, type, unnest(list_append(aliases, name)) AS form FROM entity) WHERE form <> ''),
pieces AS (SELECT id, unnest(p) AS w, unnest(range(1, len(p) + 1)) AS k FROM (SELECT id, regexp_extract_all(content, '[\pL\pN_#]+|[^\pL\pN_#]+') AS p FROM noted)),
words AS (
  SELECT id, w, k, coalesce(sum(length(w)) OVER o, 0)::INT AS start, lead(w, 1) OVER (PARTITION BY id ORDER BY k) AS gap, lead(w, 2) OVER (PARTITION BY id ORDER BY k) AS w2
  FROM pieces WINDOW o AS (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
phrases AS (
  SELECT id, start, start + length(w) AS "end", lower(w) AS form FROM words
  UNION ALL SELECT id, start, start + length(w) + length(gap) + length(w2), lower(w) || ' ' || lower(w2) FROM words WHERE regexp_full_match(gap, '\s+')),
b AS (SELECT id, start, max("end") AS "end", arg_max(form, "end") AS form FROM phrases WHERE form IN (SELECT form FROM f) GROUP BY id, start),
nx AS (SELECT a.id, a.start, min(c.start) AS next FROM b a JOIN b c ON c.id = a.id AND c.start >= a."end" GROUP BY a.id, a.start),
kept AS (SELECT id, min(start) AS start FROM b GROUP BY id UNION ALL SELECT k.id, n.next FROM kept k JOIN nx n ON n.id = k.id AND n.start = k.start),
span AS (SELECT b.id AS message_id, b.start, b."end"::INT AS "end", b.form FROM b JOIN kept USING (id, start)),
one AS (SELECT form, min(entity_id) AS entity_id, min(type) AS type FROM f GROUP BY form HAVING count(DISTINCT entity_id) = 1),
mention AS (SELECT message_id, entity_id, type, start, "end" FROM span JOIN one USING (form)),
edge AS (SELECT DISTINCT message_id, entity_id FROM mention) """
)


def _mentions(s: SparkSession, d: str) -> DataFrame:
    return mn.mentions(v.noted_messages(s, d), v.entities(s, d))


def _refs(s: SparkSession, d: str) -> DataFrame:
    """Of each event by its id: an entity's id, a typed name, a name that is one's own or shared, a name that nobody has."""
    k = F.col("event_id") % 4
    e = v.table(s, d, "events")
    nation = F.concat(F.lit("Nation_"), F.col("event_id") % 40)
    region = F.element_at(F.array(*map(F.lit, ("Africa", "America", "Asia", "Europe", "Middle  East", "Nowhere"))), (F.col("event_id") / 8).cast("int") % 6 + 1)
    free = F.when(F.col("event_id") % 8 == 2, F.concat(region, F.lit(" AREA"))).otherwise(F.lit("ring"))
    return e.select(
        F.col("event_id").alias("id"), F.when(k == 0, 20_000_000 + F.col("event_id") % 30).alias("entity_id"),
        F.when(k == 1, nation).when(k == 2, free).when(k == 3, F.concat(F.lit("Thing "), F.col("event_id") % 50)).alias("name"),
        F.when(k == 1, "LOCATION").alias("type"),
    )


REFS = """, ref AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 20000000 + event_id % 30 END AS ref,
  CASE event_id % 4 WHEN 1 THEN 'nation_' || (event_id % 40) WHEN 2 THEN CASE WHEN event_id % 8 = 2 THEN ['africa', 'america', 'asia', 'europe', 'middle east', 'nowhere'][event_id // 8 % 6 + 1] || ' area' ELSE 'ring' END
    WHEN 3 THEN 'thing ' || (event_id % 50) END AS form, CASE WHEN event_id % 4 = 1 THEN 'LOCATION' END AS kind FROM events),
explicit AS (
  SELECT ref.id, ref AS entity_id, 'id' AS how FROM ref JOIN entity e ON e.id = ref
  UNION ALL SELECT ref.id, min(f.entity_id), 'typed' FROM ref JOIN f ON f.form = ref.form AND f.type = kind WHERE ref IS NULL GROUP BY ref.id
  UNION ALL SELECT ref.id, one.entity_id, 'surface' FROM ref JOIN one USING (form) WHERE ref IS NULL AND kind IS NULL) """


def _applied(s: SparkSession, d: str) -> DataFrame:
    known = v.entities(s, d)
    edges, stubs = mn.applies_to(_refs(s, d), known)
    named = known.select("id", "name", "type").unionAll(stubs).withColumnRenamed("id", "entity_id")
    return edges.join(named, "entity_id").select("preference_id", "name", "type", "how")


def _steps(s: SparkSession, d: str) -> DataFrame:
    return v.table(s, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("trace_id"), (F.col("user_id") % 100).alias("conversation_id"), (F.col("event_id") % 9).alias("turn")
    )


def _preferences(s: SparkSession, d: str) -> DataFrame:
    return v.preferences(s, d).select(F.concat(F.lit("u"), F.col("user_id") % 10).alias("user_identifier"), "category", "valid_from")


def _context(s: SparkSession, d: str) -> DataFrame:
    m = v.noted_messages(s, d)
    since = F.expr("timestamp'2024-01-28 00:00:00'")
    return mn.session_context(m, _mentions(s, d), v.entities(s, d), _preferences(s, d), 5, since)


def _sql(rest: str) -> str:
    return BASE + rest


def _with(df_of):
    """A query of messages and the mentions in them, which are found once."""

    def run(s: SparkSession, d: str) -> DataFrame:
        return df_of(s, d, cut(_mentions(s, d)))

    return run


QUERIES = {
    "ST-22_mention_spans": lambda s, d: mn.spans(v.noted_messages(s, d), v.entities(s, d)),
    "ST-22_mention_spans_by_joins": lambda s, d: mn.spans(v.noted_messages(s, d), v.entities(s, d), sent_chars=0),
    "ST-22_mentions": lambda s, d: _mentions(s, d).drop("confidence"),
    "ST-22_explicit_mentions": lambda s, d: mn.explicit(_refs(s, d).withColumnRenamed("id", "message_id"), v.entities(s, d)),
    "ST-15_messages_to_extract": _with(lambda s, d, m: mn.without(v.noted_messages(s, d), m).select("id", "session_id", "ts")),
    "ST-17_session_entities": _with(lambda s, d, m: mn.key_entities(m, v.entities(s, d), v.noted_messages(s, d))),
    "ST-20_session_context": _context,
    "ST-25_extraction_stats": _with(lambda s, d, m: mn.extraction_stats(v.noted_messages(s, d), m)),
    "GEO-04_locations": _with(lambda s, d, m: mn.locations(m, v.entities(s, d), v.noted_messages(s, d)).drop("entity_id")),
    "LT-21_applies_to": _applied,
    "LT-21_stub_entities": lambda s, d: mn.applies_to(_refs(s, d), v.entities(s, d))[1].select("name", "type"),
    "RE-11_reasoning_links": lambda s, d: mn.reasoning_links(v.messages(s, d), _steps(s, d)),
}
_SPANS = _sql('SELECT message_id, start, "end", form FROM span')
ORACLES = {
    "ST-22_mention_spans": _SPANS,
    "ST-22_mention_spans_by_joins": _SPANS,
    "ST-22_mentions": _sql('SELECT message_id, entity_id, type, start, "end" FROM mention'),
    "ST-22_explicit_mentions": BASE + REFS + "SELECT id AS message_id, entity_id, how FROM explicit",
    "ST-15_messages_to_extract": _sql("SELECT id, session_id, ts FROM noted WHERE id NOT IN (SELECT message_id FROM edge)"),
    "ST-17_session_entities": _sql("""SELECT session_id, name, type, count(*) AS mentions FROM edge JOIN noted m ON m.id = message_id JOIN entity e ON e.id = entity_id GROUP BY 1, 2, 3
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY mentions DESC, name, type) <= 10"""),
    "ST-20_session_context": BASE + f""", {v.with_sql('preference').removeprefix('WITH ')},
      r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS place FROM noted QUALIFY place <= 5),
      n AS (SELECT session_id, list_sort(list(DISTINCT name)) AS names FROM r JOIN edge ON message_id = r.id JOIN entity e ON e.id = entity_id GROUP BY session_id),
      p AS (SELECT session_id, list_sort(list(DISTINCT category)) AS liked FROM r JOIN preference q ON user_identifier = 'u' || (q.user_id % 10)
        WHERE valid_from >= TIMESTAMP '2024-01-28' GROUP BY session_id)
      SELECT session_id, list(id ORDER BY place) AS messages, coalesce(any_value(names), []) AS entities, coalesce(any_value(liked), []) AS preferences
      FROM r LEFT JOIN n USING (session_id) LEFT JOIN p USING (session_id) GROUP BY session_id""",
    "ST-25_extraction_stats": _sql("""SELECT session_id, count(DISTINCT m.id) AS messages, count(DISTINCT CASE WHEN length(content) > 0 THEN m.id END) AS processed,
      count(DISTINCT entity_id) AS entities, count(entity_id) AS links FROM noted m LEFT JOIN edge ON message_id = m.id GROUP BY session_id"""),
    "GEO-04_locations": _sql("""SELECT name, subtype, coalesce(list(conversation_id ORDER BY first) FILTER (conversation_id IS NOT NULL), []) AS conversations
      FROM entity e LEFT JOIN (SELECT entity_id, conversation_id, min(message_id) AS first FROM edge JOIN noted m ON m.id = message_id GROUP BY 1, 2) x ON x.entity_id = e.id
      WHERE type = 'LOCATION' GROUP BY name, subtype"""),
    "LT-21_applies_to": BASE + REFS + """SELECT x.id AS preference_id, name, type, how FROM explicit x JOIN entity e ON e.id = entity_id
      UNION ALL SELECT id, form, coalesce(kind, 'OBJECT'), 'stub' FROM ref WHERE form IS NOT NULL AND id NOT IN (SELECT id FROM explicit)""",
    "LT-21_stub_entities": BASE + REFS + "SELECT DISTINCT form AS name, coalesce(kind, 'OBJECT') AS type FROM ref WHERE form IS NOT NULL AND id NOT IN (SELECT id FROM explicit)",
    "RE-11_reasoning_links": v.with_sql("message") + """, s AS (SELECT event_id AS id, user_id AS trace_id, user_id % 100 AS conversation_id, event_id % 9 AS turn FROM events),
      t AS (SELECT trace_id, min(conversation_id) AS conversation_id, arg_min(turn, id) AS turn FROM s GROUP BY trace_id)
      SELECT 'HAS_TRACE' AS kind, conversation_id AS source, trace_id AS target FROM t
      UNION ALL SELECT 'INITIATED_BY', trace_id, arg_max(m.id, m.turn) FROM t JOIN message m ON m.conversation_id = t.conversation_id AND m.turn <= t.turn GROUP BY trace_id
      UNION ALL SELECT 'TRIGGERED_BY', s.id, arg_max(m.id, m.turn) FROM s JOIN message m ON m.conversation_id = s.conversation_id AND m.turn <= s.turn GROUP BY s.id""",
}
