"""Queries of the reasoning layer with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import reasoning as re
from memloom.sources import views as v

S = v.with_sql("step")
FAILED = "('error', 'failure', 'timeout')"


def _customers(s, d):
    return v.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def _customer_name(number):
    return F.concat(F.lit("Customer#"), F.lpad((number + 1).cast("string"), 9, "0")).alias("name")


def _touched(s, d, part: int):
    steps = v.steps(s, d).select("id", _customer_name(F.col("id") % 1600))
    return re.touched(steps, _customers(s, d))[part]


def _known(s, d):
    """The edges to known entities; a stub's id is a hash, which the query's SQL does not state."""
    return _touched(s, d, 0).join(_customers(s, d).select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("step_id", "entity_id")


def _all_touched(s, d):
    """All edges, by name, over steps that name the whole customer table and 399 unknown ones; the id of known entities."""
    last = v.table(s, d, "customer").agg(F.max("c_custkey").alias("last"))
    steps = v.steps(s, d).crossJoin(F.broadcast(last)).select("id", _customer_name(F.col("id") % (F.col("last") + 400)))
    edges = re.touched(steps, _customers(s, d))[0]
    known = _customers(s, d).select(F.col("id").alias("entity_id"), F.col("id").alias("known_id"))
    return edges.join(known, "entity_id", "left").select("step_id", "name", "known_id")


QUERIES = {
    "RE-01_completed_traces": lambda s, d: re.completed(v.steps(s, d)),
    "RE-02_step_numbers": lambda s, d: re.numbered(v.steps(s, d)).select("id", "trace_id", "step_number"),
    "RE-05_tool_stats": lambda s, d: re.tool_stats(v.steps(s, d)),
    "RE-09_trace_with_steps": lambda s, d: re.with_steps(v.steps(s, d)).select(
        "trace_id", F.array_join(F.transform("steps", lambda x: F.concat_ws(":", x["step_number"], x["tool_name"], x["status"])), ",").alias("steps")
    ),
    "RE-10_list_traces": lambda s, d: re.traces(v.steps(s, d)).filter("not success and started_at >= timestamp'2024-01-01 03:00:00'").orderBy(F.desc("steps"), "trace_id").offset(3).limit(20),
    "RE-12_touched_entities": lambda s, d: _known(s, d),
    "RE-12_all_edges": _all_touched,
    "RE-12_stub_entities": lambda s, d: _touched(s, d, 1).select("name"),
    "RE-14_context_text": lambda s, d: re.numbered(v.steps(s, d)).filter("step_number <= 3").groupBy("trace_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_number", "tool_name"))), lambda x: x["tool_name"]), " > ").alias("context")
    ),
}
ORACLES = {
    "RE-01_completed_traces": f"{S} SELECT trace_id, min(ts) AS started_at, arg_max(status, (ts, id)) AS outcome FROM step GROUP BY trace_id",
    "RE-02_step_numbers": f"{S} SELECT id, trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY ts, id) AS INT) AS step_number FROM step",
    "RE-05_tool_stats": f"""{S} SELECT tool_name, count(*) AS total_calls, count(*) FILTER (status = 'success') AS successful_calls,
      count(*) FILTER (status IN {FAILED}) AS failed_calls, round(count(*) FILTER (status = 'success') / count(*), 6) AS success_rate,
      round(avg(duration_ms), 4) AS avg_duration_ms, max(ts) AS last_used_at FROM step GROUP BY tool_name""",
    "RE-09_trace_with_steps": f"""{S}, n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, id) AS k FROM step)
      SELECT trace_id, string_agg(concat_ws(':', k, tool_name, status), ',' ORDER BY k) AS steps FROM n GROUP BY trace_id""",
    "RE-10_list_traces": f"""{S}, t AS (SELECT trace_id, min(ts) AS started_at, max(ts) AS completed_at, count(*) AS steps,
      count(*) FILTER (status IN {FAILED}) = 0 AS success FROM step GROUP BY trace_id)
      SELECT * FROM t WHERE NOT success AND started_at >= TIMESTAMP '2024-01-01 03:00:00' ORDER BY steps DESC, trace_id LIMIT 20 OFFSET 3""",
    "RE-12_touched_entities": "SELECT DISTINCT event_id AS step_id, event_id % 1600 + 1 AS entity_id FROM events WHERE event_id % 1600 + 1 <= (SELECT max(c_custkey) FROM customer)",
    "RE-12_all_edges": """WITH n AS (SELECT event_id, 'Customer#' || lpad(CAST(event_id % ((SELECT max(c_custkey) FROM customer) + 400) + 1 AS VARCHAR), 9, '0') AS name FROM events)
      SELECT DISTINCT event_id AS step_id, name, c_custkey AS known_id FROM n LEFT JOIN customer ON c_name = name""",
    "RE-12_stub_entities": """SELECT DISTINCT 'Customer#' || lpad(CAST(event_id % 1600 + 1 AS VARCHAR), 9, '0') AS name FROM events
      WHERE event_id % 1600 + 1 > (SELECT max(c_custkey) FROM customer)""",
    "RE-14_context_text": f"""{S}, n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, id) AS k FROM step)
      SELECT trace_id, string_agg(tool_name, ' > ' ORDER BY k) AS context FROM n WHERE k <= 3 GROUP BY trace_id""",
}
