"""Streaming queries with the SQL of their final results."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.plans import shortterm
from memloom.sources import views as v
from memloom.streaming import memory as m


def _calls(s, d):
    return v.as_steps(m.read_stream(s, d, "events"))


QUERIES = {
    "SS-01_monotone_stream": lambda s, d: m.stored(
        m.monotone_times(v.as_messages(m.read_stream(s, d, "conversations")).withColumn("ts", F.expr("ts - make_dt_interval(0, 0, cast(3 * (id % 4) as int), 0)"))), "monotone"
    ).select("id", "conversation_id", "ts"),
    "SS-02_tool_counters": lambda s, d: m.latest(m.stored(m.tool_counters(_calls(s, d)), "counters", "update"), ["tool_name"]),
    "SS-02_daily_counts": lambda s, d: m.latest(m.stored(m.windowed_counts(_calls(s, d)), "daily", "update"), ["day", "tool_name"]),
    "IO-05_buffered_writes": lambda s, d: m.stored(v.as_messages(m.read_stream(s, d, "conversations")).select("id", "role"), "messages"),
}
ORACLES = {
    "SS-01_monotone_stream": shortterm.ORACLES["ST-04_monotone_append"],
    "SS-02_tool_counters": f"""{v.with_sql('step')} SELECT tool_name, count(*) AS total_calls, count(*) FILTER (status = 'success') AS successful_calls
      FROM step GROUP BY tool_name""",
    "SS-02_daily_counts": f"{v.with_sql('step')} SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, tool_name, count(*) AS n FROM step GROUP BY 1, 2",
    "IO-05_buffered_writes": f"{v.with_sql('message')} SELECT id, role FROM message",
}
