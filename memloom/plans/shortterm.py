"""Queries of the short-term layer with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import shortterm as st
from memloom.sources import views as v

M = v.with_sql("message")
STOP = ", ".join(f"('{w}')" for w in st.TOPIC_STOP_WORDS)

QUERIES = {
    "ST-11_list_sessions": lambda s, d: st.sessions(v.messages(s, d)),
    "ST-02_latest_conversation_by_session": lambda s, d: st.latest(
        v.messages(s, d).groupBy("session_id", "conversation_id").agg(F.min("ts").alias("created_at")), ["session_id"], [F.desc("created_at"), F.desc("conversation_id")]
    ),
    "ST-03_list_conversations_of_user": lambda s, d: st.sessions(v.messages(s, d).filter("user_identifier = 'u3'"))
    .select("conversation_id", "session_id", "updated_at").orderBy(F.desc("updated_at")).limit(5),
    "ST-04_monotone_append": lambda s, d: st.monotone(
        v.messages(s, d).withColumn("ts", F.expr("ts - make_dt_interval(0, 0, cast(3 * (id % 4) as int), 0)"))
    ).select("id", "conversation_id", "ts"),
    "ST-05_batch_times": lambda s, d: st.batch_times(
        v.messages(s, d).withColumn("ts", F.when(F.col("turn") % 2 == 0, F.col("ts"))), F.expr("timestamp'2024-06-01 00:00:00'")
    ).select("id", "ts"),
    "ST-06_message_chain": lambda s, d: st.linked(v.messages(s, d)),
    "ST-07_conversation_messages_since": lambda s, d: v.messages(s, d)
    .filter("conversation_id = 7 and ts >= timestamp'2024-01-01 07:01:00'").select("id", "role", "content", "ts").orderBy("ts", "id").limit(1000),
    "ST-10_metadata_language": lambda s, d: v.steps(s, d).filter(st.metadata_filter(F.col("props"), {"k": {"$gte": 10, "$lt": 40, "$ne": 13}})).select("id", "trace_id"),
    "ST-12_delete_message": lambda s, d: st.without(v.messages(s, d), v.messages(s, d).filter("id % 1000 = 1"), "id").select("id"),
    "ST-13_delete_session": lambda s, d: st.without(v.messages(s, d), v.messages(s, d).filter("session_id = 's3'"), "conversation_id").select("id", "session_id"),
    "ST-15_messages_without_mentions": lambda s, d: v.messages(s, d).select("id", "conversation_id").join(
        v.messages(s, d).filter(F.col("content").rlike("[0-9]")).select("id"), "id", "left_anti"
    ),
    "ST-16_all_session_messages": lambda s, d: v.messages(s, d).filter("session_id = 's4'").select("id", "role", "ts").orderBy("ts", "id"),
    "ST-17_summary_entities": lambda s, d: v.messages(s, d)
    .select(F.explode(F.regexp_extract_all("content", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("name"))
    .filter(F.col("name").rlike("^[A-Z][a-z]{3,}$")).groupBy("name").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "name").limit(10),
    "ST-18_conversation_summary": lambda s, d: st.summaries(v.messages(s, d)),
    "ST-19_key_topics": lambda s, d: st.key_topics(v.messages(s, d)).select("conversation_id", "word", "n"),
    "ST-20_recent_messages": lambda s, d: st.recent(v.messages(s, d), 3).select("conversation_id", "id", "place"),
    "ST-21_context_text": lambda s, d: st.recent(v.messages(s, d), 2).groupBy("conversation_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", F.concat_ws(": ", "role", "content").alias("line")))), lambda x: x["line"]), "\n").alias("context")
    ),
    "ST-23_sentence_window": lambda s, d: v.messages(s, d).select("id", F.trim(F.regexp_extract("content", r"^[^.!?]*[.!?]?", 0)).alias("evidence")),
    "ST-24_user_conversations": lambda s, d: v.messages(s, d).select("user_identifier", "conversation_id").distinct(),
    "SS-07_session_per_day": lambda s, d: v.messages(s, d).groupBy(F.concat_ws("-", "user_identifier", F.date_format("ts", "yyyy-MM-dd")).alias("session")).agg(F.count("*").alias("n")),
    "US-01_users": lambda s, d: v.messages(s, d).groupBy("user_identifier").agg(
        F.min("ts").alias("created_at"), F.count_distinct("conversation_id").alias("conversations"), F.count("*").alias("messages")
    ),
}
ORACLES = {
    "ST-11_list_sessions": f"""{M} SELECT conversation_id, session_id, count(id) AS message_count,
       substring(arg_min(content, id), 1, 100) AS first_message_preview, substring(arg_max(content, id), 1, 100) AS last_message_preview,
       min(ts) AS created_at, max(ts) AS updated_at FROM message GROUP BY conversation_id, session_id""",
    "ST-02_latest_conversation_by_session": f"""{M} SELECT session_id, max(conversation_id) AS conversation_id,
       max(CASE WHEN turn = t THEN ts END) AS created_at
       FROM (SELECT *, min(turn) OVER (PARTITION BY conversation_id) AS t, max(conversation_id) OVER (PARTITION BY session_id) AS last FROM message)
       WHERE conversation_id = last GROUP BY session_id""",
    "ST-03_list_conversations_of_user": f"""{M} SELECT conversation_id, session_id, max(ts) AS updated_at FROM message
       WHERE user_identifier = 'u3' GROUP BY 1, 2 ORDER BY updated_at DESC LIMIT 5""",
    "ST-04_monotone_append": f"""{M}, late AS (SELECT id, conversation_id, epoch_us(ts - to_minutes(3 * (id % 4))) AS t,
         row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS n FROM message)
       SELECT id, conversation_id, make_timestamp(max(t - n) OVER (PARTITION BY conversation_id ORDER BY id ROWS UNBOUNDED PRECEDING) + n) AS ts FROM late""",
    "ST-05_batch_times": f"""{M} SELECT id, CASE WHEN turn % 2 = 0 THEN ts ELSE TIMESTAMP '2024-06-01' +
         to_microseconds(row_number() OVER (PARTITION BY conversation_id ORDER BY id) - 1) END AS ts FROM message""",
    "ST-06_message_chain": f"""{M} SELECT conversation_id, id, lead(id) OVER w AS next_id, row_number() OVER w = 1 AS is_first FROM message
       WINDOW w AS (PARTITION BY conversation_id ORDER BY ts, id)""",
    "ST-07_conversation_messages_since": f"""{M} SELECT id, role, content, ts FROM message
       WHERE conversation_id = 7 AND ts >= TIMESTAMP '2024-01-01 07:01:00' ORDER BY ts, id LIMIT 1000""",
    "ST-10_metadata_language": f"""{v.with_sql('step')}, k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM step)
       SELECT id, trace_id FROM k WHERE k >= 10 AND k < 40 AND k <> 13""",
    "ST-12_delete_message": f"{M} SELECT id FROM message WHERE id % 1000 <> 1",
    "ST-13_delete_session": f"{M} SELECT id, session_id FROM message WHERE session_id <> 's3'",
    "ST-15_messages_without_mentions": f"{M} SELECT id, conversation_id FROM message WHERE NOT regexp_matches(content, '[0-9]')",
    "ST-16_all_session_messages": f"{M} SELECT id, role, ts FROM message WHERE session_id = 's4'",
    "ST-17_summary_entities": rf"""{M} SELECT name, count(*) AS mentions FROM (
         SELECT unnest(regexp_extract_all(content, '[\pL\pN_]+')) AS name FROM message)
       WHERE regexp_full_match(name, '[A-Z][a-z]{{3,}}') GROUP BY name ORDER BY mentions DESC, name LIMIT 10""",
    "ST-18_conversation_summary": f"""{M} SELECT conversation_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user,
       count(*) FILTER (role = 'assistant') AS n_assistant, substring(arg_min(content, id) FILTER (role = 'user'), 1, 200) AS first_user_message,
       (epoch_us(max(ts)) - epoch_us(min(ts))) // 60000000 AS minutes FROM message GROUP BY conversation_id""",
    "ST-19_key_topics": rf"""{M}, stop(word) AS (VALUES {STOP}), w AS (
         SELECT conversation_id, unnest(regexp_extract_all(lower(content), '[\pL\pN_]+')) AS word FROM message),
       c AS (SELECT conversation_id, word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]{{4,}}') AND word NOT IN (SELECT word FROM stop) GROUP BY 1, 2)
       SELECT conversation_id, word, n FROM c QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY n DESC, word) <= 5""",
    "ST-20_recent_messages": f"""{M} SELECT conversation_id, id, row_number() OVER w::INT AS place FROM message
       WINDOW w AS (PARTITION BY conversation_id ORDER BY ts DESC, id DESC) QUALIFY row_number() OVER w <= 3""".replace("row_number() OVER w::INT", "CAST(row_number() OVER w AS INT)"),
    "ST-21_context_text": f"""{M}, r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ts DESC, id DESC) AS place FROM message)
       SELECT conversation_id, string_agg(role || ': ' || content, chr(10) ORDER BY ts, id) AS context FROM r WHERE place <= 2 GROUP BY conversation_id""",
    "ST-23_sentence_window": f"{M} SELECT id, trim(regexp_extract(content, '^[^.!?]*[.!?]?')) AS evidence FROM message",
    "ST-24_user_conversations": f"{M} SELECT DISTINCT user_identifier, conversation_id FROM message",
    "SS-07_session_per_day": f"{M} SELECT user_identifier || '-' || strftime(ts, '%Y-%m-%d') AS session, count(*) AS n FROM message GROUP BY 1",
    "US-01_users": f"""{M} SELECT user_identifier, min(ts) AS created_at, count(DISTINCT conversation_id) AS conversations, count(*) AS messages
       FROM message GROUP BY user_identifier""",
}
