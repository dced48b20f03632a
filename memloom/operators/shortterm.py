"""Short-term layer: conversations and their messages.

Message tables have id, conversation_id, session_id, user_identifier, turn, role,
content and ts. Nothing reads the clock: times that matter are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "id")
#: Words that are never a topic.
TOPIC_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can "
    "need dare ought used to of in for on with at by from as into through during before after above below between under "
    "again further then once here there when where why how all each few more most other some such no nor not only own "
    "same so than too very just and but if or because until while although this that these those conversation messages "
    "user assistant started duration"
).split()


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def linked(messages: DataFrame) -> DataFrame:
    """One chain a conversation: the next message of each, and whether it is the first."""
    w = Window.partitionBy("conversation_id").orderBy(*ORDER)
    return messages.select(
        "conversation_id", "id", F.lead("id").over(w).alias("next_id"), (F.row_number().over(w) == 1).alias("is_first")
    )


def monotone(messages: DataFrame) -> DataFrame:
    """Times as an append sees them: at least a microsecond after the conversation's tail, in arrival order (id).

    With t the greatest time so far, less one microsecond for each message since, the time is that maximum plus its place.
    """
    w = Window.partitionBy("conversation_id").orderBy("id")
    micros = F.unix_micros("ts")
    place = F.row_number().over(w)
    ahead = messages.withColumns({"_n": place, "_t": micros - place})
    tail = F.max("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ahead.withColumn("ts", F.timestamp_micros(tail + F.col("_n"))).drop("_n", "_t")


def batch_times(messages: DataFrame, base: Column) -> DataFrame:
    """Messages without a time get base plus one microsecond for each place in input order (id)."""
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("id")) - 1
    return messages.withColumn("ts", F.coalesce("ts", F.timestamp_micros(F.unix_micros(base) + place)))


def sessions(messages: DataFrame, preview: int = 100) -> DataFrame:
    at = F.struct(*ORDER)
    return messages.groupBy("conversation_id", "session_id").agg(
        F.count("id").alias("message_count"),
        F.substring(F.min_by("content", at), 1, preview).alias("first_message_preview"),
        F.substring(F.max_by("content", at), 1, preview).alias("last_message_preview"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )


def metadata_filter(col: Column, conditions: dict[str, object]) -> Column:
    """A condition on a JSON column: {key: value} or {key: {operator: value}}.

    Operators: $eq $ne $gt $gte $lt $lte $in $nin $exists $contains $startswith $endswith. Numbers compare as numbers.
    """
    out = F.lit(True)
    for key, want in conditions.items():
        for op, value in (want if isinstance(want, dict) else {"$eq": want}).items():
            got = F.get_json_object(col, f"$.{key}")
            one = value[0] if isinstance(value, (list, tuple)) and value else value
            if isinstance(one, (int, float)) and not isinstance(one, bool):
                got = got.cast("double")
            elif isinstance(one, bool) and op != "$exists":
                got = got.cast("boolean")
            out &= {
                "$eq": lambda: got == value, "$ne": lambda: ~got.eqNullSafe(F.lit(value)), "$gt": lambda: got > value,
                "$gte": lambda: got >= value, "$lt": lambda: got < value, "$lte": lambda: got <= value,
                "$in": lambda: got.isin(*value), "$nin": lambda: got.isNull() | ~got.isin(*value),
                "$exists": lambda: got.isNotNull() if value else got.isNull(), "$contains": lambda: got.contains(value),
                "$startswith": lambda: got.startswith(value), "$endswith": lambda: got.endswith(value),
            }[op]()
    return F.coalesce(out, F.lit(False))


def summaries(messages: DataFrame) -> DataFrame:
    """Counts by role, the first user message and the span in minutes, by conversation."""
    user = F.when(F.col("role") == "user", F.struct(*ORDER))
    return messages.groupBy("conversation_id").agg(
        F.count("*").alias("n_messages"),
        F.count_if(F.col("role") == "user").alias("n_user"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.substring(F.min_by("content", user), 1, 200).alias("first_user_message"),
        F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 60_000_000).alias("minutes"),
    )


def key_topics(messages: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent longer words of each conversation; ties by word."""
    words = F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    counted = (
        messages.select("conversation_id", words.alias("word"))
        .filter(F.col("word").rlike("^[a-z]{4,}$") & ~F.col("word").isin(*TOPIC_STOP_WORDS))
        .groupBy("conversation_id", "word")
        .agg(F.count("*").alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("n"), "word"))
    return counted.withColumn("place", place).filter(F.col("place") <= k)


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation, in order."""
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("ts"), F.desc("id")))
    return messages.withColumn("place", place).filter(F.col("place") <= n)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in gone: deletes, as an anti join."""
    return df.join(gone.select(key).distinct(), key, "left_anti")
