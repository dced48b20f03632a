"""Streams of messages and tool calls: monotone times, running counters, windows over late data, a Parquet sink.

Each query reads its table as a stream of files, runs until what is there has
been handled (availableNow) and keeps its state and results in the shared
folder, so a restart goes on from the last committed batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType

from memloom.sources.shared import new_dir


def read_stream(spark: SparkSession, sf_dir: str, table: str, files: int = 16) -> DataFrame:
    """A table's files as a stream, at most `files` in a batch. A pattern, since a plain path would have to be a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{table}.parque[t]")


def stored(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input into a table of its own, and read that table.

    In update mode each batch's rows carry its number, and the last row of a key wins in latest().
    """
    spark = stream.sparkSession
    out, state = new_dir(spark, name), new_dir(spark, f"{name}-state")
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", out)
    else:

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch-{number}")

        run = stream.writeStream.foreachBatch(write)
    run.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(_schema(stream, mode)).parquet(out if mode == "append" else f"{out}/batch-*")


def _schema(stream: DataFrame, mode: str):
    fields = stream.schema
    return fields if mode == "append" else fields.add("_batch", IntegerType())


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key of a table of updates."""
    rest = [c for c in updates.columns if c not in (*keys, "_batch")]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_s"))
    return newest.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def tool_counters(calls: DataFrame) -> DataFrame:
    """Running counters of each tool, as updates."""
    return calls.groupBy("tool_name").agg(F.count("*").alias("total_calls"), F.count_if(F.col("status") == "success").alias("successful_calls"))


def windowed_counts(calls: DataFrame, length: str = "1 day", late: str = "60 days") -> DataFrame:
    """Counts by tool and tumbling window of event time; rows later than `late` are left out, as the watermark says."""
    return calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "tool_name").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("day"), "tool_name", "n"
    )


def monotone_times(messages: DataFrame) -> DataFrame:
    """(conversation_id, id, ts): a message never comes before its conversation's tail, which is the state: one number."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("id", kind="stable")
        times = []
        for t in rows["micros"]:
            tail = int(t) if tail is None else max(int(t), tail + 1)
            times.append(tail)
        state.update((tail,))
        yield pd.DataFrame({"conversation_id": rows["conversation_id"], "id": rows["id"], "micros": times})

    stamped = messages.select("conversation_id", "id", F.unix_micros("ts").alias("micros"))
    out = stamped.groupBy("conversation_id").applyInPandasWithState(
        run, "conversation_id long, id long, micros long", "tail long", "append", GroupStateTimeout.NoTimeout
    )
    return out.select("conversation_id", "id", F.timestamp_micros("micros").alias("ts"))
