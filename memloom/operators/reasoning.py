"""Reasoning layer: traces, their steps and tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that count as failures.
FAILED = ("error", "failure", "timeout")


def numbered(steps: DataFrame) -> DataFrame:
    """steps with step_number, from 1, by time and id within a trace."""
    return steps.withColumn("step_number", F.row_number().over(Window.partitionBy("trace_id").orderBy("ts", "id")))


def tool_stats(calls: DataFrame) -> DataFrame:
    """By tool: calls, successes, failures, their rate, mean and total duration (unknown ones are skipped), last use."""
    good = F.count_if(F.col("status") == "success")
    return calls.groupBy("tool_name").agg(
        F.count("*").alias("total_calls"), good.alias("successful_calls"), F.count_if(F.col("status").isin(*FAILED)).alias("failed_calls"),
        F.round(good / F.count("*"), 6).alias("success_rate"), F.round(F.avg("duration_ms"), 4).alias("avg_duration_ms"),
        F.max("ts").alias("last_used_at"),
    )


def traces(steps: DataFrame) -> DataFrame:
    """By trace: when it started and ended, its steps, and its success (no failed step)."""
    return steps.groupBy("trace_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("completed_at"), F.count("*").alias("steps"),
        (F.count_if(F.col("status").isin(*FAILED)) == 0).alias("success"),
    )


def with_steps(steps: DataFrame, page: int = 1000) -> DataFrame:
    """By trace and page, from 0: all its steps in order, `page` of them in an array of structs, so that a row stays small."""
    paged = numbered(steps).withColumn("page", F.floor((F.col("step_number") - 1) / page))
    return paged.groupBy("trace_id", "page").agg(F.array_sort(F.collect_list(F.struct("step_number", "tool_name", "status"))).alias("steps"))


def completed(events: DataFrame) -> DataFrame:
    """The latest known outcome of each trace and its first start: a trace's updates folded."""
    known = F.when(F.col("status").isNotNull(), F.struct("ts", "id"))
    return events.groupBy("trace_id").agg(F.min("ts").alias("started_at"), F.max_by("status", known).alias("outcome"))


def touched(steps: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges step_id, entity_id, name; new entities id, name): steps' names joined to entities, stubs for those unknown.

    A stub's id is a hash of its name, so reruns agree.
    """
    named = steps.select(F.col("id").alias("step_id"), "name").distinct()
    known = entities.select("name", F.col("id").alias("entity_id")).groupBy("name").agg(F.min("entity_id").alias("entity_id"))
    both = named.join(known, "name", "left")
    stubs = both.filter("entity_id is null").select("name").distinct().select(F.xxhash64("name").alias("id"), "name")
    return both.select("step_id", F.coalesce("entity_id", F.xxhash64("name")).alias("entity_id"), "name"), stubs


def tool_counters(calls: DataFrame) -> DataFrame:
    """By tool: calls, successes, failures and total duration (unknown ones count as 0), the counters that a tool keeps."""
    return calls.groupBy("tool_name").agg(
        F.count("*").alias("total_calls"), F.count_if(F.col("status") == "success").alias("successful_calls"),
        F.count_if(F.col("status").isin(*FAILED)).alias("failed_calls"), F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("total_duration_ms"),
    )


def raised_counters(counters: DataFrame, calls: DataFrame) -> DataFrame:
    """The counters after further calls; calls are counted before anything meets the counters."""
    both = counters.unionByName(tool_counters(calls))
    return both.groupBy("tool_name").agg(*[F.sum(c).alias(c) for c in ("total_calls", "successful_calls", "failed_calls", "total_duration_ms")])


def stats_of_counters(counters: DataFrame) -> DataFrame:
    """By tool: calls, the rate of successes and the mean duration, from its counters alone."""
    n = F.col("total_calls")
    return counters.filter(n > 0).select(
        "tool_name", "total_calls", F.round(F.col("successful_calls") / n, 6).alias("success_rate"), F.round(F.col("total_duration_ms") / n, 4).alias("avg_duration_ms"),
    )
