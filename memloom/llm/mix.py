"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Method. Every document gets a hash-random key (md5 of its id and a seed). The
key's leading hex digits deal each source's documents into ranges of its sorted
order, so even a source with a third of all rows is spread over many tasks.
Running sums inside a range plus the totals of the ranges before it give each
document's exact place in its source; the source is then cut at its budget, and
whole epochs precede the cut when the budget exceeds the source.

Defined cases. A null text has size 0. Null sources form one source, ordered
last. A row without an id gets its key from its text. Rows with equal ids are
separate rows; ties in the key are ordered by id, then size, and equal rows are
interchangeable. With no rows the result is empty. Very long texts are counted
whole. Further columns pass through, whatever their names.

One row per source passes through a single window task (to number the sources
and fill their targets); documents never do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.shared import WORD, cut

#: No target exceeds this many times its source's size.
CAP = 3
#: Weights of the sources in order, repeated.
WEIGHTS = (1, 2, 3)
#: Rows of one source to aim at in a range of its keys.
ROWS_A_RANGE = 65536


def word_count(text: str | Column) -> Column:
    """Number of words in a text; null counts as 0. Native."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, digits: int) -> DataFrame:
    """docs with its size, source key, hash-random key and range."""
    alone = F.concat(F.lit(seed), F.coalesce(F.col(text_col), F.lit("")))
    key = F.md5(F.coalesce(F.concat(F.col(id_col).cast("string"), F.lit(seed)), alone).cast("binary"))
    return docs.withColumns(
        {
            "_mix_size": word_count(F.col(text_col)),
            "_mix_source": F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t")),  # "t": null, after all "s..."
            "_mix_key": key,
        }
    ).withColumn("_mix_range", F.substring("_mix_key", 1, digits))


def targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: its size, and its target after resharing what exceeds the cap.

    A target is min(cap * size, level * weight). In order of cap * size / weight,
    the sources before the right level are the capped ones; the level is the
    first that its own source does not cap.
    """
    per = cells.groupBy("_mix_source").agg(F.sum("_mix_total").alias("_mix_source_size"))
    order = Window.orderBy("_mix_source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = per.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("_mix_source_size") * cap)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_mix_source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("_mix_source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    share = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    per = per.withColumn("_level", left / share)
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), "_mix_source", "_level"))
    per = per.withColumn("_level", F.min(fits).over(whole)["_level"])
    return per.select(
        "_mix_source",
        "_mix_source_size",
        F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")).alias("_mix_target"),
    )


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP,
) -> tuple[DataFrame, DataFrame]:
    """(keyed rows without other columns, one row per source and range with offset and target)."""
    slim = docs.select(id_col, text_col, source_col)
    sized = keyed(slim, id_col, text_col, source_col, seed, 8).select(
        id_col, source_col, "_mix_size", "_mix_source", "_mix_key"
    )
    sized = cut(sized)
    digits = max(2, math.ceil(math.log(max(1, sized.count() / ROWS_A_RANGE), 16)))
    sized = sized.withColumn("_mix_range", F.substring("_mix_key", 1, digits))
    cells = sized.groupBy("_mix_source", "_mix_range").agg(F.sum("_mix_size").alias("_mix_total"))
    ahead = Window.partitionBy("_mix_source").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("_mix_offset", F.coalesce(F.sum("_mix_total").over(ahead), F.lit(0)))
    return sized, cut(placed.join(targets(cells, weights, cap), "_mix_source"))


def take(sized: DataFrame, cells: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sized with _mix_taken: the words of each document that the mix takes, repeats counted."""
    inside = Window.partitionBy("_mix_source", "_mix_range").orderBy("_mix_key", id_col, "_mix_size")
    running = F.sum("_mix_size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.withColumn("_mix_before", running - F.col("_mix_size")).join(
        cells.drop("_mix_total"), ["_mix_source", "_mix_range"]
    )
    budget = F.floor("_mix_target")
    full = F.expr("floor(_mix_target) div nullif(_mix_source_size, 0)")
    rest = budget - full * F.col("_mix_source_size")
    partial = F.greatest(F.lit(0), F.least(F.col("_mix_size"), rest - F.col("_mix_offset") - F.col("_mix_before")))
    return placed.withColumn("_mix_taken", F.coalesce(full * F.col("_mix_size") + partial, F.lit(0)).cast("long"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's) and taken."""
    id_col = options.get("id_col", "doc_id")
    sized, cells = plan_mix(docs, **options)
    return take(sized, cells, id_col).select(
        id_col,
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        F.col("_mix_taken").alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The documents of the mix, with docs's columns: one row per epoch that takes them.

    The document in which a source's budget ends appears once more with only the
    words up to the budget, so each source yields its exact number of words.
    """
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names that can't clash with this module's
    id_col, text_col, source_col = (plain.columns[docs.columns.index(c)] for c in (id_col, text_col, source_col))
    _, cells = plan_mix(plain, id_col, text_col, source_col, seed, **options)
    n = cells.select(F.max(F.length("_mix_range"))).first()[0] or 2
    taken = take(keyed(plain, id_col, text_col, source_col, seed, n), cells, id_col)
    words = F.col("_mix_taken") - (F.col("_mix_epoch") - 1) * F.col("_mix_size")
    head = F.call_function(
        "regexp_extract",
        F.col(text_col),
        F.concat(F.lit("^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){"), words, F.lit("}+")),
        F.lit(0),
    )
    copies = taken.filter("_mix_taken > 0").withColumn(
        "_mix_epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_mix_taken") / F.col("_mix_size"))))
    )
    cut_short = copies.withColumn(text_col, F.when(words < F.col("_mix_size"), head).otherwise(F.col(text_col)))
    return cut_short.select(*plain.columns).toDF(*docs.columns)
