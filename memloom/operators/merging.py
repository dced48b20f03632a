"""Merging of entities: every kind of edge moves to the survivor, with the fold that its kind asks for.

The merges are a table (source, target); chains are followed to their end first
(provenance.final_targets). A catalogue names each edge table's key, its columns
that hold entities, and how rows of one key fold. Rows that the survivor had
come before moved ones, and those in the order of their source, so a repeated run changes nothing.
Tables without an edge of a merged entity pass through unchanged; only the
narrow table of merges is joined to each edge column.

A task holds a partition's rows while it sorts or folds them, so large tables are
dealt in as many partitions as their rows ask for (see parts_of), whatever the session's number is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.longterm import MOST_EVIDENCE, MOST_SOURCES


#: Rows of a partition of a large table.
ROWS_A_PART = 1_000_000
#: Merges of at most so many rows are sent to every task.
SENT_MERGES = 500_000


@dataclass(frozen=True)
class Kind:
    """An edge table: the entity columns, the other key columns, whether ends may be swapped, and the folded columns.

    `fold` maps a column to sum, max, all (of booleans) or the number of distinct list items that are kept, in order; all
    other columns come from the first row.
    """

    entities: tuple[str, ...]
    others: tuple[str, ...] = ()
    undirected: bool = False
    fold: dict[str, str | int] = field(default_factory=dict)


#: The kinds of edges that end at an entity.
CATALOGUE = {
    "MENTIONS": Kind(("entity_id",), ("message_id",)),
    "EXTRACTED_FROM": Kind(("entity_id",), ("message_id",)),
    "EXTRACTED_BY": Kind(("entity_id",), ("extractor",)),
    "APPLIES_TO": Kind(("entity_id",), ("preference_id",)),
    "TOUCHED": Kind(("entity_id",), ("step_id",)),
    "SAME_AS": Kind(("a", "b"), (), True),
    "RELATED_TO": Kind(
        ("source", "target"), ("type",), False,
        {"confidence": "max", "support": "sum", "derived": "all", "source_message_ids": MOST_SOURCES, "evidence": MOST_EVIDENCE},
    ),
}


def parts_of(df: DataFrame) -> int | None:
    """Into how many partitions df is dealt, by its rows; None if they are few enough to leave it to Spark."""
    n = -(-df.count() // ROWS_A_PART)
    return max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if n > 4 else None


def dealt(df: DataFrame, parts: int | None, *columns: str) -> DataFrame:
    return df if parts is None else df.repartition(parts, *columns)


def _moved(edges: DataFrame, merges: DataFrame, kind: Kind, parts: int | None) -> DataFrame:
    """edges with ends at survivors, loops gone, and _from: null, or the least source that the row came from."""
    out, origins = edges, []
    sent = parts is None or merges.count() <= SENT_MERGES
    for n, c in enumerate(kind.entities):
        at = merges.select(F.col("source").alias(f"_s{n}"), F.col("target").alias(f"_t{n}"))
        # Of many merges a task holds its part, and the edges stream by without a sort.
        out = (out if sent else dealt(out, parts, c)).join(at if sent else at.hint("shuffle_hash"), F.col(c) == F.col(f"_s{n}"), "left")
        origins.append(F.col(f"_s{n}"))
    out = out.withColumn("_from", F.least(*origins) if len(origins) > 1 else origins[0])
    out = out.withColumns({c: F.coalesce(f"_t{n}", c) for n, c in enumerate(kind.entities)}).select(*edges.columns, "_from")
    if len(kind.entities) == 2:
        a, b = kind.entities
        out = out.filter(F.col(a) != F.col(b))
        if kind.undirected:
            out = out.withColumns({a: F.least(a, b), b: F.greatest(a, b)})
    return out


def moved_edges(edges: DataFrame, merges: DataFrame, kind: Kind, parts: int | None = None) -> DataFrame:
    """edges with each merged end replaced by its survivor, one row for each key, and migrated_from (null: the survivor's own).

    merges (source, target) must have final targets. parts: see parts_of; None leaves the dealing to Spark.
    """
    key = [*kind.entities, *kind.others]
    order = Window.partitionBy(*key).orderBy(F.col("_from").asc_nulls_first(), *[c for c in edges.columns if c not in key and not c.startswith("_")])
    ranked = dealt(_moved(edges, merges, kind, parts), parts, *key)
    rest = [c for c in edges.columns if c not in key]
    if not kind.fold:
        first = ranked.withColumn("_place", F.row_number().over(order)).filter("_place = 1")
        return first.select(*edges.columns, F.col("_from").alias("migrated_from"))
    firsts = F.struct(F.coalesce(F.col("_from"), F.lit(-(1 << 62))).alias("_from"), *rest)

    def folded(c: str) -> Column:
        how = kind.fold.get(c)
        if how in ("sum", "max"):
            return getattr(F, how)(c).alias(c)
        if how == "all":
            return F.bool_and(c).alias(c)
        if how is None:
            return F.min_by(c, firsts).alias(c)
        # A list has at most `how` items, and so has the answer; a key has a list for each entity merged into its ends.
        lists = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("_from", F.col(c).alias("x")))))  # nulls are left out
        return F.slice(F.array_distinct(F.flatten(F.transform(lists, lambda s: s["x"]))), 1, how).alias(c)

    ordered = ranked.withColumn("_from", F.coalesce("_from", F.lit(-(1 << 62))))
    out = ordered.groupBy(*key).agg(*[folded(c) for c in rest], F.min("_from").alias("_from"))
    return out.select(*edges.columns, F.when(F.col("_from") > -(1 << 62), F.col("_from")).alias("migrated_from"))


def merged_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """entities (id, name, aliases, ...) with merged_into, and the survivors' aliases joined by the names and aliases of what was merged into them."""
    lost = entities.join(merges.withColumnsRenamed({"source": "id", "target": "_into"}), "id")
    none = F.array().cast("array<string>")
    gained = lost.select(F.col("_into").alias("id"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", none))).alias("x")).groupBy("id").agg(F.collect_set("x").alias("_more"))
    out = entities.join(merges.withColumnsRenamed({"source": "id", "target": "merged_into"}), "id", "left").join(gained, "id", "left")
    aliases = F.array_sort(F.array_union(F.coalesce("aliases", none), F.array_except(F.coalesce("_more", none), F.array("name"))))
    return out.withColumn("aliases", F.when(F.col("merged_into").isNull(), aliases).otherwise(F.coalesce("aliases", none))).drop("_more")


def merge(entities: DataFrame, tables: dict[str, DataFrame], merges: DataFrame, parts: int | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(entities, edge tables by kind) after the merges, which must have final targets.

    A source that was merged before (entities.merged_into) is left alone, so that a
    repeated merge does not add supports twice; after a merge no row names it any more.
    """
    fresh = merges
    if "merged_into" in entities.columns:
        done = entities.filter("merged_into is not null").select(F.col("id").alias("source"))
        fresh, entities = merges.join(done, "source", "left_anti"), entities.withColumnRenamed("merged_into", "_before")
    after = merged_entities(entities, fresh)
    if "_before" in after.columns:
        after = after.withColumn("merged_into", F.coalesce("_before", "merged_into")).drop("_before")
    return after, {name: moved_edges(t, fresh, CATALOGUE[name], parts) for name, t in tables.items()}


def dangling(tables: dict[str, DataFrame], merges: DataFrame) -> DataFrame:
    """(kind, n): rows of each table that still end at a merged entity."""
    gone = merges.select(F.col("source").alias("_gone")).distinct()
    parts = []
    for name, t in tables.items():
        for c in CATALOGUE[name].entities:
            parts.append(t.join(gone, F.col(c) == F.col("_gone"), "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("kind").agg(F.sum("n").alias("n"))
