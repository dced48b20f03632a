"""Long-term layer: entities, facts, preferences and typed relations as keyed folds.

An upsert is a fold of the observations of a key, in order of arrival (`seq`):
batches can be folded on their own and the results folded again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of a relation: source messages and pieces of evidence that are kept.
MOST_SOURCES, MOST_EVIDENCE = 25, 3


def entity_keys(name: Column, aliases: Column) -> Column:
    """The distinct lower-case surface forms of an entity, sorted: equi-join keys for lookups by name."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(F.array(name), aliases), F.lower), lambda x: x.isNotNull() & (x != ""))))


def fold_entities(observations: DataFrame) -> DataFrame:
    """One row for each (name, type): the first id (seq), the latest known subtype and description, the greatest confidence."""
    seen = F.struct("seq")

    def latest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), seen)).alias(c)

    return observations.groupBy("name", "type").agg(
        F.min("seq").alias("id"), latest("subtype"), latest("description"), F.max("confidence").alias("confidence"), F.count("*").alias("observed")
    )


def fold_relations(observations: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each (source, type, target); self-loops go.

    Confidence is the greatest, support the number of observations, derived only
    if all are; the first MOST_SOURCES messages and MOST_EVIDENCE texts by order
    of arrival are kept. Rows are dealt by key once; what follows sorts them where they
    are, and a list holds no more values than are kept. parts: how many partitions they are dealt in; None leaves it to Spark.
    """
    key = ["source", "type", "target"]

    def begins(column: str) -> Column:
        """1 in the row that brings a value of column to its key first, null in others."""
        first = F.row_number().over(Window.partitionBy(*key, column).orderBy(F.col("seq").asc_nulls_last()))
        return F.when(F.col(column).isNotNull() & (first == 1), F.lit(1))

    def place(mark: str, column: str) -> Column:
        upto = Window.partitionBy(*key).orderBy("seq", column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.when(F.col(mark).isNotNull(), F.count(mark).over(upto))

    def listed(at: str, column: str, most: int, name: str) -> Column:
        some = F.array_sort(F.collect_list(F.when(F.col(at) <= most, F.struct(F.col(at).alias("place"), F.col(column).alias("x")))))
        return F.when(F.size(some) > 0, F.transform(some, lambda s: s["x"])).alias(name)

    rows = observations.filter("source <> target")
    rows = rows.repartition(*key) if parts is None else rows.repartition(parts, *key)
    rows = rows.withColumns({"_m": begins("message_id"), "_e": begins("evidence")})
    rows = rows.withColumns({"_m": place("_m", "message_id"), "_e": place("_e", "evidence")})
    return rows.groupBy(*key).agg(
        F.max("confidence").alias("confidence"), F.count("*").alias("support"), F.bool_and("derived").alias("derived"),
        listed("_m", "message_id", MOST_SOURCES, "source_message_ids"), listed("_e", "evidence", MOST_EVIDENCE, "evidence"),
    )


def refold_relations(relations: DataFrame) -> DataFrame:
    """Folded relations whose ends were rewritten, folded again: supports add up."""
    return (
        relations.filter("source <> target")
        .groupBy("source", "type", "target")
        .agg(F.max("confidence").alias("confidence"), F.sum("support").alias("support"), F.bool_and("derived").alias("derived"))
    )


def neighbours(relations: DataFrame, ids: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(id, neighbour, type, outgoing) of each id: one hop, in both directions."""
    kept = relations if types is None else relations.filter(F.col("type").isin(types))
    both = kept.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "type", F.lit(True).alias("outgoing")).unionAll(
        kept.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "type", F.lit(False).alias("outgoing"))
    )
    return both.join(ids.select("id").distinct(), "id", "left_semi")


def by_name(entities: DataFrame, name: str) -> DataFrame:
    """Entities one of whose surface forms is `name`, in any case."""
    return entities.filter(F.array_contains("keys", name.lower()))


def supersede(preferences: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """Preferences named in pairs (old, new) end now, unless they had ended."""
    ended = pairs.select(F.col("old").alias("id"), F.lit(True).alias("_old")).distinct()
    until = F.coalesce("valid_until", F.when(F.col("_old"), now))
    return preferences.join(ended, "id", "left").withColumn("valid_until", until).drop("_old")


def valid_at(df: DataFrame, when: Column) -> DataFrame:
    """Rows whose half-open interval [valid_from, valid_until) holds `when`; null bounds are open."""
    begun = F.col("valid_from").isNull() | (F.col("valid_from") <= when)
    return df.filter(begun & (F.col("valid_until").isNull() | (F.col("valid_until") > when)))


def active(preferences: DataFrame, superseded: DataFrame) -> DataFrame:
    """Preferences that no other supersedes."""
    return preferences.join(superseded.select(F.col("old").alias("id")).distinct(), "id", "left_anti")


def fold_facts(facts: DataFrame) -> DataFrame:
    """One row for each (subject, predicate): the object of the greatest confidence, the earlier one on ties."""
    best = F.struct(F.col("confidence"), -F.col("seq"))
    return facts.groupBy("subject", "predicate").agg(
        F.max_by("object", best).alias("object"), F.max("confidence").alias("confidence"), F.count("*").alias("support")
    )


def first_links(links: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first link written of each key stays."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return links.withColumn("_place", place).filter("_place = 1").drop("_place")


def add_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """entities (id, aliases) with those of `aliases` (id, alias) that they lack, sorted."""
    more = aliases.groupBy("id").agg(F.collect_set("alias").alias("_more"))
    none = F.array().cast("array<string>")
    return entities.join(more, "id", "left").withColumn(
        "aliases", F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("_more", none)))
    ).drop("_more")


def resolve_ends(relations: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with names for ends -> ids: an entity mentioned in the same message first, else the first of that name."""
    local = mentions.select("message_id", F.lower("name").alias("_name"), F.col("entity_id").alias("_local")).groupBy("message_id", "_name").agg(F.min("_local").alias("_local"))
    wide = entities.select(F.lower("name").alias("_name"), F.col("id").alias("_wide")).groupBy("_name").agg(F.min("_wide").alias("_wide"))
    out = relations
    for end in ("source", "target"):
        out = out.withColumn("_name", F.lower(F.col(end)))
        out = out.join(local, ["message_id", "_name"], "left").join(wide, "_name", "left")
        out = out.withColumn(f"{end}_id", F.coalesce("_local", "_wide")).drop("_name", "_local", "_wide")
    return out.filter("source_id is not null and target_id is not null")
