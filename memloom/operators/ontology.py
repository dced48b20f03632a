"""Ontologies as tables: entity types (place, label, pole_type, subtype) and relationships (source, type, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(entities: DataFrame, types: DataFrame) -> DataFrame:
    """entities with label: the declared label of their type and subtype, or null.

    The exact pair comes first, then the type without subtype, then, for an
    entity without subtype, the type's first label, then a label that is named
    as the type and has the entity's subtype (any, if it has none).
    """
    empty = F.lit("")
    pairs = entities.select(F.upper("type").alias("_t"), F.coalesce(F.upper("subtype"), empty).alias("_s")).distinct()
    known = types.select("place", "label", F.upper("pole_type").alias("pole"), F.coalesce(F.upper("subtype"), empty).alias("sub"))
    keyed = known.select(F.col("pole").alias("_t"), F.lit(0).alias("by_label"), "*").unionAll(known.select(F.upper("label").alias("_t"), F.lit(1).alias("by_label"), "*"))
    bare, same = F.col("_s") == "", F.col("sub") == F.col("_s")
    by_pole = F.when(same, 0).when(F.col("sub") == "", 1).when(bare, 2)
    rank = F.when(F.col("by_label") == 0, by_pole).when(bare | same, 3)
    ranked = pairs.join(keyed, "_t").withColumn("rank", rank).filter("rank is not null")
    found = ranked.groupBy("_t", "_s").agg(F.min_by("label", F.struct("rank", "place")).alias("label"))
    rows = entities.withColumns({"_t": F.upper("type"), "_s": F.coalesce(F.upper("subtype"), empty)})
    return rows.join(found, ["_t", "_s"], "left").drop("_t", "_s")


def permitted(triples: DataFrame, relationships: DataFrame) -> DataFrame:
    """The triples (source, type, target) that an ontology declares, whatever their case."""
    low = [F.lower(c).alias(f"_{c}") for c in ("source", "type", "target")]
    keys = ["_source", "_type", "_target"]
    return triples.select("*", *low).join(relationships.select(*low).distinct(), keys, "left_semi").drop(*keys)


def content_key(rows: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """by and content_key: a digest of a group's rows that does not depend on their order.

    A row counts as the JSON of its columns; a group's digest is that of its
    rows' sorted digests. Groups are ontology documents, so they are small.
    """
    row = F.sha2(F.to_json(F.struct(*cols)), 256)
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ","), 256).alias("content_key"))


def differences(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """key (in lower case), change and fields: rows added, removed or modified, with the names of the changed fields.

    Names are not matched with other names: one that changed was removed and added.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.lower(k).alias(k) for k in key], F.struct(*fields).alias(name))

    both = side(old, "before").join(side(new, "after"), key, "full")

    def changed(f: str) -> Column:
        return F.when(~F.col(f"before.{f}").eqNullSafe(F.col(f"after.{f}")), F.lit(f))

    what = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("modified")
    names = F.when(what == "modified", F.array_join(F.array_compact(F.array(*[changed(f) for f in fields])), ",")).otherwise("")
    return both.select(*key, what.alias("change"), names.alias("fields")).filter("change <> 'modified' or fields <> ''")
