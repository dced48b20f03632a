"""Provenance of entities (links to messages and extractors), places, and merging of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.sources.shared import cut

EARTH_M = 6371000.0


# --- provenance


def fold_links(links: DataFrame) -> DataFrame:
    """One link for each (entity_id, message_id, extractor): the greatest confidence, the first position."""
    return links.groupBy("entity_id", "message_id", "extractor").agg(F.max("confidence").alias("confidence"), F.min("start_pos").alias("start_pos"))


def provenance(links: DataFrame) -> DataFrame:
    """By entity: numbers of messages and extractors and the extractors' names; two aggregates, no cross product."""
    sources = links.groupBy("entity_id").agg(F.count_distinct("message_id").alias("n_sources"), F.max("confidence").alias("confidence"))
    extractors = links.groupBy("entity_id").agg(F.array_sort(F.collect_set("extractor")).alias("extractors"))
    return sources.join(extractors, "entity_id")


def extractor_stats(extractors: DataFrame, links: DataFrame) -> DataFrame:
    """Every extractor with its number of entities and mean confidence, also those without any."""
    seen = links.groupBy("extractor").agg(F.count_distinct("entity_id").alias("entities"), F.avg("confidence").alias("confidence"))
    return extractors.join(seen, "extractor", "left").select("extractor", F.coalesce("entities", F.lit(0)).alias("entities"), "confidence")


# --- places


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres (haversine)."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def near(places: DataFrame, latitude: float, longitude: float, radius_m: float) -> DataFrame:
    """Places within a radius, with distance_m; a latitude band, which scans can use, comes first."""
    band = radius_m / EARTH_M * 57.29577951308232 * 1.0001
    some = places.filter(F.col("latitude").between(latitude - band, latitude + band))
    d = distance_m(F.col("latitude"), F.col("longitude"), F.lit(latitude), F.lit(longitude))
    return some.withColumn("distance_m", d).filter(F.col("distance_m") <= radius_m)


def in_box(places: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Places in a box; west > east means a box over the antimeridian."""
    lon = F.col("longitude")
    inside = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return places.filter(F.col("latitude").between(south, north) & inside)


def geocode(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """names (id, name) with the coordinates that the gazetteer has for the trimmed lower-case name; the least id on ties."""
    known = gazetteer.select(F.lower(F.trim("name")).alias("_key"), "id", "latitude", "longitude").groupBy("_key").agg(
        F.min_by("latitude", "id").alias("latitude"), F.min_by("longitude", "id").alias("longitude")
    )
    return names.withColumn("_key", F.lower(F.trim("name"))).join(known, "_key", "left").drop("_key")


# --- duplicates


def same_as(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """New pairs (a < b) of candidates (a, b, confidence) that are not known in either direction, with a status."""

    def pair(df: DataFrame) -> list[Column]:
        return [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    fresh = candidates.filter("a <> b").groupBy(*pair(candidates)).agg(F.max("confidence").alias("confidence"))
    return fresh.join(known.select(*pair(known)).distinct(), ["a", "b"], "left_anti").withColumn("status", F.lit("pending"))


def reviewed(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """pairs with the status that decisions (a, b, confirmed) give."""
    said = F.when(F.col("confirmed"), "confirmed").when(~F.col("confirmed"), "rejected")
    return pairs.join(decisions, ["a", "b"], "left").withColumn("status", F.coalesce(said, "status")).drop("confirmed")


def final_targets(merges: DataFrame, rounds: int = 40) -> DataFrame:
    """merges (source, target) with chains of any length followed to their end; a cycle is an error.

    Each round doubles the steps that are followed, so few are needed.
    """
    now = cut(merges.groupBy("source").agg(F.min("target").alias("target")))
    for _ in range(rounds):
        further = now.select(F.col("source").alias("target"), F.col("target").alias("_next"))
        now = cut(now.join(further, "target", "left").select("source", F.coalesce("_next", "target").alias("target"), (F.col("_next") != F.col("target")).alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("source", "target")
        now = now.select("source", "target")
    raise ValueError("the merges form a cycle")


def rewritten(df: DataFrame, merges: DataFrame, *columns: str) -> DataFrame:
    """df with merged ids replaced by their targets in the given columns."""
    out = df
    for c in columns:
        moved = merges.select(F.col("source").alias(c), F.col("target").alias("_target"))
        out = out.join(moved, c, "left").withColumn(c, F.coalesce("_target", c)).drop("_target")
    return out.select(*df.columns)


def superseded_pairs(preferences: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(old, new) among near neighbours (id, other, score): the same category, another value, and newer."""
    p = preferences.select("id", "category", "value", "valid_from")
    o = p.toDF("other", "_category", "_value", "_from")
    both = neighbours.join(p, "id").join(o, "other")
    newer = (F.col("category") == F.col("_category")) & (F.col("value") != F.col("_value")) & (F.col("_from") > F.col("valid_from"))
    return both.filter(newer).select(F.col("id").alias("old"), F.col("other").alias("new"), "score")
