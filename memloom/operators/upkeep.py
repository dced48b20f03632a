"""Keeping the memory in order: new and adopted records, backfills, histories, versions, retrieval scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def created(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The wanted records, one for each key, that are not known yet; of several the one of least hash."""
    new = wanted.join(known.select(key).distinct(), key, "left_anti")
    return new.groupBy(key).agg(F.min_by(F.struct(*wanted.columns), F.xxhash64(*wanted.columns)).alias("r")).select("r.*")


def adopted(rows: DataFrame, label: str, kind: str, name_col: str, id_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A table's rows as entities (id, name, type), and a report (label, adopted, skipped); rows without a name are skipped.

    A row's id is its own, or else its label and name, so adopting again gives the same entities.
    """
    name = F.col(name_col).cast("string")
    made = F.concat(F.lit(label.lower() + ":"), name)
    own = made if id_col is None else F.coalesce(F.col(id_col).cast("string"), made)
    entities = rows.filter(name.isNotNull()).select(own.alias("id"), name.alias("name"), F.lit(kind).alias("type"))
    report = rows.agg(F.count_if(name.isNotNull()).alias("adopted"), F.count_if(name.isNull()).alias("skipped"))
    return entities, report.select(F.lit(label).alias("label"), "*")


def backfilled(rows: DataFrame, fills: dict[str, Column]) -> DataFrame:
    """rows with the null values of some columns filled; values that are there stay."""
    return rows.withColumns({c: F.coalesce(F.col(c), value) for c, value in fills.items()})


def without_vector(records: DataFrame, vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """The records that have no vector (vectors has id_col and v)."""
    return records.join(vectors.filter(F.col("v").isNotNull()).select(id_col), id_col, "left_anti")


def updated(entities: DataFrame, changes: DataFrame, fields: list[str], id_col: str = "id", order: str = "seq") -> DataFrame:
    """entities with each field's last change that is not null (by order); fields without one stay."""
    last = changes.groupBy(id_col).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f"_{f}") for f in fields])
    rows = entities.join(last, id_col, "left")
    return rows.withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])


def active_versions(versions: DataFrame) -> DataFrame:
    """name, revision: of each name the last revision among the active ones."""
    return versions.filter("active").groupBy("name").agg(F.max("revision").alias("revision"))


def version_list(versions: DataFrame) -> DataFrame:
    """name, versions, latest revision and its hash, and the revision that is active, if any."""
    return versions.groupBy("name").agg(
        F.count("*").alias("versions"), F.max("revision").alias("latest"), F.max_by("hash", "revision").alias("hash"),
        F.max(F.when(F.col("active"), F.col("revision"))).alias("active_revision"),
    )


def migrated(entities: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entities relabelled by mapping (old_type, new_type, new_subtype), and a dry run's counts by old and new type."""
    rows = entities.join(mapping, F.upper("type") == F.upper("old_type"), "left")
    counts = rows.filter("old_type is not null").groupBy("old_type", "new_type").agg(F.count("*").alias("n"))
    hit = F.col("old_type").isNotNull()
    moved = rows.withColumns({"subtype": F.when(hit, F.col("new_subtype")).otherwise(F.col("subtype")), "type": F.coalesce("new_type", "type")})
    return moved.select(*entities.columns), counts


def recall_at(expected: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """case, recall: the share of a case's expected ids among the first k results (case, id, rank); none found counts 0."""
    top = results.filter(F.col("rank") <= k).select("case", "id").distinct().withColumn("hit", F.lit(1))
    rows = expected.select("case", "id").distinct().join(top, ["case", "id"], "left")
    return rows.groupBy("case").agg((F.count("hit") / F.count("*")).alias("recall"))


def banded(scored: DataFrame, thresholds: DataFrame, auto: float, review: float) -> DataFrame:
    """scored with action by its type's thresholds (type, auto, review); where one is missing, by the defaults."""
    rows = scored.join(thresholds.select("type", F.col("auto").alias("_auto"), F.col("review").alias("_review")), "type", "left")
    high, low = F.coalesce("_auto", F.lit(auto)), F.coalesce("_review", F.lit(review))
    action = F.when(F.col("score") >= high, "merged").when(F.col("score") >= low, "review").otherwise("created")
    return rows.withColumn("action", action).drop("_auto", "_review")


def exact_resolved(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mention, canonical: equal names of one type, whatever their case and blanks; a name without a match is its own."""

    def plain(c: str) -> Column:
        return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))

    known = entities.select("type", plain("name").alias("_k"), "name").groupBy("type", "_k").agg(F.min("name").alias("_canonical"))
    rows = mentions.withColumn("_k", plain("name")).join(known, ["type", "_k"], "left")
    return rows.select(F.col("id").alias("mention"), F.coalesce("_canonical", "name").alias("canonical"))
