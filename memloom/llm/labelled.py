"""A bounded sample of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import cut, is_training


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, parts: int = 8) -> DataFrame:
    """doc_id, text, y: at most `per_class` training rows of each class, by hash of the id.

    A document with several labels has their mean, rounded; null labels take no
    part. Of documents that share an id the least text is taken. The ids (2 *
    per_class at most) are broadcast, so no text is shuffled but the sample's,
    which are kept in the shared folder.
    """
    rows = (
        labels.filter(F.col(label).isNotNull() & is_training())
        .groupBy("doc_id")
        .agg(F.when(F.avg(label) >= 0.5, 1).otherwise(0).alias("y"))
    )
    order = F.xxhash64("doc_id")
    picked = [rows.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionAll(picked[1]))
    picked_texts = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return cut(picked_texts.coalesce(parts))
