"""Query of the whitening. SQL has no eigenvectors; tests hold the query against exact fractions and a plain solver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm.whitening import whiten


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=4)


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLES: dict[str, str] = {}
