"""Queries of the two classifiers. SQL cannot express them; tests measure held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm.quality import score_quality
from memloom.llm.shared import documents
from memloom.llm.toxicity import score_toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir, "doc_id", "text"), _labels(spark, sf_dir))


def op10_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir, "doc_id", "text"), _labels(spark, sf_dir))


QUERIES = {"op6_toxicity": op6_toxicity, "op10_quality_neighbours": op10_quality_neighbours}
ORACLES: dict[str, str] = {}
