"""Query of the secret finder. Its models are trained, so SQL cannot express it; tests hold it against Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm.secrets import BASE_KINDS, KINDS, digest, find_secrets
from memloom.llm.shared import documents


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(documents(spark, sf_dir, "doc_id", "text")), KINDS, BASE_KINDS)


QUERIES = {"op4_secrets": op4_secrets}
ORACLES: dict[str, str] = {}
