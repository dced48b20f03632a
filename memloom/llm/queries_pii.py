"""Query of the personal data finder. Its classifier is trained, so SQL cannot express it; tests hold it against Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm.pii import BASE_KINDS, KINDS, digest, find_personal_data
from memloom.llm.shared import documents


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_personal_data(documents(spark, sf_dir, "doc_id", "text")), KINDS, BASE_KINDS)


QUERIES = {"op2_personal_data": op2_personal_data}
ORACLES: dict[str, str] = {}
