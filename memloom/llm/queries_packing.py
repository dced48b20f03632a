"""Query of the packer. SQL cannot express it; tests hold it against the library and the certified bound."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memloom.llm.packing import pack
from memloom.llm.shared import documents

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    return pack(documents(spark, sf_dir, "doc_id", "text"), path, capacity=1024, end_id=2)


QUERIES = {"op11_best_fit_packing": op11_best_fit_packing}
ORACLES: dict[str, str] = {}
