"""Query of the byte-pair encoder. SQL cannot express it; tests hold it against the library."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memloom.llm.bpe import digests
from memloom.llm.shared import documents

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    return digests(documents(spark, sf_dir, "doc_id", "text"), path)


QUERIES = {"op1_bpe_encode_decode": op1_bpe_encode_decode}
ORACLES: dict[str, str] = {}
