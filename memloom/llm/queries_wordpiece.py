"""Query of the token counts. SQL cannot express it; tests hold it against plain longest match."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memloom.llm.shared import documents
from memloom.llm.wordpiece import count_tokens, sentencepiece_vocabulary

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def op7_token_counts(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    return count_tokens(documents(spark, sf_dir, "doc_id", "text"), *sentencepiece_vocabulary(path))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLES: dict[str, str] = {}
