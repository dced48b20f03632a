"""Documents to training tokens in five stages, each an operator of memloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. A stage decides on all rows that the one
before it kept, by its own statistics over them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.bpe import digests
from memloom.llm.mix import mixed_documents
from memloom.llm.neardup import one_of_each
from memloom.llm.pii import mask_personal_data
from memloom.llm.quality import keep_good
from memloom.llm.shared import saved

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars set to the length of its text, where both are known."""
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return one_of_each(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return _measured(mask_personal_data(docs))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their target weights; a repeated document is a row for each epoch."""
    return _measured(mixed_documents(docs))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, by row."""
    return digests(docs, VOCABULARY)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("personal data", personal_data),
    ("source mix", mix_to_weights),
    ("BPE encoding", bpe_encoding),
]
#: Trained stages and tokenisation are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
