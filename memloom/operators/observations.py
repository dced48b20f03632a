"""Decisions and facts that messages state, found by fixed phrases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that mark a decision and a fact, in order of precedence, and the confidence of each kind.
DECISIONS = ("i decided", "i've decided", "let's go with", "i'll go with", "i chose", "i've chosen", "we should", "i want to", "i'm going to", "i plan to")
FACTS = ("the answer is", "it turns out", "actually,", "i found out", "i learned that", "it seems like", "the reason is")
CONFIDENCE = {"decision": 0.75, "fact": 0.70}
#: A sentence of more letters is cut at its last blank before this; one of up to SHORT letters tells nothing.
LONG, SHORT = 300, 10


def sentence_with(text: Column, marker: Column) -> Column:
    """The sentence around the first occurrence of a lower-case marker, or null."""
    at = F.position(marker, F.lower(text))
    before = F.regexp_extract(F.substring(text, F.lit(1), at - 1), r"[^.!?\n]*$", 0)
    own = F.substring(text, at, F.char_length(marker))
    after = F.regexp_extract(F.substring(text, at + F.char_length(marker), F.char_length(text)), r"^[^.!?\n]*[.!?\n]?", 0)
    whole = F.regexp_replace(F.concat(before, own, after), r"^\s+|\s+$", "")
    short = F.concat(F.regexp_replace(F.substring(whole, 1, LONG), r" [^ ]*$", ""), F.lit("..."))
    said = F.when(F.char_length(whole) > LONG, short).otherwise(whole)
    return F.when((at > 0) & (F.char_length(said) > SHORT), said)


def observations(messages: DataFrame) -> DataFrame:
    """id, kind, content, confidence: at most one decision and one fact a message, by the first phrase of each list that it holds."""
    low = F.lower("content")

    def first(markers: tuple[str, ...]) -> Column:
        return reduce(lambda rest, m: F.when(F.contains(low, F.lit(m)), F.lit(m)).otherwise(rest), reversed(markers), F.lit(None).cast("string"))

    kinds = [F.struct(F.lit(k).alias("kind"), F.lit(CONFIDENCE[k]).alias("confidence"), first(m).alias("marker")) for k, m in (("decision", DECISIONS), ("fact", FACTS))]
    each = messages.select("id", F.col("content").alias("text"), F.explode(F.array(*kinds)).alias("o")).filter("o.marker is not null")
    return each.select("id", "o.kind", sentence_with(F.col("text"), F.col("o.marker")).alias("content"), "o.confidence").filter("content is not null")
