"""What follows extraction: valid names, merges of extractors' results, floors, relations held against an ontology.

Entities have doc, stage (the extractor's place), pos (order within it), name,
type and confidence; relations doc, pos, source, type, target and confidence.
A document's entities are one by normalised name and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that are no entity's name, by kind.
STOP_WORDS = (
    # pronouns
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom",
    "this", "that", "these", "those",
    # verbs
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "would", "should",
    "could", "ought", "might", "must", "shall", "will", "can",
    # articles and determiners
    "a", "an", "the", "some", "any", "no", "every", "each", "either", "neither",
    # prepositions
    "in", "on", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "out", "off", "over", "under",
    # conjunctions
    "and", "but", "or", "nor", "so", "yet", "both", "not", "only", "than", "when", "where", "while", "if", "because", "although",
    # adverbs
    "here", "there", "why", "how", "all", "few", "more", "most", "other", "such", "own", "same", "too", "very", "just", "also", "now", "then",
    "once", "always", "never", "often", "still", "already",
    # generic nouns and references
    "thing", "things", "stuff", "way", "ways", "something", "anything", "nothing", "someone", "anyone", "everyone", "nobody", "everybody",
    "somebody", "people", "person", "man", "woman", "men", "women", "guy", "guys", "time", "times", "day", "days", "year", "years", "today",
    "tomorrow", "yesterday", "one", "ones", "two", "first", "second", "third", "last", "next",
    # fillers
    "like", "really", "actually", "basically", "literally", "maybe", "probably", "perhaps", "well", "okay", "ok", "yes", "yeah", "yep", "nope",
    "um", "uh", "ah", "oh", "hmm", "hm", "er", "eh",
)
# Leading words that do not change what a mention names.
LEADERS = ("a", "an", "the", "my", "your", "our", "their", "his", "her", "its", "this", "that", "these", "those", "any", "all", "some", "each", "every", "new", "open")
#: Letters of the shortest name, and by how much a second extractor's agreement raises confidence.
SHORTEST, AGREED = 2, 1.1


def normalized(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))


def valid_name(name: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Whether a name is neither short, a stop word, a number nor punctuation; null is not valid."""
    key = normalized(name)
    bad = (F.char_length(key) < SHORTEST) | key.isin(*stop_words) | key.rlike(r"(?U)^[\d\s.,%-]+$") | key.rlike(r"^[^\p{L}\p{N}_]+$")
    return F.coalesce(~bad, F.lit(False))


def type_words(label: Column) -> Column:
    """SupportCase, support_case and SUPPORT_CASE as "support case"."""
    apart = F.regexp_replace(label, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.lower(F.trim(F.regexp_replace(apart, r"[\s_]+", " ")))


def names_its_type(name: Column, *labels: Column) -> Column:
    """Whether a name, without leading articles and the like, is one of its types' names or a regular plural of it."""
    word = "|".join(LEADERS)
    bare = F.regexp_replace(type_words(name), f"^(?:(?:{word}) )+(?=.)", "")

    def one(label: Column) -> Column:
        w = type_words(label)
        return F.coalesce((bare != "") & (label != "") & ((bare == w) | (bare == F.concat(w, F.lit("s"))) | (bare == F.concat(w, F.lit("es"))) | (w.endswith("y") & (bare == F.regexp_replace(w, "y$", "ies")))), F.lit(False))

    found = F.lit(False)
    for label in labels:
        found = found | one(label)
    return found


def relation_type(name: Column) -> Column:
    """A relation's type in UPPER_SNAKE."""
    return F.upper(F.regexp_replace(F.regexp_replace(name, r"[\s_-]+", "_"), "^_|_$", ""))


def with_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """The relations both of whose ends are names of the document's entities."""
    known = entities.select("doc", normalized(F.col("name")).alias("_end")).distinct()
    kept = relations
    for end in ("source", "target"):
        kept = kept.withColumn("_end", normalized(F.col(end))).join(known, ["doc", "_end"], "left_semi").drop("_end")
    return kept.select(*relations.columns)


def without_invalid(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities of valid names and the relations that keep both ends."""
    kept = entities.filter(valid_name(F.col("name")))
    return kept, with_endpoints(relations, kept)


def above_floor(entities: DataFrame, relations: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of confidence `least` or more; a relation goes with either end."""
    kept = entities.filter(F.col("confidence") >= least)
    return kept, with_endpoints(relations.filter(F.col("confidence") >= least), kept)


def merged(entities: DataFrame, strategy: str) -> DataFrame:
    """doc, key, type, stage, pos, confidence: one row for each document's entity, by strategy.

    union and confidence: the most confident, the earliest of equals. intersection:
    likewise, of entities found more than once, with raised confidence. cascade:
    the first stage's last mention, else the earliest. first_success: all rows of
    the document's first stage that found anything.
    """
    rows = entities.select("doc", normalized(F.col("name")).alias("key"), "type", "stage", "pos", "confidence")
    if strategy == "first_success":
        first = rows.groupBy("doc").agg(F.min("stage").alias("stage"))
        return rows.join(first, ["doc", "stage"], "left_semi").select(*rows.columns)
    if strategy == "cascade":
        order = F.struct("stage", F.when(F.col("stage") == 0, -F.col("pos")).otherwise(F.col("pos")).alias("p"))
    elif strategy in ("union", "confidence", "intersection"):
        order = F.struct((-F.col("confidence")).alias("c"), "stage", "pos")
    else:
        raise ValueError(f"no merge strategy {strategy!r}")
    best = rows.groupBy("doc", "key", "type").agg(F.min_by(F.struct("stage", "pos", "confidence"), order).alias("b"), F.count("*").alias("n"))
    if strategy == "intersection":
        best = best.filter("n > 1")
    found = best.select("doc", "key", "type", "b.*")
    return found.withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") * AGREED)) if strategy == "intersection" else found


def distinct_relations(relations: DataFrame) -> DataFrame:
    """The most confident, then earliest, of relations with equal ends (whatever their case) and type."""
    key = [F.lower("source").alias("_s"), F.col("type").alias("_t"), F.lower("target").alias("_o")]
    best = relations.groupBy("doc", *key).agg(F.min_by(F.struct(*relations.columns), F.struct((-F.col("confidence")).alias("c"), "pos")).alias("b"))
    return best.select("b.*")


def judged_relations(relations: DataFrame, labelled: DataFrame, patterns: DataFrame) -> DataFrame:
    """relations with permitted: whether patterns (source, type, target) hold the labels of its ends and its type.

    labelled: entities with label; a name stands for its document's first entity
    of that name. Without patterns everything is permitted.
    """
    first = labelled.groupBy("doc", normalized(F.col("name")).alias("_end")).agg(F.min_by("label", F.struct("stage", "pos")).alias("_label"))
    rows = relations
    for end in ("source", "target"):
        rows = rows.withColumn("_end", normalized(F.col(end))).join(first, ["doc", "_end"], "left").drop("_end").withColumnRenamed("_label", f"_{end}")
    legal = patterns.select(F.lower("source").alias("_ls"), relation_type(F.col("type")).alias("_rt"), F.lower("target").alias("_lt"), F.lit(True).alias("_ok")).distinct()
    rows = rows.withColumns({"_ls": F.lower("_source"), "_rt": relation_type(F.col("type")), "_lt": F.lower("_target")}).join(legal, ["_ls", "_rt", "_lt"], "left")
    none = patterns.agg((F.count("*") == 0).alias("_none"))
    permitted = F.coalesce("_ok", F.lit(False)) | F.col("_none")
    return rows.crossJoin(F.broadcast(none)).select(*relations.columns, permitted.alias("permitted"))


def averages(by_type: DataFrame) -> DataFrame:
    """One row of micro and macro precision, recall and f1 from rows of tp, fp and fn by type; nothing found scores 0."""

    def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
        p, r = (F.when(tp + x > 0, tp / (tp + x)).otherwise(0.0) for x in (fp, fn))
        return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}

    each = by_type.select("tp", "fp", "fn", *[c.alias(k) for k, c in rates(F.col("tp"), F.col("fp"), F.col("fn")).items()])
    macro = [F.round(F.coalesce(F.avg(k), F.lit(0.0)), 6).alias(f"macro_{k}") for k in ("precision", "recall", "f1")]
    sums = each.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")], *macro)
    micro = [F.round(c, 6).alias(f"micro_{k}") for k, c in rates(F.col("tp"), F.col("fp"), F.col("fn")).items()]
    return sums.select(*micro, *[c for c in sums.columns if c.startswith("macro_")])
