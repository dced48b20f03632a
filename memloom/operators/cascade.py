"""The full cascade of evidence that two names mean one entity, over candidate pairs."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators import resolution as rs
from memloom.operators import scores as sc
from memloom.operators.nearest import neighbours
from memloom.operators.upkeep import banded
from memloom.sources.shared import cut

# The scores of each kind of evidence, the least context that confirms a prefix, and the cut for names of few bits.
EXACT, ALIAS, ACRONYM, PREFIX_CONFIRMED, PREFIX = 1.0, 1.0, 0.97, 0.92, 0.88
CONFIRMS, FEW_BITS, FEW_BITS_CUT = 0.60, 2.5, 0.25


def _either(f, a: Column, b: Column) -> Column:
    return f(a, b) | f(b, a)


def own_context(a: Column, b: Column) -> Column:
    """The similarity of two contexts, null where one is missing or holds the other: then both are one source."""

    def flat(c: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))

    return F.when(~_either(F.contains, flat(a), flat(b)), sc.context(a, b))


def judged(pairs: DataFrame, review: float = rs.REVIEW) -> DataFrame:
    """pairs with score and match.

    pairs has type, the keys a and b and, where known (null otherwise), the
    names name_a and name_b, the cosine of their vectors (vector), their contexts
    context_a and context_b and alias groups group_a and group_b. Equal keys,
    shared groups and acronyms of organisations decide alone; a prefix of whole words
    replaces the blend of letters, vectors and contexts.
    """
    known = pairs.columns
    text = {c: F.col(c) if c in known else F.lit(None).cast("string") for c in ("name_a", "name_b", "context_a", "context_b")}
    groups = [F.col(c) if c in known else F.lit(None).cast("array<string>") for c in ("group_a", "group_b")]
    a, b = F.col("a"), F.col("b")
    vector = F.lit(None).cast("double")
    if "vector" in known:
        vector = F.when(F.col("vector").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("vector"))))
    df = pairs.withColumns({"_fuzzy": sc.score("fuzzy", F.when(a != b, a), b), "_context": own_context(text["context_a"], text["context_b"]), "_vector": vector})

    differ = (a != b) & (a != "") & (b != "")
    prefix, inside, acronym = (differ & x for x in rs.name_relations(F.col("type"), text["name_a"], a, text["name_b"], b))
    base = F.coalesce(rs.blended(F.col("_fuzzy"), F.col("_vector"), F.col("_context")), F.lit(0.0))
    bits = F.least(rs.entropy(a), rs.entropy(b))
    held = F.when(bits < FEW_BITS, F.greatest(F.lit(0.0), base - FEW_BITS_CUT)).otherwise(base)
    letters_alone = F.col("_vector").isNull() & F.col("_context").isNull()
    steps = (
        ((a == b) & (a != ""), F.lit(EXACT), "exact"),
        (F.coalesce(F.arrays_overlap(*groups), F.lit(False)), F.lit(ALIAS), "alias"),
        (acronym, F.lit(ACRONYM), "acronym"),
        (prefix, F.when(F.col("_context") >= CONFIRMS, PREFIX_CONFIRMED).otherwise(PREFIX), "prefix"),
        (letters_alone, F.when(inside, F.least(held, F.lit(review))).otherwise(held), "fuzzy"),
        (F.col("_vector").isNotNull(), held, "both"),
        (F.lit(True), held, "fuzzy"),
    )
    score, match = (F.coalesce(*[F.when(s[0], s[1] if i else F.lit(s[2])) for s in steps]) for i in (1, 0))
    return df.withColumns({"score": score, "match": match}).drop("_fuzzy", "_context", "_vector")


def cascaded(mentions: DataFrame, entities: DataFrame, thresholds: DataFrame, auto: float = rs.AUTO, review: float = rs.REVIEW) -> DataFrame:
    """mention, entity, score, match and action of each mention, the least entity of equal scores.

    Mentions with an equal key leave first; only what is left meets the blocks
    of first and last words, key by key (rs.key_pairs).
    """
    known = entities.filter(F.col("key").isNotNull()).groupBy("type", "key").agg(F.min("id").alias("entity"))
    asked = mentions.select("type", "key").distinct()
    equal = asked.join(known, ["type", "key"]).select("type", "key", F.struct(F.lit(EXACT).alias("score"), (-F.col("entity")).alias("e"), F.lit("exact").alias("match")).alias("best"))
    rest = asked.join(known, ["type", "key"], "left_anti")
    pairs = judged(rs.key_pairs(rest, entities).withColumnsRenamed({"key": "a", "other": "b"}), review)
    near = pairs.groupBy("type", F.col("a").alias("key")).agg(F.max(F.struct("score", (-F.col("entity")).alias("e"), "match")).alias("best"))
    found = mentions.select(F.col("id").alias("mention"), "type", "key").join(equal.unionByName(near), ["type", "key"], "left")
    scored = banded(found.withColumn("score", F.coalesce("best.score", F.lit(0.0))), thresholds, auto, review)
    kept = F.col("action") != "created"
    return scored.select("mention", F.when(kept, -F.col("best.e")).alias("entity"), F.round("score", 6).alias("score"), F.when(kept, F.col("best.match")).alias("match"), "action")


def cascaded_by_vectors(mentions: DataFrame, entities: DataFrame, k: int, auto: float = rs.AUTO, review: float = rs.REVIEW) -> DataFrame:
    """mention, entity, score, match and action from equal keys and each mention's k nearest entities by vector.

    Both have id, type, name, key and v (null where it is not known); ids of mentions and
    entities differ. Equal keys decide alone, in one row for each mention. Only what is left meets its neighbours, so
    candidates grow with the mentions. The least entity of equal scores is taken.
    """
    known = entities.filter("key <> ''").groupBy("type", "key").agg(F.min("id").alias("entity"))
    equal = mentions.filter("key <> ''").join(known, ["type", "key"]).select(F.col("id").alias("mention"), "entity", F.lit(EXACT).alias("score"), F.lit("exact").alias("match"))
    rest = cut(mentions.join(known, ["type", "key"], "left_anti").select("id", "type", "name", "key", "v"))
    near = neighbours(rest, entities, k, exact=True).select("id", F.col("other").alias("entity"), F.col("score").alias("vector"))
    other = entities.select(F.col("id").alias("entity"), F.col("name").alias("name_b"), F.col("key").alias("b"))
    pairs = near.join(rest.select("id", "type", F.col("name").alias("name_a"), F.col("key").alias("a")), "id").join(other, "entity")
    best = judged(pairs, review).groupBy("id").agg(F.max(F.struct("score", (-F.col("entity")).alias("e"), "match")).alias("r"))
    found = equal.unionByName(best.select(F.col("id").alias("mention"), (-F.col("r.e")).alias("entity"), "r.score", "r.match"))
    scored = mentions.select(F.col("id").alias("mention")).join(found, "mention", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    action = F.when(F.col("score") >= auto, "merged").when(F.col("score") >= review, "review").otherwise("created")
    kept = F.col("score") >= review
    return scored.select("mention", F.when(kept, F.col("entity")).alias("entity"), F.round("score", 6).alias("score"), F.when(kept, F.col("match")).alias("match"), action.alias("action"))


def plain(c: str) -> Column:
    """A name in lower case, with one blank between its words."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def fuzzy_matches(pairs: DataFrame, scorer: str = "token_sort_ratio", threshold: float = rs.REVIEW) -> DataFrame:
    """Of each mention the entity of the best score of names (name, other), whatever their case, at the threshold at least; the least one of equals."""
    scored = pairs.withColumn("score", sc.score(scorer, plain("name"), plain("other"))).filter(F.col("score") >= threshold)
    best = scored.groupBy("mention").agg(F.max(F.struct("score", (-F.col("entity")).alias("e"))).alias("best"))
    return best.select("mention", (-F.col("best.e")).alias("entity"), F.round("best.score", 6).alias("score"))


def fuzzy_among(mentions: DataFrame, entities: DataFrame, within: list[str], threshold: float = rs.REVIEW) -> DataFrame:
    """fuzzy_matches by sorted words of mentions (mention, name) with all entities (entity, other) that agree in the columns `within`.

    Equal sorted words have the best score and settle a mention by a plain join. Only the
    distinct names of the others are paired with the distinct names of their group, and
    scored where their lengths leave the threshold in reach.
    """

    def in_order(c: str) -> Column:
        return F.array_join(F.array_sort(F.filter(F.split(c, r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda w: w != "")), " ")

    asked = mentions.select("mention", *within, plain("name").alias("a"))
    names = entities.select(*within, "entity", plain("other").alias("b")).groupBy(*within, "b").agg(F.min("entity").alias("entity"))
    by_words = names.groupBy(*within, in_order("b").alias("words")).agg(F.min("entity").alias("entity")).filter("words <> ''")
    each = asked.select(*within, "a").filter("a is not null").distinct().withColumn("words", in_order("a"))
    met = each.join(by_words, [*within, "words"], "left")
    equal = met.filter("entity is not null").select(*within, "a", F.lit(1.0).alias("score"), (-F.col("entity")).alias("e"))
    near = met.filter("entity is null").select(*within, "a", F.length("words").alias("_n")).join(names.withColumn("_m", F.length(in_order("b"))), within)
    # unlike texts of n and m letters share the shorter one at most, and of one length all letters but one
    near = near.filter(2 * F.least("_n", "_m", F.floor((F.col("_n") + F.col("_m") - 1) / 2)) >= threshold * (F.col("_n") + F.col("_m")))
    scored = near.withColumn("score", sc.score("token_sort_ratio", "a", "b")).filter(F.col("score") >= threshold)
    found = equal.unionByName(scored.select(*within, "a", "score", (-F.col("entity")).alias("e")))
    best = found.groupBy(*within, "a").agg(F.max(F.struct("score", "e")).alias("best"))
    once = asked.join(best, [*within, "a"]).groupBy("mention").agg(F.max("best").alias("best"))
    return once.select("mention", (-F.col("best.e")).alias("entity"), F.round("best.score", 6).alias("score"))


def anchored(unmatched: DataFrame, scorer: str = "fuzzy", auto: float = rs.AUTO) -> DataFrame:
    """Second pass: each unmatched mention (episode, type, id, key) takes the anchor of its episode and type that fits best, at auto at least.

    Mentions come in the order of their ids; one that finds no anchor becomes one. The order decides, so the
    distinct keys of an episode and type meet in one task; repeated keys have left before.
    """
    score = sc.SCORERS[scorer]

    def walk(keys: Iterable[str]) -> Iterable[tuple[str, str, float]]:
        anchors: list[str] = []
        for key in keys:
            best, at = max(((score(key, a), -i) for i, a in enumerate(anchors)), default=(0.0, 0))
            if best >= auto:
                yield key, anchors[-at], best
            else:
                anchors.append(key)
                yield key, key, 1.0

    def cluster(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(list(walk(rows.sort_values("first")["key"])), columns=["key", "anchor", "score"])
        return out.assign(episode=key[0], type=key[1])

    kinds = dict(unmatched.dtypes)
    firsts = unmatched.groupBy("episode", "type", "key").agg(F.min("id").alias("first"))
    schema = f"key string, anchor string, score double, episode {kinds['episode']}, type {kinds['type']}"
    found = firsts.groupBy("episode", "type").applyInPandas(cluster, schema)
    anchors = firsts.select("episode", "type", F.col("key").alias("anchor"), F.col("first").alias("anchor_id"))
    return unmatched.join(found, ["episode", "type", "key"]).join(anchors, ["episode", "type", "anchor"]).select("id", "anchor_id", F.round("score", 6).alias("score"))
