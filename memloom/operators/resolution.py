"""Entity resolution: normalised keys, blocking, scores, bands; and clustering metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block of more members than this tells nothing about them; such blocks find no candidates.
MOST_IN_BLOCK = 60
#: A decision compares all keys of a block; a block's keys are dealt in shares of about this many.
SHARE = 1000
AUTO, REVIEW = 0.90, 0.85
# Leading determiners, legal forms of organisations, titles and suffixes of persons, and the types they belong to.
ARTICLES = ("the", "a", "an")
LEGAL_FORMS = ("inc", "corp", "corporation", "llc", "ltd", "limited", "plc", "gmbh", "co", "company", "ag", "sa", "srl", "pty", "nv", "bv", "oy", "ab")
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")
ORGANISATIONS = ("ORGANIZATION", "ORG", "COMPANY")
PERSONS = ("PERSON", "USER")
#: Weights of the parts of a blended score.
PARTS = {"fuzzy": 0.45, "vector": 0.40, "context": 0.15}


def tokens(name: Column) -> Column:
    """Lower-case words; punctuation other than & separates."""
    return F.filter(F.split(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}&]+", " "), " "), lambda w: w != "")


#: An acronym as it is written.
CAPITALS = r"^\p{Lu}{3,6}$"


def name_key(name: Column, kind: Column) -> Column:
    """A name's words without leading determiners and, by its type, trailing legal forms, or leading titles and trailing suffixes.

    The last word always stays; a name without any word is its own key. Unicode
    forms are not normalised: Spark has no function for that.
    """

    def leading(text: Column, some: tuple[str, ...]) -> Column:
        return F.regexp_replace(text, rf"^(?:(?:{'|'.join(some)})\x20)+", "")

    def trailing(text: Column, some: tuple[str, ...]) -> Column:
        return F.regexp_replace(text, rf"(?:\x20(?:{'|'.join(some)}))+$", "")

    words = leading(F.array_join(tokens(name), " "), ARTICLES)
    kind = F.upper(kind)
    typed = F.when(kind.isin(*ORGANISATIONS), trailing(words, LEGAL_FORMS)).when(kind.isin(*PERSONS), trailing(leading(words, TITLES), SUFFIXES)).otherwise(words)
    return F.when(words != "", typed).otherwise(F.trim(F.regexp_replace(F.lower(name), r"\s+", " ")))


def initials(key: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.split(key, " "), lambda w: F.substring(w, 1, 1)), ""))


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's letters other than blanks, in bits."""
    letters = F.filter(F.split(F.replace(text, F.lit(" ")), ""), lambda c: c != "")
    n = F.size(letters)
    share = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def exact_matches(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention, entity): equal type and key; the least entity id."""
    known = entities.groupBy("type", "key").agg(F.min("id").alias("entity"))
    return mentions.join(known, ["type", "key"]).select(F.col("id").alias("mention"), "entity")


def _ends(df: DataFrame, *cols: str) -> DataFrame:
    """cols, type and block: one row for the first and one for the last word of a key."""
    words = F.split("key", " ")
    each = F.explode(F.array_distinct(F.array(F.concat(F.lit("<"), F.element_at(words, 1)), F.concat(F.lit(">"), F.element_at(words, -1)))))
    return df.select(*cols, "type", each.alias("block"))


def block_pairs(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention, entity) that share type and first or last word, from blocks of at most MOST_IN_BLOCK entities.

    Counts come first, so a large block is dropped before any pair is made.
    """

    def ends(df: DataFrame) -> DataFrame:
        return _ends(df, "id")

    known = ends(entities)
    small = known.groupBy("type", "block").agg(F.count("*").alias("n")).filter(F.col("n") <= MOST_IN_BLOCK).drop("n")
    members = known.join(small, ["type", "block"]).select("type", "block", F.col("id").alias("entity"))
    return ends(mentions).join(members, ["type", "block"]).select(F.col("id").alias("mention"), "entity").distinct()


def blended(fuzzy: Column, vector: Column, context: Column) -> Column:
    """The weighted mean of the parts that are known."""
    named = {"fuzzy": fuzzy, "vector": vector, "context": context}
    total = sum((F.coalesce(named[k] * w, F.lit(0.0)) for k, w in PARTS.items()), F.lit(0.0))
    weight = sum((F.when(named[k].isNotNull(), w).otherwise(0.0) for k, w in PARTS.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def token_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of two keys' words."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def band(score: Column, auto: float = AUTO, review: float = REVIEW) -> Column:
    return F.when(score >= auto, "merged").when(score >= review, "review").otherwise("created")


def _score(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(1.0)).otherwise(token_similarity(a, b))


def decisions(pairs: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Of each mention: the best entity, the score and the action; equal keys score 1, ties go to the lesser id."""
    m = mentions.select(F.col("id").alias("mention"), F.col("key").alias("_a"))
    e = entities.select(F.col("id").alias("entity"), F.col("key").alias("_b"))
    scored = pairs.join(m, "mention").join(e, "entity").select("mention", "entity", _score(F.col("_a"), F.col("_b")).alias("score"))
    best = scored.groupBy("mention").agg(F.max(F.struct("score", (-F.col("entity")).alias("e"))).alias("b"))
    return _decided(m.select("mention").join(best, "mention", "left"))


def _decided(found: DataFrame) -> DataFrame:
    """The decisions of mentions with their best (score, minus entity), null if there is none."""
    score = F.col("b.score")
    action = band(F.coalesce(score, F.lit(0.0)))
    return found.select("mention", F.when(action != "created", -F.col("b.e")).alias("entity"), F.round(score, 6).alias("score"), action.alias("action"))


def key_pairs(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """type, key, other and entity: the asked keys (type, key) with all keys of entities that share type and first or last word.

    Each key stands with the least id of its entities; a block with many of
    them is dealt in shares of about SHARE, so no task holds it whole. A pair that shares both words comes twice.
    """
    known = entities.filter(F.col("key").isNotNull()).groupBy("type", "key").agg(F.min("id").alias("entity"))
    blocks = _ends(known, "key", "entity")
    sizes = blocks.groupBy("type", "block").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    dealt = blocks.join(sizes, ["type", "block"]).select("type", "block", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int").alias("share"), F.col("key").alias("other"), "entity")
    asked = _ends(asked, "key").join(sizes, ["type", "block"])
    asked = asked.select("type", "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "key")
    return asked.join(dealt, ["type", "block", "share"]).select("type", "key", "other", "entity")


def resolved(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """The decisions over all entities that share type and first or last word, whatever the size of their block.

    Scores depend on keys alone, so distinct keys are compared. Equal keys share both words.
    """
    pairs = key_pairs(mentions.select("type", "key").distinct(), entities)
    scored = pairs.select("type", "key", "entity", _score(F.col("key"), F.col("other")).alias("score"))
    best = scored.groupBy("type", "key").agg(F.max(F.struct("score", (-F.col("entity")).alias("e"))).alias("b"))
    return _decided(mentions.select(F.col("id").alias("mention"), "type", "key").join(best, ["type", "key"], "left"))


def gazetteer(aliases: DataFrame) -> DataFrame:
    """(key, canonical) of aliases that name one entity only; ambiguous ones go."""
    return aliases.groupBy("key").agg(F.min("canonical").alias("canonical"), F.count_distinct("canonical").alias("n")).filter("n = 1").drop("n")


def name_relations(kind: Column, name_a: Column, a: Column, name_b: Column, b: Column) -> tuple[Column, Column, Column]:
    """Whether one of two different keys begins the other by whole words, stands in it as a run of words, or is its acronym; never null.

    An acronym is written in three to six capitals, dots left aside, is an organisation's and has the
    initials of a key of several words. Names that are not known are no acronyms. All three hold in either direction.
    """

    def spaced(c: Column) -> Column:
        return F.concat(F.lit(" "), c, F.lit(" "))

    def stands_for(name: Column, short: Column, long: Column) -> Column:
        written = F.rlike(F.replace(F.trim(name), F.lit(".")), F.lit(CAPITALS))
        return written & (F.size(F.split(long, " ")) > 1) & (F.upper(F.replace(short, F.lit(" "))) == initials(long))

    differ, never = (a != b) & (a != "") & (b != ""), F.lit(False)
    prefix = differ & (F.startswith(spaced(a), spaced(b)) | F.startswith(spaced(b), spaced(a)))
    inside = differ & (F.contains(spaced(a), spaced(b)) | F.contains(spaced(b), spaced(a)))
    whose = F.upper(kind).isin(*ORGANISATIONS)
    acronym = whose & (F.coalesce(stands_for(name_a, a, b), never) | F.coalesce(stands_for(name_b, b, a), never))
    return F.coalesce(prefix, never), F.coalesce(inside, never), F.coalesce(acronym, never)


def b_cubed(labelled: DataFrame) -> DataFrame:
    """One row of precision, recall and f1 for mentions with their predicted and gold clusters.

    Cluster sizes come from grouped counts, so no cluster meets in one task.
    """
    cells = labelled.groupBy("predicted", "gold").agg(F.count("*").alias("n"))
    by_predicted = cells.groupBy("predicted").agg(F.sum("n").alias("p"))
    by_gold = cells.groupBy("gold").agg(F.sum("n").alias("g"))
    both = cells.join(by_predicted, "predicted").join(by_gold, "gold")
    n = F.sum("n")
    rows = both.agg((F.sum(F.col("n") * F.col("n") / F.col("p")) / n).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("g")) / n).alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rows.withColumn("f1", f1)


def matched(predicted: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """By type: true positives, false positives and negatives, precision, recall, f1; each item matches one equal item."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    p = predicted.withColumn("_n", place).withColumn("_p", F.lit(1))
    g = gold.withColumn("_n", place).withColumn("_g", F.lit(1))
    both = p.select(*key, "_n", "_p").join(g.select(*key, "_n", "_g"), [*key, "_n"], "full")
    got = both.groupBy("type").agg(
        F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn")
    )
    tp = F.col("tp").cast("double")
    ratio = {"precision": tp + F.col("fp"), "recall": tp + F.col("fn"), "f1": tp + (F.col("fp") + F.col("fn")) / 2}
    return got.withColumns({k: F.round(F.when(d > 0, tp / d).otherwise(0.0), 6) for k, d in ratio.items()})
