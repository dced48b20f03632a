"""Likes and dislikes that messages state, and names in them, found by fixed phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of likes and dislikes with their confidence, in order of precedence; group 1 is what is liked.
POSITIVE = (
    (r"\bi (?:really )?(?:like|love|enjoy|adore|prefer)\s+(.+)", 0.85),
    (r"\bi(?:'m| am) (?:a (?:big )?fan of|into|passionate about|interested in)\s+(.+)", 0.80),
    (r"\bmy (?:favorite|favourite|preferred|go-to)(?: \w+)? (?:is|are|would be)\s+(.+)", 0.90),
    (r"\bi (?:always|usually|tend to|often) (?:go for|choose|pick|use|opt for)\s+(.+)", 0.75),
    (r"\bnothing (?:beats|compares to|is better than)\s+(.+)", 0.80),
    (r"\bi(?:'m| am) (?:a|an) (\w+(?:\s+\w+)?) (?:person|kind of person|type)", 0.75),
)
NEGATIVE = (
    (r"\bi (?:don't|do not|don't|never|can't stand|cannot stand) (?:like|enjoy|want|care for)\s+(.+)", 0.85),
    (r"\bi (?:hate|dislike|detest|loathe|despise|avoid)\s+(.+)", 0.85),
    (r"\bi(?:'m| am) not (?:a fan of|into|fond of|keen on)\s+(.+)", 0.80),
    (r"\bi (?:can't|cannot) (?:stand|tolerate|bear)\s+(.+)", 0.85),
    (r"\b(\w+(?:\s+\w+)?) (?:is|are) (?:the worst|terrible|awful|horrible|overrated)", 0.70),
)
# Words that begin a clause which is no part of what is liked.
CLAUSES = r"\b(?:because|when|since|but|although|though|so|and)\b"
# Words of each category; most hits decide, the earlier category of equal ones.
CATEGORIES = {
    "food": ("food", "eat", "cook", "restaurant", "cuisine", "dish", "meal", "breakfast", "lunch", "dinner", "snack", "pizza", "pasta", "sushi", "coffee", "tea", "beer", "wine", "chocolate", "dessert", "vegan", "vegetarian", "spicy", "sweet", "salty", "flavor"),
    "music": ("music", "song", "band", "artist", "album", "genre", "playlist", "concert", "jazz", "rock", "pop", "classical", "hip-hop", "rap", "listen", "spotify"),
    "technology": ("tech", "software", "hardware", "app", "programming", "language", "framework", "python", "javascript", "rust", "react", "linux", "mac", "windows", "android", "ios", "ai", "machine learning", "dark mode", "light mode", "editor", "ide", "vim", "emacs"),
    "entertainment": ("movie", "film", "show", "series", "book", "novel", "game", "gaming", "tv", "netflix", "podcast", "youtube", "anime", "manga", "comic", "theater", "theatre"),
    "travel": ("travel", "trip", "vacation", "country", "city", "beach", "mountain", "flight", "hotel", "destination", "hiking"),
    "communication": ("email", "message", "chat", "call", "meeting", "slack", "verbose", "concise", "brief", "detailed", "formal", "casual", "tone", "style"),
    "work": ("work", "job", "career", "office", "remote", "meeting", "schedule", "deadline", "project", "team", "manager"),
}
#: Letters of all scripts make words, in either case.
FLAGS = "(?isU)"
#: Shorter sentences state nothing, nor do subjects of up to two letters; longer subjects are cut at a blank.
LEAST, LONG = 10, 200


def category(sentence: Column) -> Column:
    """The category with most words in a sentence; general without any."""
    low = F.lower(sentence)
    kinds = F.array(*[F.struct(F.lit(-i).alias("place"), F.lit(c).alias("name"), F.array(*map(F.lit, words)).alias("words")) for i, (c, words) in enumerate(CATEGORIES.items())])
    hits = F.transform(kinds, lambda k: F.struct(F.size(F.filter(k["words"], lambda w: F.contains(low, w))).alias("n"), k["place"].alias("place"), k["name"].alias("name")))
    none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("place"), F.lit("general").alias("name"))
    return F.array_max(F.array_append(hits, none))["name"]


def subject(found: Column) -> Column:
    """What is liked, without clauses, trailing signs and blanks."""

    def bare(c: Column) -> Column:
        return F.regexp_replace(c, r"[.,!?;:]+$", "")

    def trimmed(c: Column) -> Column:
        return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    own = bare(trimmed(F.split(bare(trimmed(found)), f"(?sU){CLAUSES}.*$", 2)[0]))
    return F.when(F.char_length(own) > LONG, F.regexp_replace(F.substring(own, 1, LONG), r" [^ ]*$", "")).otherwise(own)


def sentences(messages: DataFrame, text: str = "content") -> DataFrame:
    """id, place and sentence: texts cut at line ends and at blanks after a stop, blank ones left out."""
    parts = F.split(F.regexp_replace(text, r"(?U)([.!?])\s+", "$1\n"), "\n")
    each = messages.select("id", F.posexplode(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))).alias("place", "sentence"))
    return each.filter("sentence <> ''")


def preferences(messages: DataFrame) -> DataFrame:
    """id, place, sentiment, preference, category, confidence, sentence: at most one a sentence.

    The first pattern that matches decides, likes before dislikes, even where its subject turns out too short to tell.
    """
    s = F.col("sentence")
    found = [
        F.when(F.rlike(s, F.lit(f"{FLAGS}{p}")), F.struct(F.lit(kind).alias("sentiment"), F.lit(c).alias("confidence"), F.regexp_extract(s, f"{FLAGS}{p}", 1).alias("raw")))
        for kind, patterns in (("positive", POSITIVE), ("negative", NEGATIVE))
        for p, c in patterns
    ]
    hits = sentences(messages).filter(F.char_length("sentence") >= LEAST).withColumn("f", F.coalesce(*found)).filter("f is not null")
    told = hits.select("id", "place", "f.sentiment", subject(F.col("f.raw")).alias("preference"), category(s).alias("category"), "f.confidence", "sentence")
    return told.filter(F.char_length("preference") > 2)


def name_runs(messages: DataFrame, text: str = "content") -> DataFrame:
    """id and name: each run of two to four words with capitals, from every word of more than two letters on."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    at = messages.select("id", words.alias("w")).select("id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i")).filter("size(w) > 1")

    def capital(c: Column) -> Column:
        return F.rlike(c, F.lit(r"^\p{Lu}"))

    run = F.slice("w", F.col("i"), 4)
    end = F.array_position(F.transform(run, lambda w: ~capital(w)), True)
    n = F.when(end == 0, F.size(run)).otherwise(end.cast("int") - 1)
    named = at.select("id", run.alias("r"), n.alias("n")).filter((F.col("n") > 1) & (F.char_length(F.col("r")[0]) > 2))
    return named.select("id", F.array_join(F.slice("r", 1, F.col("n")), " ").alias("name")).distinct()
