"""Mentions of known entities in texts: where each name or alias stands, and what follows from that.

A word is a run of letters, digits, `_` and `#`. A surface form (a name or an alias, in
any case) matches words in a row with white space alone between them. Of
overlapping matches the leftmost counts, and the longest of those. A form
that belongs to several entities matches, but names none of them: it links nothing.

Two ways give the same rows. The entities are read once: of their forms those go first of
which the longest word stands in no text, and of more than SIFTED_CHARS left, those of which
any word does. Up to SENT_CHARS of the others, which are summed
before, a word trie is sent to all tasks, and each text is walked once. Beyond, forms are
joined: the words of the texts meet the first words of forms, and what follows
meets the whole forms; then the leftmost longest are taken among each text's matches.
Texts are dealt evenly first, as a table may come in one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.sources.shared import cut

#: Forms of at most so many characters in all are sent to every task.
SENT_CHARS = 16 << 20
#: More characters of forms than these are sifted by all of their words.
SIFTED_CHARS = 1 << 20
#: Texts whose words are handed on at once.
TEXTS_AT_ONCE = 500
WORD = r"[\p{L}\p{N}_#]+"
#: The same for Python, and white space as the forms have it.
WORDS, GAP = re.compile(r"[\w#]+"), re.compile(r"[ \t\n\x0b\f\r]+")
SPAN = "message_id long, start int, end int, form string"


def as_form(name: Column) -> Column:
    """A name in lower case, with one blank between its words."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def _every_form(entities: DataFrame) -> DataFrame:
    """(form, n_words, entity_id, type) of every name and alias, repeated ones too."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entities.select("id", "type", F.explode(every).alias("form"))
    plain = rows.withColumn("form", as_form(F.col("form"))).filter(F.rlike("form", F.lit(f"^{WORD}(?: {WORD})*$")))
    return plain.select("form", F.size(F.split("form", " ")).alias("n_words"), F.col("id").alias("entity_id"), "type")


def forms(entities: DataFrame) -> DataFrame:
    """(form, n_words, entity_id, type) of the names and aliases of entities (id, name, type, aliases): distinct, lower case, one blank between words."""
    return _every_form(entities).distinct()


def _owned(entities: DataFrame) -> DataFrame:
    """(form, n_words, type, entity_id, last): each form once a type, with the least and the greatest id that it names."""
    return _every_form(entities).groupBy("form", "n_words", "type").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("last"))


def _once(owned: DataFrame) -> DataFrame:
    """The same with each form once, and the least of its types."""
    return owned.groupBy("form", "n_words").agg(F.min("type").alias("type"), F.min("entity_id").alias("entity_id"), F.max("last").alias("last"))


def _next_to(text: str, found: list[tuple[int, int, str]], j: int) -> bool:
    """Whether white space alone is between word j and the one before it."""
    return j < len(found) and GAP.fullmatch(text, found[j - 1][1], found[j][0]) is not None


def _words(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0].lower()) for m in WORDS.finditer(text)]


class _Trie:
    """Words of forms as nested tables; the key "" ends a form."""

    def __init__(self, forms: list[str]):
        self.root: dict = {}
        for f in forms:
            node = self.root
            for w in f.split(" "):
                node = node.setdefault(w, {})
            node[""] = f

    def spans(self, text: str) -> Iterator[tuple[int, int, str]]:
        found = _words(text)
        k = 0
        while k < len(found):
            node, best, j = self.root.get(found[k][2]), None, k
            while node is not None:
                if "" in node:
                    best = (j, node[""])
                j += 1
                if not _next_to(text, found, j):
                    break
                node = node.get(found[j][2])
            if best is not None:
                yield found[k][0], found[best[0]][1], best[1]
                k = best[0]
            k += 1


def _dealt(messages: DataFrame) -> DataFrame:
    """id and content of the messages with both, in as many even parts as a shuffle has."""
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return messages.filter("id is not null and content <> ''").select("id", "content").repartition(parts)


def _said(texts: DataFrame) -> DataFrame:
    """The words that stand in texts, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": list({w.lower() for text in b["content"] for w in WORDS.findall(text)})}, dtype=object)

    return texts.select("content").mapInPandas(run, "word string").distinct()


def _met(known: DataFrame, said: DataFrame) -> DataFrame:
    """The forms of which the longest word is one of said: what most forms have to themselves."""
    longest = F.array_max(F.transform(F.split("form", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return known.withColumn("word", F.when(F.col("n_words") == 1, F.col("form")).otherwise(longest)).join(said, "word", "left_semi").drop("word")


def _sifted(known: DataFrame, said: DataFrame) -> DataFrame:
    """The forms whose words are all in said."""
    parts = F.array_distinct(F.split("form", " "))
    each = known.select("form", F.size(parts).alias("n"), F.explode(parts).alias("word"))
    whole = each.join(said, "word").groupBy("form").agg(F.count("*").alias("met"), F.first("n").alias("n")).filter("met = n")
    return known.join(whole.select("form"), "form", "left_semi")


def _walked(texts: DataFrame, known: DataFrame) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast([r["form"] for r in known.select("form").collect()])  # at most SENT_CHARS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = _Trie(sent.value)
        for b in batches:
            rows = [(i, *span) for i, text in zip(b["id"], b["content"], strict=True) for span in trie.spans(text)]
            yield pd.DataFrame(rows, columns=["message_id", "start", "end", "form"])

    return texts.mapInPandas(run, SPAN)


def _joined(texts: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """The same by joins: words with first words, then phrases with forms of at most `most` words, then a fold over each text's matches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), TEXTS_AT_ONCE):
                some, rows = b.iloc[s : s + TEXTS_AT_ONCE], []
                for row, i, text in zip(some["row"], some["id"], some["content"], strict=True):
                    found = _words(text)
                    for k in range(len(found)):
                        upto = k + 1
                        while upto - k < most and _next_to(text, found, upto):
                            upto += 1
                        rows.append((row, i, found[k][0], found[k][2], [w for _, _, w in found[k:upto]], [e for _, e, _ in found[k:upto]]))
                yield pd.DataFrame(rows, columns=["row", "message_id", "start", "word", "words", "ends"])

    starts = known.select(F.split("form", " ")[0].alias("word"), F.col("n_words").alias("n")).distinct()
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    at = numbered.mapInPandas(run, "row long, message_id long, start int, word string, words array<string>, ends array<int>")
    near = at.join(starts, "word").filter(F.size("ends") >= F.col("n"))
    met = near.select("row", "message_id", "start", F.get("ends", F.col("n") - 1).alias("end"), F.array_join(F.slice("words", F.lit(1), F.col("n")), " ").alias("form"))
    found = met.join(known.select("form"), "form", "left_semi")
    return found.repartition("row").sortWithinPartitions("row", "start", F.desc("end")).mapInPandas(_leftmost, SPAN)


def _leftmost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text's matches in order, the longer first, those that begin where the last one taken has ended, or later."""
    last, upto = None, 0
    for b in batches:
        kept = []
        for i, (row, start, end) in enumerate(zip(b["row"].tolist(), b["start"].tolist(), b["end"].tolist(), strict=True)):
            if row != last or start >= upto:
                kept.append(i)
                last, upto = row, end
        yield b.iloc[kept][["message_id", "start", "end", "form"]]


def _size(known: DataFrame):
    return known.agg(F.coalesce(F.sum(F.length("form")), F.lit(0)).alias("n"), F.max("n_words").alias("most")).first()


def _found(messages: DataFrame, entities: DataFrame, sent_chars: int) -> tuple[DataFrame, DataFrame]:
    """The spans in messages, and the forms (see _once) that were looked for."""
    texts = _dealt(messages)
    known = cut(_once(_met(_owned(entities), _said(texts))))
    whole = _size(known)
    if whole["n"] > min(sent_chars, SIFTED_CHARS):
        known = cut(_sifted(known, _said(texts)))
        whole = _size(known)
    return _walked(texts, known) if whole["n"] <= sent_chars else _joined(texts, known, whole["most"]), known


def spans(messages: DataFrame, entities: DataFrame, sent_chars: int = SENT_CHARS) -> DataFrame:
    """(message_id, start, end, form) of every surface form in messages (id, content), in code points, end exclusive."""
    return _found(messages, entities, sent_chars)[0]


def _linked(found: DataFrame, known: DataFrame, confidence: float) -> DataFrame:
    return found.join(known.filter("entity_id = last"), "form").select("message_id", "entity_id", "type", "start", "end", F.lit(confidence).alias("confidence"))


def link(found: DataFrame, entities: DataFrame, confidence: float = 1.0) -> DataFrame:
    """(message_id, entity_id, type, start, end, confidence): the spans whose form belongs to one entity alone."""
    return _linked(found, _once(_owned(entities)), confidence)


def mentions(messages: DataFrame, entities: DataFrame, confidence: float = 1.0, sent_chars: int = SENT_CHARS) -> DataFrame:
    """MENTIONS rows of messages (id, content) and entities (id, name, type, aliases).

    A null text or id has none. Repeated message rows have rows of their own.
    """
    return _linked(*_found(messages, entities, sent_chars), confidence)


def explicit(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(message_id, entity_id, how) of refs (message_id, entity_id, name, type), each by the first that it has.

    An id must exist; a name with a type takes the least entity with that form and
    type; a name alone must belong to one entity only. Other refs link nothing.
    """
    known = forms(entities)
    asked = refs.select("message_id", F.col("entity_id").alias("ref"), as_form(F.col("name")).alias("form"), F.col("type").alias("kind"))
    by_id = asked.filter("ref is not null").join(entities.select(F.col("id").alias("ref")).distinct(), "ref").select("message_id", F.col("ref").alias("entity_id"), F.lit("id").alias("how"))
    typed = known.groupBy("form", F.col("type").alias("kind")).agg(F.min("entity_id").alias("entity_id"))
    by_type = asked.filter("ref is null and kind is not null").join(typed, ["form", "kind"]).select("message_id", "entity_id", F.lit("typed").alias("how"))
    alone = known.groupBy("form").agg(F.min("entity_id").alias("entity_id"), F.count_distinct("entity_id").alias("n")).filter("n = 1")
    by_form = asked.filter("ref is null and kind is null").join(alone, "form").select("message_id", "entity_id", F.lit("surface").alias("how"))
    return by_id.unionAll(by_type).unionAll(by_form).distinct()


def without(messages: DataFrame, found: DataFrame) -> DataFrame:
    """The messages (id, ...) that mention nothing."""
    return messages.join(found.select(F.col("message_id").alias("id")).distinct(), "id", "left_anti")


def by_conversation(found: DataFrame, messages: DataFrame) -> DataFrame:
    """found with the session_id and conversation_id of its message."""
    return found.join(messages.select(F.col("id").alias("message_id"), "session_id", "conversation_id"), "message_id")


def key_entities(found: DataFrame, entities: DataFrame, messages: DataFrame, most: int = 10) -> DataFrame:
    """Of each session its `most` entities with the most messages that mention them: session_id, name, type, mentions."""
    edges = by_conversation(found.select("message_id", "entity_id").distinct(), messages)
    named = entities.select(F.col("id").alias("entity_id"), "name", "type")
    counted = edges.groupBy("session_id", "entity_id").agg(F.count("*").alias("n")).join(named, "entity_id").groupBy("session_id", "name", "type").agg(F.sum("n").alias("mentions"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("mentions"), "name", "type"))
    return counted.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def extraction_stats(messages: DataFrame, found: DataFrame) -> DataFrame:
    """By session: messages, those processed (with a text), entities found and links made."""
    edges = by_conversation(found.select("message_id", "entity_id").distinct(), messages)
    made = edges.groupBy("session_id").agg(F.count("*").alias("links"), F.count_distinct("entity_id").alias("entities"))
    seen = messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.count(F.when(F.length("content") > 0, 1)).alias("processed"))
    return seen.join(made, "session_id", "left").select("session_id", "messages", "processed", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("links", F.lit(0)).alias("links"))


def locations(found: DataFrame, entities: DataFrame, messages: DataFrame) -> DataFrame:
    """LOCATION entities with the conversations that mention them, each once, in the order of their first mention."""
    places = entities.filter("type = 'LOCATION'").select(F.col("id").alias("entity_id"), "name", "subtype")
    met = by_conversation(found.filter("type = 'LOCATION'").select("message_id", "entity_id"), messages)
    first = met.groupBy("entity_id", "conversation_id").agg(F.min("message_id").alias("first"))
    listed = first.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "conversation_id"))), lambda x: x["conversation_id"]).alias("conversations"))
    return places.join(listed, "entity_id", "left").withColumn("conversations", F.coalesce("conversations", F.array().cast("array<long>")))


def applies_to(preferences: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, stubs): APPLIES_TO edges of preferences (id, entity_id, name, type), and the entities that they need.

    An id comes before a name with a type, and that before a name. A name that no
    entity has makes a stub (name, type; OBJECT without one); its id is a negative hash of both.
    """
    refs = preferences.select(F.col("id").alias("message_id"), "entity_id", "name", "type")
    met = explicit(refs, entities)
    open_refs = refs.filter("entity_id is null and name is not null").join(met.select("message_id").distinct(), "message_id", "left_anti")
    kind = F.coalesce("type", F.lit("OBJECT"))
    stub = -F.shiftrightunsigned(F.xxhash64(as_form(F.col("name")), kind), 1) - 1
    made = open_refs.select("message_id", stub.alias("entity_id"), as_form(F.col("name")).alias("name"), kind.alias("type"))
    edges = met.unionAll(made.select("message_id", "entity_id", F.lit("stub").alias("how"))).withColumnRenamed("message_id", "preference_id")
    return edges, made.select(F.col("entity_id").alias("id"), "name", "type").distinct()


def session_context(messages: DataFrame, found: DataFrame, entities: DataFrame, preferences: DataFrame, most: int, since) -> DataFrame:
    """By session: its last messages' ids (latest first), the names that they mention, and the user's preferences from `since` on.

    preferences has user_identifier, category and valid_from; lists are sorted.
    """
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("id")))
    last = messages.withColumn("place", place).filter(F.col("place") <= most).select("session_id", "user_identifier", "place", "id")
    named = found.select("message_id", "entity_id").distinct().join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").select(F.col("message_id").alias("id"), "name")
    names = last.join(named, "id").groupBy("session_id").agg(F.array_sort(F.collect_set("name")).alias("entities"))
    recent = preferences.filter(F.col("valid_from") >= since).select("user_identifier", "category").distinct()
    liked = last.select("session_id", "user_identifier").distinct().join(recent, "user_identifier").groupBy("session_id").agg(F.array_sort(F.collect_set("category")).alias("preferences"))
    none = F.array().cast("array<string>")
    ids = last.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("messages"))
    out = ids.join(names, "session_id", "left").join(liked, "session_id", "left")
    return out.select("session_id", "messages", F.coalesce("entities", none).alias("entities"), F.coalesce("preferences", none).alias("preferences"))


def reasoning_links(messages: DataFrame, steps: DataFrame) -> DataFrame:
    """Edges (kind, source, target) between traces and messages of one conversation (steps: id, trace_id, conversation_id, turn).

    HAS_TRACE from conversation to trace, INITIATED_BY from trace to the message of its first step,
    TRIGGERED_BY from each tool call to the latest message at or before its turn.
    """
    trace = steps.groupBy("trace_id").agg(F.min("conversation_id").alias("conversation_id"), F.min_by("turn", "id").alias("turn"))
    has = trace.select(F.lit("HAS_TRACE").alias("kind"), F.col("conversation_id").alias("source"), F.col("trace_id").alias("target"))
    turns = messages.select("conversation_id", "turn", F.col("id").alias("message_id"))
    # A message answers for the turns up to the next one of its conversation.
    upto = F.lead("turn").over(Window.partitionBy("conversation_id").orderBy("turn"))
    ranges = turns.select(F.col("conversation_id").alias("_c"), F.col("turn").alias("_from"), upto.alias("_upto"), "message_id")
    within = (F.col("conversation_id") == F.col("_c")) & (F.col("turn") >= F.col("_from")) & (F.col("_upto").isNull() | (F.col("turn") < F.col("_upto")))
    started = trace.join(ranges, within).select(F.lit("INITIATED_BY").alias("kind"), F.col("trace_id").alias("source"), F.col("message_id").alias("target"))
    called = steps.join(ranges, within).select(F.lit("TRIGGERED_BY").alias("kind"), F.col("id").alias("source"), F.col("message_id").alias("target"))
    return has.unionAll(started).unionAll(called)
