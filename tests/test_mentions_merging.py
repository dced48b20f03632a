"""Mentions against a walk by hand, merges of every kind of edge on small tables, and queries that must not be empty."""

from __future__ import annotations

import random
import re

import pytest

from memloom.operators import mentions as mn
from memloom.operators import merging as mg
from memloom.operators import provenance as pv
from memloom.plans import mentions as mention_plans
from memloom.plans import merging as merging_plans

SF = "/root/testdata/sf0.001"
ENTITY = "id long, name string, type string, aliases array<string>"


def brute_spans(text: str, forms: set[str]) -> list[tuple[int, int, str]]:
    words = [(m.start(), m.end()) for m in re.finditer(r"[\w#]+", text)]
    out, k = [], 0
    while k < len(words):
        best = None
        for j in range(k, min(len(words), k + 6)):  # no form is longer
            if j > k and not re.fullmatch(r"\s+", text[words[j - 1][1] : words[j][0]]):
                break
            form = " ".join(text[a:b].lower() for a, b in words[k : j + 1])
            if form in forms:
                best = (j, form)
        if best:
            out.append((words[k][0], words[best[0]][1], best[1]))
            k = best[0]
        k += 1
    return out


def test_both_ways_equal_a_walk_by_hand(spark):
    rng = random.Random(11)
    words = ["a", "b", "c", "Dé", "e#1"]
    named = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), "X", [rng.choice(words) + "  B"] if i % 3 == 0 else None) for i in range(20)]
    texts = [(i, "".join(rng.choice([*words, ",", " ", "\n", "x"]) + rng.choice([" ", "  ", ""]) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (None, "a b"), (1002, "a b c " * 2000), (5, "a Dé"), (5, "a Dé")]
    entities, messages = spark.createDataFrame(named, ENTITY), spark.createDataFrame(texts, "id long, content string")
    forms = {" ".join(n.lower().split()) for _, name, _, more in named for n in (name, *(more or []))}
    want = sorted((i, *s) for i, t in texts if i is not None and t for s in brute_spans(t, forms))
    for sent in (mn.SENT_CHARS, 0):
        assert sorted(map(tuple, mn.spans(messages, entities, sent).collect())) == want
    assert mn.spans(messages, entities.limit(0)).count() == 0 and mn.spans(messages.limit(0), entities, 0).count() == 0


def test_texts_are_dealt_and_forms_are_sifted(spark, monkeypatch):
    named = [(i, f"Name#{i} of Place", "X", [f"name#{i}"]) for i in range(200)]
    texts = [(i, f"of place name#{i}  OF\tplace, name#{i + 1} of\u00a0Place") for i in range(0, 400, 4)]
    entities, messages = spark.createDataFrame(named, ENTITY), spark.createDataFrame(texts, "id long, content string").coalesce(1)
    want = sorted((i, *s) for i, t in texts for s in ((9, 9 + t.index(",") - 9, f"name#{i} of place"), (t.index(",") + 2, t.rindex(" "), f"name#{i + 1}")) if int(s[2].split(" ")[0][5:]) < 200)
    found = mn.spans(messages, entities)
    assert found.rdd.getNumPartitions() > 1  # a table in one piece is no single task
    assert sorted(map(tuple, found.collect())) == want
    monkeypatch.setattr(mn, "SIFTED_CHARS", 10)
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, x: sent.append(x) or broadcast(sc, x))
    for most in (mn.SENT_CHARS, 0):
        assert sorted(map(tuple, mn.spans(messages, entities, most).collect())) == want
    assert len(sent) == 1 and 100 <= len(sent[0]) < 250  # of 400 forms, those whose words are in the texts


def test_entities_are_read_once(spark, monkeypatch):
    named = [(i, f"Name#{i} of Place", "X", ["place", f"NAME#{i}"]) for i in range(200)] + [(900, "Place", "Y", None), (901, " Lone\t\n Place ", "Y", None)]
    texts = [(i, f"name#{i} of place, lone PLACE") for i in range(0, 400, 4)]
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            rows.add(len(b))
            yield b

    entities = spark.createDataFrame(named, ENTITY).mapInPandas(seen, ENTITY)
    messages = spark.createDataFrame(texts, "id long, content string")
    want = sorted([(i, i) for i, _ in texts if i < 200] + [(i, 901) for i, _ in texts])  # the shared form names none
    for most in (mn.SIFTED_CHARS, 10):
        monkeypatch.setattr(mn, "SIFTED_CHARS", most)
        before = rows.value
        assert sorted((r["message_id"], r["entity_id"]) for r in mn.mentions(messages, entities).collect()) == want
        assert rows.value - before == len(named)


def test_shared_forms_link_nothing(spark):
    entities = spark.createDataFrame([(1, "Ann Lee", "PERSON", ["Ann"]), (2, "Ann Ray", "PERSON", ["Ann"]), (3, "Rome", "LOCATION", None)], ENTITY)
    messages = spark.createDataFrame([(1, "Ann met ann lee in ROME."), (2, "Ann")], "id long, content string")
    got = sorted((r["message_id"], r["entity_id"], r["start"], r["end"]) for r in mn.mentions(messages, entities).collect())
    assert got == [(1, 1, 8, 15), (1, 3, 19, 23)]
    assert [r["id"] for r in mn.without(messages, mn.mentions(messages, entities)).collect()] == [2]


def test_explicit_mentions_by_id_type_and_form(spark):
    entities = spark.createDataFrame([(1, "Paris", "LOCATION", None), (2, "Paris", "PERSON", None), (3, "Rome", "LOCATION", None)], ENTITY)
    refs = [(10, 1, None, None), (11, 9, None, None), (12, None, "paris", "PERSON"), (13, None, "Paris", None), (14, None, " rome ", None), (15, None, "oslo", None), (16, None, None, None)]
    df = spark.createDataFrame(refs, "message_id long, entity_id long, name string, type string")
    assert sorted(map(tuple, mn.explicit(df, entities).collect())) == [(10, 1, "id"), (12, 2, "typed"), (14, 3, "surface")]
    edges, stubs = mn.applies_to(df.withColumnRenamed("message_id", "id"), entities)
    assert {r["preference_id"]: r["how"] for r in edges.collect()} == {10: "id", 12: "typed", 13: "stub", 14: "surface", 15: "stub"}
    assert sorted((r["name"], r["type"]) for r in stubs.collect()) == [("oslo", "OBJECT"), ("paris", "OBJECT")]


def test_merge_of_every_kind(spark):
    merges = pv.final_targets(spark.createDataFrame([(3, 2), (2, 1), (9, 8)], "source long, target long"))
    entities = spark.createDataFrame([(1, "A", "X", ["a"]), (2, "B", "X", None), (3, "C", "X", ["B", "c"]), (8, "H", "X", None), (9, "H", "X", ["h"])], ENTITY)
    tables = {
        "MENTIONS": spark.createDataFrame([(1, 100, 0.5), (2, 100, 0.9), (3, 101, 0.4), (2, 101, 0.3), (7, 102, 1.0)], "entity_id long, message_id long, confidence double"),
        "SAME_AS": spark.createDataFrame([(1, 3, 0.9), (3, 7, 0.8), (7, 2, 0.7), (1, 9, 0.6)], "a long, b long, confidence double"),
        "RELATED_TO": spark.createDataFrame(
            [(1, "R", 7, 0.5, 2, True, [10, 11], ["x"]), (3, "R", 7, 0.9, 3, False, [11, 12], None), (2, "R", 1, 0.9, 1, True, [13], ["y"]), (7, "R", 9, 0.1, 4, True, [14], ["z"])],
            "source long, type string, target long, confidence double, support long, derived boolean, source_message_ids array<long>, evidence array<string>",
        ),
    }
    after, moved = mg.merge(entities, tables, merges)
    assert sorted(map(tuple, moved["MENTIONS"].collect()), key=str) == [(1, 100, 0.5, None), (1, 101, 0.3, 2), (7, 102, 1.0, None)]
    assert sorted(map(tuple, moved["SAME_AS"].collect()), key=str) == [(1, 7, 0.7, 2), (1, 8, 0.6, 9)]
    related = {(r["source"], r["target"]): r for r in moved["RELATED_TO"].collect()}
    assert set(related) == {(1, 7), (7, 8)}
    r = related[1, 7]
    assert (r["confidence"], r["support"], r["derived"], r["source_message_ids"], r["evidence"], r["migrated_from"]) == (0.9, 5, False, [10, 11, 12], ["x"], None)
    assert related[7, 8]["migrated_from"] == 9
    flags = {r["id"]: (r["merged_into"], r["aliases"]) for r in after.collect()}
    assert flags == {1: (None, ["B", "C", "a", "c"]), 2: (1, []), 3: (1, ["B", "c"]), 8: (None, ["h"]), 9: (8, ["h"])}
    plain = {k: t.drop("migrated_from") for k, t in moved.items()}
    assert all(r["n"] == 0 for r in mg.dangling(plain, merges).collect())
    again, same = mg.merge(after, plain, merges)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, after.select(*again.columns).collect()), key=str)
    assert same["RELATED_TO"].drop("migrated_from").exceptAll(plain["RELATED_TO"]).count() == 0


@pytest.mark.parametrize("name", ["extracted_from", "applies_to", "touched", "same_as", "related_lists"])
@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_partitions_of_merged_edges_follow_their_rows(spark, monkeypatch, name, sent):
    query = merging_plans.QUERIES[f"DD-05_merged_{name}"]
    want = sorted(map(str, query(spark, SF).collect()))
    monkeypatch.setattr(mg, "ROWS_A_PART", 100, raising=False)
    monkeypatch.setattr(mg, "SENT_MERGES", sent, raising=False)
    parts = query(spark, SF).rdd.glom().collect()
    assert sorted(str(r) for p in parts for r in p) == want
    assert max(map(len, parts)) < 250  # whatever the session's number of partitions is


@pytest.mark.parametrize("module", [mention_plans, merging_plans])
def test_no_query_is_empty(spark, module):
    for name, query in module.QUERIES.items():
        assert not query(spark, SF).isEmpty(), name
