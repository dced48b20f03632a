"""Bounded paths with a hub and odd edges, relations of names, and preferences in other scripts, against plain Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from memloom.operators import graph as g
from memloom.operators import preferences as pr
from memloom.operators import resolution as rs

EDGES = "src long, dst long, type string, seq long"


def walk(edges, start, hops):
    out, front = [], [((start,), (), ())]
    for n in range(1, hops + 1):
        grown = []
        for nodes, types, used in front:
            for a, b, t, k in edges:
                if k in used or None in (a, b):
                    continue
                for x, y in {(a, b), (b, a)}:
                    if x == nodes[-1]:
                        grown.append(((*nodes, y), (*types, t), (*used, k)))
        front = grown
        out += [(n, start, p[0], p[2], p[1]) for p in front]
    return out


def test_paths_reuse_no_edge_and_the_first_ones_come_first(spark):
    edges = [(0, i, "A", i) for i in range(1, 30)] + [(1, 2, "B", 50), (1, 2, "B", 51), (2, 3, "B", 52), (4, 4, "B", 53), (None, 3, "A", 54)]
    df, starts = spark.createDataFrame(edges, EDGES), spark.createDataFrame([(1,), (4,), (99,), (None,)], "id long")
    want = sorted(p for s in (1, 4) for p in walk(edges, s, 3))
    got = [(r["hops"], r["start"], tuple(r["nodes"]), tuple(r["types"])) for r in g.paths(df, starts, 3).collect()]
    assert sorted(got) == sorted((h, s, n, t) for h, s, n, _, t in want)
    for limit in (1, 7, 40):
        first = [(r["hops"], r["start"], tuple(r["nodes"]), tuple(r["types"])) for r in g.paths(df, starts, 3, limit=limit).collect()]
        assert sorted(first) == sorted((h, s, n, t) for h, s, n, _, t in want[:limit])
    used = {(s, k) for _, s, _, ks, _ in want for k in ks}
    around = {(r["start"], r["src"], r["dst"], r["type"]) for r in g.edges_around(df, starts.filter("id is not null"), 3).collect()}
    assert around == {(s, *edges[[e[3] for e in edges].index(k)][:3]) for s, k in used}


def test_paths_of_no_edges(spark):
    none, starts = spark.createDataFrame([], EDGES), spark.createDataFrame([(1,)], "id long")
    assert g.paths(none, starts, 2).count() == 0 and g.paths(none, starts, 2, limit=5).count() == 0 and g.edges_around(none, starts, 2).count() == 0


@pytest.mark.parametrize(
    ("kind", "a", "b", "want"),
    [
        ("ORGANIZATION", "IT", "Isabel Turner", (False, False, False)), ("ORGANIZATION", "US", "Ursula Schmidt", (False, False, False)),
        ("PERSON", "ITS", "Isabel Turner Smith", (False, False, False)), ("ORGANIZATION", "N.W.L.", "North West Lines", (False, False, True)),
        ("ORGANIZATION", "North West Lines", "NWL", (False, False, True)), ("LOCATION", "Kansas City", "Kansas", (True, True, False)),
        ("LOCATION", "Kansas", "Kansas City", (True, True, False)), ("PERSON", "Turner", "Isabel Turner", (False, True, False)),
        ("PERSON", "Turner", "Turner", (False, False, False)), (None, "ABC", None, (False, False, False)), ("ORG", "nwl", "north west lines", (False, False, False)),
    ],
)
def test_relations_of_names(spark, kind, a, b, want):
    rows = spark.createDataFrame([(kind, a, b)], "type string, a string, b string").withColumns({f"k{c}": rs.name_key(F.col(c), F.col("type")) for c in "ab"})
    got = rs.name_relations(F.col("type"), F.col("a"), F.col("ka"), F.col("b"), F.col("kb"))
    assert tuple(rows.select(*[c.alias(str(i)) for i, c in enumerate(got)]).first()) == want


def test_words_of_all_scripts_state_preferences(spark):
    rows = spark.createDataFrame([(1, "I am a café person you know"), (2, "Überall sagt man: i love straße kunst"), (3, None), (4, "")], "id long, content string")
    got = {r["id"]: (r["sentiment"], r["preference"]) for r in pr.preferences(rows).collect()}
    assert got == {1: ("positive", "café"), 2: ("positive", "straße kunst")}
