"""Neighbours by inverted lists and the cascade on them, against plain Python."""

from __future__ import annotations

import numpy as np
import pytest

from memloom.operators import cascade as ca
from memloom.operators import nearest as ne

SCHEMA = "id long, type string, name string, v array<double>, extra int"


def brute(asked, rows, k):
    out = set()
    for q in asked:
        if q[3] is None or not np.linalg.norm(q[3]):
            continue
        near = []
        for r in rows:
            if r[1] == q[1] and r[0] != q[0] and r[3] is not None and np.linalg.norm(r[3]):
                near.append((-round(float(np.dot(q[3], r[3]) / np.linalg.norm(q[3]) / np.linalg.norm(r[3])), 9), r[0]))
        out |= {(q[0], i, n + 1) for n, (_, i) in enumerate(sorted(near)[:k])}
    return out


def points(n, seed=5):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(6, 8))
    kind = np.where(rng.random(n) < 0.8, "hot", "cold")
    return [(i, str(kind[i]), f"n{i}", [float(x) for x in heads[i % 6] + rng.normal(size=8) * 0.3], 1) for i in range(n)]


def test_exact_neighbours_of_clustered_rows_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ne, "SHARE", 0.1)  # few lists at first, so the bounds decide
    rows = points(600) + [(900, "hot", "none", None, 1), (901, "hot", "zero", [0.0] * 8, 1), (902, None, "no type", [1.0] * 8, 1), (903, "alone", "x", [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["id"], r["other"], r["rank"]) for r in ne.neighbours(df, df, 4, exact=True).collect()}
    assert got == brute([r for r in rows if r[1] != "alone" and r[1]], rows, 4)


def test_more_neighbours_than_rows_and_empty_tables(spark):
    rows = points(9)
    df, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert {(r["id"], r["other"], r["rank"]) for r in ne.neighbours(df, df, 50, exact=True).collect()} == brute(rows, rows, 50)
    assert ne.neighbours(none, df, 3, exact=True).count() == 0 and ne.neighbours(df, none, 3, exact=True).count() == 0


def test_equal_vectors_take_the_smaller_id(spark):
    rows = [(i, "t", f"n{i}", [1.0, 2.0], 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["id"], r["other"]) for r in ne.neighbours(df, df, 2, exact=True).collect()}
    assert got == {(i, j) for i in range(40) for j in [x for x in (0, 1, 2) if x != i][:2]}


def test_cascade_by_vectors_equals_all_pairs(spark):
    names = ["Ada Lovelace", "Grace Hopper", "Alan Turing", "Northwind Traders", "Edsger Dijkstra", "Barbara Liskov"]
    rng = np.random.default_rng(2)
    v = [[float(x) for x in rng.normal(size=6)] for _ in names]
    entities = [(i, "PERSON", n, v[i], 0) for i, n in enumerate(names)]
    said = ["ada lovelace", "Grace Hoper", "Turing", "Northwind", "Somebody Else", "B. Liskov"]
    mentions = [(100 + i, "PERSON", n, [a + 0.2 for a in v[i]] if i != 4 else [-x for x in v[0]], 0) for i, n in enumerate(said)] + [(200, "PERSON", "Ada Lovelace", None, 0), (201, "PERSON", "Nobody", None, 0)]

    def keyed(rows):
        return spark.createDataFrame(rows, SCHEMA).withColumn("key", ca.rs.name_key(ca.F.col("name"), ca.F.col("type")))

    got = {r["mention"]: (r["entity"], r["action"], r["match"]) for r in ca.cascaded_by_vectors(keyed(mentions), keyed(entities), 6).collect()}
    cos = [(m[0], e[0], float(np.dot(m[3], e[3]) / np.linalg.norm(m[3]) / np.linalg.norm(e[3]))) for m in mentions if m[3] for e in entities]
    pairs = spark.createDataFrame(cos, "m long, e long, vector double")
    a = keyed(mentions).selectExpr("id m", "type", "name name_a", "key a")
    b = keyed(entities).selectExpr("id e", "name name_b", "key b")
    best = {}
    for r in ca.judged(pairs.join(a, "m").join(b, "e")).collect():
        best[r["m"]] = max(best.get(r["m"], (-1.0, 0, "")), (r["score"], -r["e"], r["match"]))
    for m in mentions:
        if m[3] is None:
            continue
        score, e, match = best[m[0]]
        want = (-e, "merged", match) if score >= ca.rs.AUTO else (-e, "review", match) if score >= ca.rs.REVIEW else (None, "created", None)
        assert got[m[0]] == want, m
    assert got[200] == (0, "merged", "exact") and got[201] == (None, "created", None)
    assert {a for _, a, _ in got.values()} == {"merged", "review", "created"}
    assert got[100][2] == "exact" and got[101][2] == "both"
