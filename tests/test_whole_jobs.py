"""Jobs done whole: no block, id range, page or length is left out."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

from memloom.operators import reasoning
from memloom.operators import resolution as rs
from memloom.plans import registry

SF = "/root/testdata/sf0.01"


def test_decisions_keep_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(rs, "SHARE", 40)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    entities = [(i, "ORG" if i % 5 else "PER", " ".join(["acme", *rng.choices(words, k=rng.randint(1, 7))])) for i in range(300)]
    mentions = [(1000 + i, t, k if i % 3 else " ".join(k.split()[:-1])) for i, t, k in entities] + [(5000, "ORG", "nothing alike"), (5001, "ORG", None)]

    def score(a, b):
        x, y = set(a.split(" ")), set(b.split(" "))
        return 1.0 if a == b else 2 * len(x & y) / (len(x) + len(y))

    want = {}
    for m, kind, key in mentions:
        near = [(score(key, k), -e) for e, t, k in entities if key and t == kind and (k.split(" ")[0] == key.split(" ")[0] or k.split(" ")[-1] == key.split(" ")[-1])]
        best, e = max(near, default=(None, None))
        action = "merged" if best and best >= rs.AUTO else "review" if best and best >= rs.REVIEW else "created"
        want[m] = (None if action == "created" else -e, None if best is None else round(best, 6), action)
    schema = "id long, type string, key string"
    got = rs.resolved(spark.createDataFrame(mentions, schema), spark.createDataFrame(entities, schema)).collect()
    assert len(got) == len(mentions)
    assert {r["mention"]: (r["entity"], r["score"], r["action"]) for r in got} == want
    assert sum(x[2] == "merged" for x in want.values()) >= 200


def table(name):
    return duckdb.sql(f"SELECT * FROM read_parquet('{SF}/{name}.parquet')")


def test_whole_tool_calls_cover_all_events(spark):
    ids = {r[0] for r in table("events").select("event_id").fetchall()}
    role = {i: "assistant" if i % 4 == 0 else "tool" if i % 2 else "user" for i in ids}
    calls = {i: (i + 1, i + 2 + i % 3) for i in ids if role[i] == "assistant"}
    whole = {i for i, c in calls.items() if all(role.get(x) == "tool" for x in c)}
    answered = {x for i in whole for x in calls[i]}
    want = {(i, r) for i, r in role.items() if r == "user" or i in whole or (r == "tool" and i in answered)}
    got = [tuple(r) for r in registry.queries()["VEC-10_whole_tool_calls"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and max(got)[0] > 9000


def test_summary_entities_cover_all_messages(spark):
    words = Counter(w for (text,) in table("conversations").select("text").fetchall() for w in re.findall(r"\w+", text or "") if re.fullmatch("[A-Z][a-z]{3,}", w))
    got = [tuple(r) for r in registry.queries()["ST-17_summary_entities"](spark, SF).collect()]
    assert got == sorted(words.items(), key=lambda x: (-x[1], x[0]))[:10]


def test_traces_keep_all_steps(spark):
    steps = spark.range(2503).selectExpr(
        "id", "id div 2500 AS trace_id", "if(id % 7 = 0, 'a', 'b') AS tool_name", "timestamp_seconds(1000000 + 5 * id) AS ts", "if(id % 3 = 0, 'error', 'success') AS status"
    )
    got = sorted(reasoning.with_steps(steps).collect(), key=lambda r: (r["trace_id"], r["page"]))
    assert [(r["trace_id"], r["page"], len(r["steps"])) for r in got] == [(0, 0, 1000), (0, 1, 1000), (0, 2, 500), (1, 0, 3)]
    flat = [(x["step_number"], x["tool_name"], x["status"]) for r in got for x in r["steps"]]
    assert flat == [(i % 2500 + 1, "b" if i % 7 else "a", "success" if i % 3 else "error") for i in range(2503)]


def test_touched_edges_and_neighbours_are_whole(spark):
    customers = {r[0] for r in table("customer").select("c_custkey").fetchall()}
    steps = [r[0] for r in table("events").select("event_id").fetchall()]
    queries = registry.queries()
    known = [tuple(r) for r in queries["RE-12_touched_entities"](spark, SF).collect()]
    assert sorted(known) == sorted((i, i % 1600 + 1) for i in steps if i % 1600 + 1 in customers)
    every = [tuple(r) for r in queries["RE-12_all_edges"](spark, SF).collect()]
    number = {i: i % (max(customers) + 400) + 1 for i in steps}
    assert sorted(every, key=str) == sorted(((i, f"Customer#{n:09}", n if n in customers else None) for i, n in number.items()), key=str)
    assert any(r[2] is None for r in every) and any((r[2] or 0) > 1200 for r in every)
    edges = sum(len(table(t).fetchall()) for t in ("customer", "supplier", "nation"))
    assert queries["LT-19_all_neighbours"](spark, SF).count() == 2 * edges


def test_merge_chains_of_any_length(spark):
    from memloom.operators.provenance import final_targets

    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "source long, target long")
    assert {(r.source, r.target) for r in final_targets(chain).collect()} == {(i, 70) for i in range(70)}
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "source long, target long")
    with pytest.raises(ValueError, match="cycle"):
        final_targets(ring, rounds=4)
