"""Folded relations against plain Python, and how often their rows are dealt."""

from __future__ import annotations

import random

from memloom.operators import longterm as lt

OBS = "source long, type string, target long, confidence double, derived boolean, message_id long, evidence string, seq long"


def brute(rows: list[tuple]) -> list[tuple]:
    keys: dict[tuple, list[tuple]] = {}
    for r in rows:
        if r[0] != r[2]:
            keys.setdefault(r[:3], []).append(r)

    def first(of: list[tuple], column: int, most: int) -> list | None:
        least: dict = {}
        for r in of:
            if r[column] is not None:
                least.setdefault(r[column], []).append(r[7])
        known = {x: min((q for q in seqs if q is not None), default=None) for x, seqs in least.items()}
        return sorted(known, key=lambda x: (known[x] is not None, known[x] or 0, x))[:most] or None

    return sorted(
        (*k, max(r[3] for r in of), len(of), all(r[4] for r in of), first(of, 5, lt.MOST_SOURCES), first(of, 6, lt.MOST_EVIDENCE)) for k, of in keys.items()
    )


def test_folds_equal_a_plain_one_and_rows_are_dealt_once(spark):
    rng = random.Random(5)
    rows = [
        (rng.randrange(4), rng.choice("ab"), rng.randrange(4), rng.random(), rng.random() < 0.9, rng.choice([None, *range(60)]), rng.choice([None, *"pqrst"]), rng.choice([None, *range(40)]))
        for _ in range(2000)
    ]
    rows += [(9, "a", 8, 0.5, True, None, None, 1)]
    folded = lt.fold_relations(spark.createDataFrame(rows, OBS))
    assert sorted(map(tuple, folded.collect())) == brute(rows)
    plan = folded._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Scan ExistingRDD") == 1
