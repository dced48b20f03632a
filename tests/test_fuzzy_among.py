"""Fuzzy matches by distinct names equal those over all pairs."""

from __future__ import annotations

import random

import pytest

from memloom.operators import cascade as ca


@pytest.mark.parametrize("threshold", [0.6, 0.999])
def test_distinct_names_give_what_all_pairs_give(spark, threshold, monkeypatch):
    rng = random.Random(6)
    words = ["ring", "Bolt", "plate", "blue", "hot"]

    def names(n, first):
        rows = [(first + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice(["", "  ", "s"]), i % 3 or None) for i in range(n)]
        return rows + [(first + n, None, 1), (first + n + 1, "", 1), (first + n + 2, "ring\u00a0blue", 1)]

    mentions = spark.createDataFrame(names(60, 1000), "mention long, name string, g int")
    entities = spark.createDataFrame(names(50, 0), "entity long, other string, g int")
    want = ca.fuzzy_matches(mentions.join(entities, "g"), threshold=threshold)
    assert sorted(map(tuple, ca.fuzzy_among(mentions, entities, ["g"], threshold).collect())) == sorted(map(tuple, want.collect()))


def test_repeated_names_are_not_paired_row_by_row(spark):
    """20,000 mentions of 20,000 entities with 4 names are 400 million pairs of rows, but 16 of names."""
    row = spark.range(20000)
    name = ca.F.concat(ca.F.lit("part no"), (row.id % 4).cast("string"))
    mentions, entities = row.select(row.id.alias("mention"), name.alias("name")), row.select(row.id.alias("entity"), name.alias("other"))
    one = ca.F.lit(1)
    got = ca.fuzzy_among(mentions.withColumn("g", one), entities.withColumn("g", one), ["g"], 0.999).collect()
    assert len(got) == 20000 and all(r["entity"] == r["mention"] % 4 and r["score"] == 1 for r in got)
