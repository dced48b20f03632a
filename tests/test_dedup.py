"""Duplicates on writing against the sequential rule."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from memloom.operators import dedup as dd


def sequential(x: np.ndarray, groups: list[int], threshold: float) -> dict[int, int]:
    kept: list[int] = []
    out = {}
    s = x @ x.T
    for i in range(len(x)):
        near = [(s[i, j], -j) for j in kept if groups[i] == groups[j] and s[i, j] >= threshold]
        out[i] = -max(near)[1] if near else i
        if not near:
            kept.append(i)
    return out


def test_rounds_equal_the_sequential_rule(spark):
    rng = np.random.default_rng(3)
    home = rng.normal(size=(300, 16))
    x = home[rng.integers(0, 300, 5000)] + 0.25 * rng.normal(size=(5000, 16))
    x[4000:4400] = x[17]  # many copies
    x /= np.linalg.norm(x, axis=1)[:, None]
    groups = rng.integers(0, 3, 5000).tolist()
    df = spark.createDataFrame([(i, groups[i], x[i].tolist()) for i in range(5000)] + [(9000, 1, [0.0] * 16)], "vec_id long, label int, v array<double>")
    pairs = dd.like_pairs(df, 0.9, "label")
    got = {r["id"]: r["kept_id"] for r in dd.first_kept(df.select(F.col("vec_id").alias("id")), pairs).collect()}
    want = sequential(x, groups, 0.9)
    assert got == {**want, 9000: 9000}
    assert 0 < sum(k != v for k, v in want.items()) < 5000


def test_a_chain_keeps_every_second(spark):
    pairs = spark.createDataFrame([(i, i + 1, 0.99) for i in range(9)], "a long, b long, score double")
    got = dd.first_kept(spark.range(11), pairs).collect()
    assert {r["id"]: r["kept_id"] for r in got} == {**{i: i - i % 2 for i in range(10)}, 10: 10}
    assert dd.first_kept(spark.range(3), pairs.limit(0)).count() == 3
