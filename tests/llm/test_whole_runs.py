"""Training-data operators keep small runs and large components."""

from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm import topk
from memloom.llm.quality import score_quality
from memloom.llm.toxicity import score_toxicity


@pytest.mark.parametrize("score,label", [(score_toxicity, "toxic"), (score_quality, "quality")])
def test_a_run_of_few_bytes_is_scored(spark, score, label):
    """Each text of 0 to 6 bytes is a partition, and so a run, of its own; then one is the whole table."""
    schema = f"doc_id long, text string, {label} int"
    long = [(i, f"{'bad words of anger' if i % 2 else 'kind words of praise'} number {i}", i % 2) for i in range(60)]
    short = [(1000 + n, "aé" if n == 3 else "x" * n, 0) for n in range(7)]
    parts = [spark.createDataFrame(rows, schema).coalesce(1) for rows in (long, *([r] for r in short))]
    every = reduce(DataFrame.unionAll, parts)
    got = {r["doc_id"]: r["score"] for r in score(every.select("doc_id", "text"), every.select("doc_id", label)).collect()}
    assert set(got) == {r[0] for r in long + short} and all(0 <= x <= 1 for x in got.values())
    assert len({x for k, x in got.items() if k < 1000}) > 1
    alone = spark.createDataFrame([(1000, "xy", 0)], schema).coalesce(1)
    assert len(score(alone.select("doc_id", "text"), alone.select("doc_id", label)).collect()) == 1


@pytest.mark.parametrize("large", [5000.0, 2.0**22, 2.0**40])
def test_top_k_keeps_large_components(spark, monkeypatch, large):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * (large if i % 9 == 0 and (large < 2**30 or n == i % 2) else 1) for n in range(6)]) for i in range(400)]
    if large > 2**30:  # a row's product with itself is no score; those of two large rows would not fit
        rows = [(i, v) for i, v in rows if i % 9 or i == 0]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    whole = {i: [math.floor(x * 256) for x in v] for i, v in rows}
    want = []
    for q in [i for i in whole if i % 20 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_products_are_exact_or_an_error():
    q, x = np.array([[2.0**40, 1.0], [3.0, -5.0], [0.0, 1e30]]), np.array([[2.0**22, -1.0], [7.0, 0.0]])
    none = np.zeros((3, 2), bool)
    assert topk.products(q[:2], x, none[:2]).tolist() == [[2**62 - 1, 7 * 2**40], [3 * 2**22 + 5, 21]]
    with pytest.raises(OverflowError):
        topk.products(q, x, none)
