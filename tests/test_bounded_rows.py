"""A query's vector stands once for all the lists that it visits, and chunks of long texts leave a task in pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from memloom.operators import chunks as ch
from memloom.operators import nearest as ne


def test_a_query_is_one_row_whatever_lists_it_visits(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, "t", [float(x) for x in rng.normal(size=4)]) for i in range(400)], "id long, type string, v array<double>")
    points = ne.unit(df, "type", "id")
    heads = ne.centres(points)
    assert heads.count() > 10 and ne.by_centre(points, heads, "share").count() == 400


def test_chunks_leave_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ch, "HELD", 100)
    texts = [(None, "a bc " * 50), (2, None), (3, ""), (4, "x" * 500), (5, "é w. " * 9)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in ch.chunks_by_words(df, 10, 2).collect()]
    want = [(i, n, a, z, t[a:z]) for i, t in texts if t for n, (a, z) in enumerate(ch.word_spans(t, 10, 2))]
    assert sorted(got, key=str) == sorted(want, key=str) and isinstance(ch.KINDS[0], pa.DataType)
