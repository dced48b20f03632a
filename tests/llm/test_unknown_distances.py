"""Members of a pivot whose distance to it is not known are still compared with one another."""

from __future__ import annotations

import random

from memloom.llm import neardup


def test_links_of_members_far_from_their_pivot(spark):
    sets = {2: list(range(100, 110)), 3: list(range(101, 111)), 4: list(range(500, 510))}
    rows = [(1, 0, 0, 0, r, r, None, s) for r, s in sets.items()]
    schema = "k long, i long, j long, side int, rep long, c long, d double, shingles array<long>"
    got = neardup.compare(spark.createDataFrame(rows, schema), 80, every=False).collect()
    assert [tuple(r)[:3] for r in got] == [(1, 2, 3)]


def test_like_texts_that_share_a_bucket_with_an_unlike_pivot_alone(spark, monkeypatch):
    """Every text is in one bucket with a pivot that is like none of them."""
    monkeypatch.setattr(neardup, "band_hashes", lambda least: least[:1] * 0)
    rng = random.Random(4)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(8)]
    texts = [" ".join(w) for w in words] + [" ".join([*w[:-2], "x", "y"]) for w in words]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == {i: i % 8 for i in range(16)}
