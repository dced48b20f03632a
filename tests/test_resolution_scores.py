"""Scorers of names against independent values, and chunks against plain Python."""

from __future__ import annotations

import re

import pytest

from memloom.operators import chunks as ch
from memloom.operators import scores as sc


def test_parts_and_sorted_words():
    assert sc.fuzzy("new york university", "new york") == pytest.approx(0.9)
    assert sc.fuzzy("ada lovelace", "lovelace ada") == 1.0
    assert sc.fuzzy("acme", "globex") < 0.5
    assert sc.partial("xabcx", "abc") == 1.0
    assert sc.fuzzy("", "") == 0.0


def test_context_shares_words_not_places():
    a = "freight out of the rotterdam depot is handled by northwind."
    b = "northwind logistics ships freight out of the rotterdam depot."
    assert sc.token_set(a, b) > 0.6 > sc.ratio(a, b)


@pytest.mark.parametrize("text", ["", " ", "a", "One. Two! " * 60, "x" * 1000, "word. " * 100 + "y" * 500, "é. ü " * 300])
def test_chunks_cover_texts(text):
    spans = list(ch.char_spans(text, 300, 50))
    assert "".join(text[a:b][50 if i else 0 :] for i, (a, b) in enumerate(spans)) == text
    assert all(b - a <= 300 for a, b in spans)
    inner = spans[:-1]
    near = [re.search(r"(?s)[.!?]\s+(?!.*[.!?]\s)", text[max(a + 300 - ch.NEAR, a) : a + 300]) for a, _ in inner]
    assert [b for _, b in inner] == [max(a + 300 - ch.NEAR, a) + m.end() if m else a + 300 for (a, _), m in zip(inner, near)]
    words = [m.span() for m in re.finditer(r"\S+", text)]
    of_words = list(ch.word_spans(text, 20, 5))
    assert all(any(a <= i and j <= b for a, b in of_words) for i, j in words)


def test_null_and_short_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "id int, text string")
    assert [tuple(r) for r in ch.chunks_by_chars(df).collect()] == [(3, 0, 0, 3, "a b")]
    assert [tuple(r) for r in ch.chunks_by_words(df).collect()] == [(3, 0, 0, 3, "a b")]
    with pytest.raises(ValueError):
        ch.chunks_by_chars(df, 100, 20)
