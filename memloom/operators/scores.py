"""Similarity of names and contexts by matching letters: small helpers of Pandas UDFs over candidate pairs."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# How much scores of sorted or partial texts count, and the ratio of lengths from which on parts are compared.
SORTED, PART, SMALL_PART = 0.95, 0.90, 0.60
PARTS_FROM, SMALL_FROM = 1.5, 8.0
#: A part that matches this well counts as equal.
WHOLE = 0.995


@lru_cache(maxsize=1 << 16)
def ratio(a: str, b: str) -> float:
    """Twice the letters in matching blocks by both lengths; 0 where a text is empty."""
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def in_order(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort(a: str, b: str) -> float:
    return ratio(in_order(a), in_order(b))


def token_set(a: str, b: str) -> float:
    """The best ratio among the shared words and each side's words, shared ones first."""
    x, y = set(a.split()), set(b.split())
    shared = sorted(x & y)
    forms = [" ".join(shared), *(" ".join(shared + sorted(side - (x & y))) for side in (x, y))]
    return max(ratio(forms[i], forms[j]) for i, j in ((0, 1), (0, 2), (1, 2))) if x and y else 0.0


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text and as many letters of the longer one, laid along a matching block."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    begins = {max(0, m.b - m.a) for m in SequenceMatcher(None, short, long).get_matching_blocks()}
    best = max(ratio(short, long[i : i + len(short)]) for i in begins)
    return 1.0 if best >= WHOLE else best


def weighted(a: str, b: str) -> float:
    """The plain ratio, or the better of sorted and shared words; of texts of unlike lengths, their parts."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    if lengths < PARTS_FROM:
        return max(ratio(a, b), SORTED * max(token_sort(a, b), token_set(a, b)))
    scale = PART if lengths < SMALL_FROM else SMALL_PART
    words = 1.0 if set(a.split()) & set(b.split()) else partial(in_order(a), in_order(b))
    return max(ratio(a, b), scale * partial(a, b), scale * SORTED * words)


def fuzzy(a: str, b: str) -> float:
    return max(weighted(a, b), token_sort(a, b))


SCORERS: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio, "partial_ratio": partial, "token_sort_ratio": token_sort, "token_set_ratio": token_set, "WRatio": weighted, "fuzzy": fuzzy,
}


def score(name: str, a: Column | str, b: Column | str) -> Column:
    """The named scorer of two text columns, from 0 to 1; null where either is null or, of contexts, empty."""
    f = SCORERS[name]

    @F.pandas_udf("double")
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y)], dtype="float64")

    return scored(a, b)


def context(a: Column, b: Column) -> Column:
    """Shared words of two contexts; null where one is missing."""
    return F.when((a != "") & (b != ""), score("token_set_ratio", F.lower(a), F.lower(b)))
