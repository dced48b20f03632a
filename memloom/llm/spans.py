"""Spans of a text by regular expressions, in DataFrame functions only.

regexp_extract_all gives the matches without their places; split by the same
pattern gives the gaps between them. The lengths of both in turn are the places,
in code points. A span is a struct of start, end (exclusive) and match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def find(text: Column, pattern: str, maybe: Column) -> Column:
    """Leftmost non-overlapping matches of `pattern`.

    `maybe` must be true for every text that holds a match; the other texts are
    not searched. Patterns should not backtrack over long runs: use possessive
    quantifiers, and begin a run with (?:\\G|(?<![class])) instead of trying each
    of its letters.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    parts = F.filter(
        F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), lambda p: p["m"].isNotNull()
    )
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["g"]
        end = begin + F.char_length(p["m"])
        span = F.struct(begin.alias("start"), end.alias("end"), p["m"].alias("match"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    return F.when(maybe, F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(no_spans())


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def listing(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of spans with a kind, by start, then kind as listed, joined by commas."""
    rank = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(rank, s["kind"]).alias("b"), s["end"].alias("c"), s["kind"].alias("d"))
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["d"], s["a"], s["c"])), ",")


def parts(span: Column) -> list[Column]:
    """The fields of a span with a kind."""
    return [span[name].alias(name) for name in ("kind", "start", "end", "match")]


def tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), *(s[n].alias(n) for n in ("start", "end", "match"))))


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in angle brackets; spans may overlap."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["a"] - acc["at"])
        more = F.when(s["a"] >= acc["at"], F.concat(acc["out"], gap, F.lit("<"), F.upper(s["k"]), F.lit(">")))
        return F.struct(F.greatest(acc["at"], s["b"]).alias("at"), more.otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2147483647))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
