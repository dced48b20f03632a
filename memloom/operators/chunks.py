"""Long texts cut into overlapping chunks, at sentence ends where one is near."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A chunk of letters ends at a sentence end among its last NEAR letters; one of words reaches for one among the next NEAR.
NEAR = 100
STOP = re.compile(r"[.!?]\s+")
FIRST_STOP = re.compile(r"[.!?]\s")
WORD = re.compile(r"\S+")
CHUNK, KINDS = ("place", "start", "end", "text"), (pa.int32(), pa.int64(), pa.int64(), pa.string())
#: Letters of chunks that a task passes on at once.
HELD = 1 << 20


def char_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each chunk; all stops are found once, so time is linear in the text."""
    stops = [m.span() for m in STOP.finditer(text)] if len(text) > size else []
    # a stop may be cut off within its blanks: it counts from its first blank on
    seen = [a + 2 for a, _ in stops]
    start, end = 0, 0
    while end < len(text):
        end = min(start + size, len(text))
        last = bisect_right(seen, end) - 1
        if end < len(text) and last >= 0 and stops[last][0] >= max(end - NEAR, start):
            end = min(stops[last][1], end)
        yield start, end
        start = end - overlap


def word_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each chunk; chunk i begins at word i * (size - overlap). Short texts are one chunk, blanks included."""
    words = [m.span() for m in WORD.finditer(text)]
    if text and len(words) <= size:
        yield 0, len(text)
    for first in range(0, max(len(words) - overlap, 0) if len(words) > size else 0, size - overlap):
        end = words[min(first + size, len(words)) - 1][1]
        stop = FIRST_STOP.search(text, end, end + NEAR) if first + size < len(words) else None
        yield words[first][0], stop.end() if stop else end


def _chunked(df: DataFrame, spans: Callable[[str, int, int], Iterator[tuple[int, int]]], size: int, overlap: int, text: str) -> DataFrame:
    rest = [c for c in df.columns if c != text]
    # what is left of a batch is passed on in pieces, so that chunks of many long texts are not held at once
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows, found, held = b.column(len(rest)), [], [], 0

            def piece() -> pa.RecordBatch:
                others = b.select(rest).take(pa.array(rows, pa.int64())).columns
                cols = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), KINDS, strict=True)]
                return pa.RecordBatch.from_arrays([*others, *cols], [*rest, *CHUNK])

            for row in range(b.num_rows):
                whole = texts[row].as_py() or ""
                for place, (a, z) in enumerate(spans(whole, size, overlap)):
                    rows.append(row)
                    found.append((place, a, z, whole[a:z]))
                    held += z - a
                    if held >= HELD:
                        yield piece()
                        rows, found, held = [], [], 0
            if rows:
                yield piece()

    kept = df.select(*rest, text)
    schema = T.StructType([*kept.schema.fields[:-1], *T._parse_datatype_string("place int, start long, end long, text string").fields])
    return kept.mapInArrow(cut, schema)


def chunks_by_chars(df: DataFrame, size: int = 4000, overlap: int = 200, text: str = "text") -> DataFrame:
    """df's other columns with place, start, end and text of each chunk; texts null or empty have none.

    A chunk may end NEAR letters early, so size must exceed overlap by more than that.
    """
    if size - NEAR <= overlap:
        raise ValueError("chunks must be longer than their overlap and the reach to a sentence end")
    return _chunked(df, char_spans, size, overlap, text)


def chunks_by_words(df: DataFrame, size: int = 1000, overlap: int = 50, text: str = "text") -> DataFrame:
    """As chunks_by_chars, by words between blanks."""
    if size <= overlap:
        raise ValueError("chunks must be longer than their overlap")
    return _chunked(df, word_spans, size, overlap, text)
