"""Words and n-grams of many texts at once, on their UTF-8 bytes.

A batch of texts is one byte array with offsets. Hashes of runs of bytes come
from one polynomial prefix sum modulo 2**64, whose base is odd and so can be
inverted; runs then cost the same whatever their length. A final mix spreads
the bits. Equal runs have equal hashes; different runs collide with a chance of
about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in runs of rows of about so many bytes, to bound memory.
RUN_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def runs(batches: Iterator[pa.RecordBatch], most: int = RUN_BYTES, rows: int = 1 << 30) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) for runs of at most `rows` rows and about `most` bytes of text; null texts are empty."""
    for b in batches:
        texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            end = min(end, start + rows)
            yield b.column(0).slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(BASE, -1, 1 << 64)
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64)
                for b in (BASE, inverse)
            )
        return self.up, self.down


POWERS = Powers()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and one past the last): words never span texts."""
    inside = ~_BLANK[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[1:-1] = False
    edge[offsets] = True  # a text's end closes a word
    begins = inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]]))
    stops = inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run data[start:end]."""
    up, down = POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)  # not concatenated with an int: that would make floats
    each = sums[1:]  # in place: long texts take eight bytes a byte once
    each[:] = data
    each += np.uint64(1)
    each *= up[: len(data)]
    np.cumsum(each, out=each)
    return mix((sums[ends] - sums[starts]) * down[starts])
