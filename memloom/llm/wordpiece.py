"""Token counts by a linear longest-match automaton.

Method. The vocabulary is a trie, once for pieces that begin a word and once for
pieces that continue one. Each node has a failure link: the node at which
matching goes on after the pieces matched so far are popped, with their number
computed beforehand. A word is read once, letter by letter, and the sum of
popped counts is the number of greedy longest-match pieces; no piece is built.
A word that cannot be matched to its end counts as one unknown token.

The vocabulary is of fixed size and broadcast; nothing is shuffled. Words are
counted once per run of texts, over Arrow's dictionary of the run.

Defined cases. A null or empty text has no words. Repeated rows and a null id
are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Runs of texts of about so many bytes are handled at once, to bound memory.
RUN_BYTES = 4 << 20
#: Words whose counts are kept per Python worker.
KEPT_WORDS = 250_000
#: A vocabulary of more pieces is refused: it is broadcast.
MOST_PIECES = 1 << 21


class LongestMatch:
    """Greedy word-piece lengths over two tries in one automaton."""

    def __init__(self, initial: list[str], continuing: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # node 0: a word's start, node 1: after a popped piece
        self.fail: list[int] = []
        self.pops: list[int] = []
        ends = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for p in pieces:
                node = root
                for c in p:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    node = self.next[node][c]
                if node != root:
                    ends[node] = True
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        level = [0, 1]
        while level:  # by depth: a link's target lies nearer to a root
            deeper = []
            for u in level:
                for c, v in self.next[u].items():
                    deeper.append(v)
                    if ends[v]:
                        self.fail[v], self.pops[v] = 1, 1
                        continue
                    at, popped = self.fail[u], self.pops[u]
                    while at >= 0 and c not in self.next[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[v], self.pops[v] = self.next[at][c], popped
            level = deeper

    def count(self, word: str) -> int:
        """Number of pieces; 0 if the word cannot be matched to its end."""
        at, n = 0, 0
        step, fail, pops = self.next, self.fail, self.pops
        for c in word:
            while c not in step[at]:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 0
            at = step[at][c]
        while at > 1:  # pop what is left; only the continuing root is a clean end
            n += pops[at]
            at = fail[at]
        return n if at == 1 else 0


def sentencepiece_vocabulary(path: str, mark: str = "▁") -> tuple[list[str], list[str]]:
    """(initial, continuing) pieces: those with the word mark, without it, and the others.

    Byte and control pieces are not text and take no part.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    ]
    return [p[1:] for p in plain if p[0] == mark and len(p) > 1], [p for p in plain if p[0] != mark]


@lru_cache(maxsize=2)
def _automaton(initial: tuple[str, ...], continuing: tuple[str, ...]) -> tuple[LongestMatch, dict[str, int]]:
    return LongestMatch(list(initial), list(continuing)), {}


def count_tokens(
    df: DataFrame, initial: list[str], continuing: list[str], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col, n_words, n_tokens and n_unknown (words counted as one unknown token) of every text."""
    if len(initial) + len(continuing) > MOST_PIECES:
        raise ValueError(f"the vocabulary has more than {MOST_PIECES} pieces")
    vocabulary = df.sparkSession.sparkContext.broadcast((tuple(initial), tuple(continuing)))
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(*vocabulary.value)
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(texts):
                done = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, done + RUN_BYTES, "right")))
                split = pc.ascii_split_whitespace(texts.slice(start, end - start))
                coded = split.flatten().dictionary_encode()
                per = []
                for w in coded.dictionary.to_pylist():
                    if (n := known.get(w)) is None:
                        n = automaton.count(w)
                        if len(known) < KEPT_WORDS:
                            known[w] = n
                    per.append((1, n or 1, not n) if w else (0, 0, 0))
                words = np.array(per or [(0, 0, 0)], np.int64)[coded.indices.to_numpy()] if len(coded) else np.zeros((0, 3), np.int64)
                total = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(words, 0)])
                ends = split.offsets.to_numpy() - split.offsets[0].as_py()
                n = np.diff(total[ends], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, end - start), *(pa.array(np.ascontiguousarray(n[:, k])) for k in range(3))],
                    [id_col, "n_words", "n_tokens", "n_unknown"],
                )
                start = end

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long, n_unknown long")
