"""Ids of whole texts by a byte-level BPE vocabulary, each distinct word of a run encoded once.

The vocabulary's own splitter always cuts before a blank (U+0020) that something
other than white space follows: such a blank goes with what follows it. It also cuts
between a letter or digit and a punctuation mark or line feed. So a text is cut
there, the distinct pieces of a run of texts are found on Arrow arrays, and
each is encoded whole by the tokenizers library, which also finds the special
tokens and cuts the piece further. Many pieces without white space inside are handed over as
the lines of one text, as a line feed is a token of its own between them. A text's ids are its
pieces' ids in a row, kept as little-endian unsigned 32-bit numbers. A bounded
table keeps the ids of pieces; losing it costs time only.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pieces whose ids are kept (one run's more at most), and the longest to keep (in bytes of ids).
KEPT, KEPT_BYTES = 1_000_000, 64
#: Pieces handed to the library at once: its results are large.
AT_ONCE = 5000
#: Stands at the cuts. Texts that hold it are encoded whole.
MARK = "\x01"
#: Fixed value: white space, as the splitter sees it.
BLANKS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Where texts are cut: before a blank that no white space follows; between a letter or digit and a mark.
WORDS, MARKS = f" ([^{BLANKS}])", r"([\pL0-9])([,.;:!?)\n])"
#: Pieces that may stand as lines of one text.
LINE = f"^ ?[^{BLANKS}]+$"


class LineEncoder:
    """Encodes whole texts as the library does with add_special_tokens=False, without truncation or padding."""

    def __init__(self, spec: str):
        conf = json.loads(spec)
        before = conf["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or conf["normalizer"]:
            raise ValueError("only byte-level vocabularies without a normaliser and a prefix blank are supported")
        for t in conf["added_tokens"]:
            if any(t.get(k) for k in ("lstrip", "rstrip", "single_word")) or re.search(r"\s|\w[,.;:!?)]", t["content"]):
                raise ValueError(f"added token {t['content']!r} is stripped, a whole word or may be cut: not supported")
        self.added = "|".join(re.escape(t["content"]) for t in conf["added_tokens"]) or "$^"
        self.model = Tokenizer.from_str(spec)
        self.model.no_truncation()
        self.model.no_padding()
        self.pieces, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

        self.feed = self.model.encode("\n", add_special_tokens=False).ids
        if len(self.feed) != 1:
            raise ValueError("a line feed is no single token: not supported")

    def _ids(self, pieces: list[str]) -> pa.Array:
        """The ids of each piece, one by one."""
        out = []
        for s in range(0, len(pieces), AT_ONCE):
            found = self.model.encode_batch_fast(pieces[s : s + AT_ONCE], add_special_tokens=False)
            out += [np.array(f.ids, "<u4").tobytes() for f in found]
        return pa.array(out, pa.large_binary())

    def _ids_of_lines(self, pieces: list[str]) -> pa.Array:
        """The ids of each piece, from those of all pieces as lines."""
        out = [pa.array([], pa.large_binary())]
        for s in range(0, len(pieces), AT_ONCE):
            some = pieces[s : s + AT_ONCE]
            ids = np.array(self.model.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            feeds = np.flatnonzero(ids == self.feed[0])
            ends = np.append(feeds, len(ids)) - np.arange(len(feeds) + 1)
            offsets = np.concatenate([[0], ends]).astype(np.int64) * 4
            if len(offsets) != len(some) + 1:
                raise ValueError("a piece holds a line feed's token")
            out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids[ids != self.feed[0]].tobytes())]))
        return pa.concat_arrays(out)

    def _ids_of_new(self, pieces: pa.Array) -> pa.Array:
        lines = pc.and_(pc.match_substring_regex(pieces, LINE), pc.invert(pc.match_substring_regex(pieces, self.added)))
        found = pa.concat_arrays([self._ids_of_lines(pieces.filter(lines).to_pylist()), self._ids(pieces.filter(pc.invert(lines)).to_pylist())])
        is_line = lines.to_numpy(zero_copy_only=False)
        place = np.empty(len(pieces), np.int64)
        place[is_line], place[~is_line] = np.arange(is_line.sum()), is_line.sum() + np.arange((~is_line).sum())
        return found.take(pa.array(place))

    def _of_pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces."""
        at = pc.index_in(pieces, value_set=self.pieces)
        new = pieces.filter(pc.is_null(at))
        fresh = self._ids_of_new(new)
        place = at.to_numpy(zero_copy_only=False)
        known = ~np.isnan(place)
        place = np.where(known, np.nan_to_num(place), len(self.ids) + np.cumsum(~known) - 1).astype(np.int64)
        all_ids = pa.concat_arrays([self.ids, fresh])
        keep = pc.less_equal(pc.binary_length(fresh), KEPT_BYTES)
        if len(self.pieces) > KEPT:
            self.pieces, self.ids = self.pieces[:0], self.ids[:0]
        self.pieces = pa.concat_arrays([self.pieces, new.filter(keep)])
        self.ids = pa.concat_arrays([self.ids, fresh.filter(keep)])
        return all_ids.take(pa.array(place))

    def encode_texts(self, texts: pa.Array) -> pa.Array:
        """The ids of each text (large strings without nulls), as large binary."""
        if len(texts) and pc.any(marked := pc.match_substring(texts, MARK)).as_py():
            whole = iter(self._ids(texts.filter(marked).to_pylist()).to_pylist())
            rest = iter(self.encode_texts(texts.filter(pc.invert(marked))).to_pylist())
            return pa.array([next(whole if m else rest) for m in marked.to_pylist()], pa.large_binary())
        marked = pc.replace_substring_regex(texts, WORDS, MARK + r" \1")
        cut = pc.split_pattern(pc.replace_substring_regex(marked, MARKS, r"\1" + MARK + r"\2"), MARK)
        coded = cut.flatten().dictionary_encode()
        every = self._of_pieces(coded.dictionary).take(coded.indices)
        starts = cut.offsets.to_numpy()
        lists = pa.ListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int32)), every)
        return pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))


@lru_cache(maxsize=2)
def line_encoder(spec: str) -> LineEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return LineEncoder(spec)
