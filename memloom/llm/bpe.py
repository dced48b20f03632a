"""Byte-pair encoding and decoding with forced-boundary splitting.

Method. A merge can join two neighbouring symbols only into a vocabulary token,
so a pair of bytes that occurs inside no token is a certain cut. A word is cut
at all such pairs, every distinct fragment is encoded once by the tokenizers
library's merge model, and the ids of a word's fragments are concatenated. A
vocabulary with a word-end suffix has two kinds of last byte, so the table holds
the pairs before a word's end apart from all others, and fragments that do not
end a word are encoded by a model without the suffix.

Words repeat, so a bounded table keeps the result of each, in lower case and without the
marks after it, where the vocabulary's splitter is known to take them apart; it holds results
only, and losing it costs time and nothing else. The vocabulary's JSON (a few MB,
whatever the corpus) is broadcast; nothing is shuffled.

Defined cases. A null or empty text has no tokens (both digests are those of
the empty string). The special tokens' own strings in a text become their ids,
as in the library, whatever letters they begin with; a vocabulary whose added
tokens strip blanks or are normalised is refused. A null id and repeated rows are
kept as they are, equal texts with equal digests. A text longer than a run is a
run of its own and is encoded whole. An empty table gives no rows. Further
columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

#: Words whose results are kept per Python worker in each of two generations, and the longest word to keep.
KEPT_WORDS, KEPT_LENGTH = 40_000, 32
#: Fragments handed to the library at once: its results are large.
FRAGMENTS_AT_ONCE = 2000
#: Vocabulary files over this many bytes are refused: they are broadcast.
VOCABULARY_BYTES = 64 << 20
#: Texts are handled in runs of rows of about so many bytes, to bound memory.
SLICE_BYTES = 1 << 19
#: Fixed value: the split pattern of the vocabulary file that LATIN_PIECES stands for.
LIBRARY_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pattern for lower-case text of letters below U+0250.
LATIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\s\w]|_)+"

#: That pattern always cuts between such a letter or digit and one of these marks. U+0130 is none: in lower case it ends in a mark of its own.
MARKS = r"([A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}])([,.;:!?)])"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte.

    Printable Latin-1 bytes stand for themselves; the rest follow from U+0100 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(others)) for b in range(256)]


class ForcedBoundaryEncoder:
    """Encodes and decodes with a byte-level BPE vocabulary whose words end in a suffix."""

    def __init__(self, spec: str):
        conf = json.loads(spec)
        model = conf["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in conf["added_tokens"]}
        for t in conf["added_tokens"]:
            if any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")) or re.search(r"\s", t["content"]):
                raise ValueError(f"added token {t['content']!r} is stripped, normalised, a whole word or holds a blank: not supported")
        self.token = {i: t for t, i in [*self.vocab.items(), *self.specials.items()]}
        self.digits = {i: str(i) for i in self.token}
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        self.code = code = {c: b for b, c in enumerate(letters)}
        self.inner = np.zeros((256, 256), bool)
        self.ending = np.zeros((256, 256), bool)
        for t in self.vocab:
            ends = bool(self.suffix) and t.endswith(self.suffix) and t != self.suffix
            body = t.removesuffix(self.suffix) if ends else t
            for k in range(len(body) - 1):
                a, b = code.get(body[k]), code.get(body[k + 1])
                if a is not None and b is not None:
                    (self.ending if ends and k == len(body) - 2 else self.inner)[a, b] = True
        self.last = Tokenizer(models.BPE(vocab=self.vocab, merges=merges, end_of_word_suffix=self.suffix or None))
        self.middle = Tokenizer(models.BPE(vocab=self.vocab, merges=merges))
        split = next(p for p in conf["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        settled = split["pattern"]["Regex"] == LIBRARY_PIECES
        self.pieces, self.lines = re.compile(LATIN_PIECES), re.compile(LATIN_PIECES + "|\n")
        self.latin = re.compile("[\x21-\x7e\xa1-\u024f]*" if settled else "(?!)")
        self.latin_lines = re.compile("[\n\x21-\x7e\xa1-\u024f]*" if settled else "(?!)")
        self.cuts = settled and not any(re.search(r"\w[,.;:!?)]", t) for t in self.specials)
        self.lowers = settled and any(n["type"] == "Lowercase" for n in (conf["normalizer"] or {}).get("normalizers", []))
        self.apart = {ends: ~(self.ending if ends and self.suffix else self.inner).ravel() for ends in (False, True)}
        self.shown = {b: c for b, c in self.letters.items() if b not in (1, 10)}
        self.full = Tokenizer.from_str(spec)
        self.marks = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        self.any_case = "|".join(map(re.escape, self.specials)) or "$^"
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def fragments(self, word: bytes) -> list[bytes]:
        """word cut wherever no token holds the two bytes side by side."""
        out, start, n = [], 0, len(word)
        for k in range(1, n):
            table = self.ending if k == n - 1 and self.suffix else self.inner
            if not table[word[k - 1], word[k]]:
                out.append(word[start:k])
                start = k
        out.append(word[start:])
        return out

    def words_of(self, chunk: str) -> list[bytes]:
        """Pretokens, as bytes, of a run without special tokens.

        Letters below U+0250 need no normal form and have settled classes; any
        other run goes through the library's own normaliser and pretokeniser.
        """
        if self.latin.fullmatch(chunk):
            return [w.encode() for w in self.pieces.findall(chunk.lower())]
        found = self.full.pre_tokenizer.pre_tokenize_str(self.full.normalizer.normalize_str(chunk))
        return [bytes(map(self.code.__getitem__, w)) for w, _ in found]

    def parts_of(self, chunk: str) -> list[str]:
        """chunk split around special tokens."""
        out, at = [], 0
        for m in self.marks.finditer(chunk):
            out += [chunk[at : m.start()], m[0]]
            at = m.end()
        return [c for c in [*out, chunk[at:]] if c]

    def cut_latin(self, chunks: list[str]) -> list[str]:
        """Each chunk of settled letters in the vocabulary's letters, cut: \\n between words, \\x01 between fragments of a word.

        All chunks are cut at once, as the lines of one text.
        """
        flat = self.lines.findall("\n".join(chunks).lower())
        data = np.frombuffer("\n".join(["" if p == "\n" else p for p in flat]).encode() + b"\n", np.uint8)
        a, b = data[:-1], data[1:]
        pair = a.astype(np.uint16) << 8 | b
        last = np.append(b[1:] == 10, False)
        cuts = np.where(last, self.apart[True][pair], self.apart[False][pair]) & (a != 10) & (b != 10)
        text = np.insert(data, np.flatnonzero(cuts) + 1, 1).tobytes().decode("latin-1").translate(self.shown)
        return text[:-1].split("\n\n")

    def cut_other(self, chunk: str) -> str:
        """The same of any chunk without special tokens; the empty string if it holds no word."""
        return "\n".join(["\x01".join([f.decode("latin-1").translate(self.letters) for f in self.fragments(w)]) for w in self.words_of(chunk)])

    def results(self, chunks: list[str]) -> dict[str, tuple[int, str, str]]:
        """(number of ids, ids, tokens) of each chunk, both joined by a space."""
        out = {"": (0, "", "")}
        cut: dict[str, str] = {}
        plain, lines = [c for c in chunks if c], "\n".join(chunks)
        if self.marks.search(lines) or not self.latin_lines.fullmatch(lines):
            chunks, plain = plain, []
            for c in chunks:
                if not self.marks.search(c):
                    if self.latin.fullmatch(c):
                        plain.append(c)
                    else:
                        cut[c] = self.cut_other(c)
                elif c in self.specials:
                    out[c] = (1, str(self.specials[c]), c)
                else:
                    out[c] = _joined([(1, str(self.specials[p]), p) if p in self.specials else self.results([p])[p] for p in self.parts_of(c)])
        cut.update(zip(plain, self.cut_latin(plain), strict=True) if plain else ())
        need: dict[bool, dict[str, tuple[int, str, str]]] = {True: {}, False: {}}
        for w in dict.fromkeys("\n".join(cut.values()).split("\n")):
            *inner, end = w.split("\x01")
            need[True][end] = out[""]
            for f in inner:
                need[False][f] = out[""]
        for ends, model in ((True, self.last), (False, self.middle)):
            every = list(need[ends])
            for k in range(0, len(every), FRAGMENTS_AT_ONCE):
                frags = every[k : k + FRAGMENTS_AT_ONCE]
                for f, e in zip(frags, model.encode_batch_fast(frags, add_special_tokens=False), strict=True):
                    ids = e.ids
                    need[ends][f] = (len(ids), " ".join([self.digits[i] for i in ids]), self.decode(ids))
        for c, text in cut.items():
            out[c] = need[True].get(text) or _joined([x for w in text.split("\n") for x in self._of_word(w, need)])
        return out

    def _of_word(self, word: str, need: dict) -> list[tuple[int, str, str]]:
        *inner, end = word.split("\x01")
        return [*[need[False][f] for f in inner], need[True][end]]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Per text: number of ids; the ids in decimal, and the decoded text, each joined by one space."""
        texts = pc.fill_null(texts, "")
        if self.lowers and not pc.any(pc.match_substring_regex(texts, self.any_case, ignore_case=True)).as_py():
            texts = pc.ascii_lower(texts)  # special tokens alone have a case
        if self.cuts:
            texts = pc.replace_substring_regex(texts, MARKS, r"\1 \2")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        chunks, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        kept = [self.known.get(c) or self.older.get(c) for c in chunks]
        new = self.results([c for c, x in zip(chunks, kept, strict=True) if x is None])
        found = [x or new[c] for c, x in zip(chunks, kept, strict=True)]
        n = np.array([x[0] for x in found] or [0], np.int64)[at] if len(at) else np.zeros(0, np.int64)
        keep = n > 0
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        places = np.concatenate([[0], np.cumsum(keep)])[ends].astype(np.int32)
        total = np.concatenate([[0], np.cumsum(n)])[ends]
        out = []
        for k in (1, 2):
            flat = pa.array([x[k] for x in found], pa.string()).take(pa.array(at[keep]))
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(places), flat), " "))
        if len(self.known) > KEPT_WORDS:
            self.older, self.known = self.known, {}
        self.known.update((c, x) for c, x in zip(chunks, found, strict=True) if len(c) <= KEPT_LENGTH)
        return np.diff(total), out[0], out[1]

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids, skip_special_tokens=False) for a vocabulary without a decoder."""
        return " ".join(self.token[i] for i in ids)


def _joined(found: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    """One result from those of consecutive parts."""
    found = [x for x in found if x[0]]
    return sum(x[0] for x in found), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])


@lru_cache(maxsize=2)
def _encoder(spec: str) -> ForcedBoundaryEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory
    return ForcedBoundaryEncoder(spec)


def _spec(df: DataFrame, path: str):
    spec = Path(path).read_text(encoding="utf-8")
    if len(spec) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} characters")
    return df.sparkSession.sparkContext.broadcast(spec)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) in runs of rows of about SLICE_BYTES of text each."""
    for b in batches:
        pa.default_memory_pool().release_unused()
        texts = b.column(1).cast(pa.large_string())
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
            yield b.column(0).slice(start, end - start), texts.slice(start, end - start)
            start = end


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int> and decoded string of every text."""
    spec, kind = _spec(df, path), dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(spec.value)
        for keys, texts in slices(batches):
            n, ids, decoded = e.encode_texts(texts)
            flat = pc.split_pattern(ids.filter(pa.array(n > 0)), " ").flatten().cast(pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([keys, lists, decoded.cast(pa.string())], [id_col, "ids", "decoded"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the decoded text of every array of ids; null ids decode to the empty text."""
    spec, kind = _spec(df, path), dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(spec.value)
        for b in batches:
            texts = pa.array([e.decode(x or []) for x in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], [id_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded string")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, and the SHA-256 of the ids and of the decoded text.

    The same encoding as encode(), digested in the worker that made it, so
    that the ids of a text need not be sent on.
    """
    spec, kind = _spec(df, path), dict(df.dtypes)[id_col]

    def sha(texts: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(x).hexdigest() for x in texts.cast(pa.large_binary()).to_pylist()], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(spec.value)
        for keys, texts in slices(batches):
            n, ids, decoded = e.encode_texts(texts)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(n, pa.int64()), sha(ids), sha(decoded)],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
