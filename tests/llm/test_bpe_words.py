"""Words are encoded once whatever their case and the marks beside them, and odd texts as by the library."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from memloom.llm.bpe import ForcedBoundaryEncoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(VOCABULARY, encoding="utf-8").read()


def test_a_word_is_kept_once():
    e = ForcedBoundaryEncoder(SPEC)
    e.encode_texts(pa.array(["Word word, word. WORD; (word) word:"], pa.large_string()))
    assert set(e.known) == {"word", ",", ".", ";", "(word", ")", ":"}


def test_odd_texts_as_by_the_library():
    rng, e, t = random.Random(5), ForcedBoundaryEncoder(SPEC), Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    bits = ["it's", "'S,", "é,", "Å.", ",́", "İ", "ΟΔΟΣ,", "Σ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "x1.5", "½;", "日本,", "\x01", "\x00a", "\n", " ", " ", "　",
            "zzxqjvkq", "ŽŠ", "_a_", "!?)", "\xad", "KelvinK", "ǅ", "a" * 50, "''ve", "\r\n", "👍🏽.", "ß,SS"]
    texts = ["".join(rng.choice([*bits, " ", " "]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for s in range(0, len(texts), 50):  # runs with and without special tokens
        n, ids, decoded = e.encode_texts(pa.array(texts[s : s + 50], pa.large_string()))
        for k, text in enumerate(texts[s : s + 50]):
            want = t.encode(text, add_special_tokens=False).ids
            assert (n[k], ids[k].as_py(), decoded[k].as_py()) == (len(want), " ".join(map(str, want)), t.decode(want, skip_special_tokens=False)), repr(text)
    calm = [x for x in texts if "<|" not in x]
    n, ids, _ = e.encode_texts(pa.array(calm, pa.large_string()))
    assert [x.as_py() for x in ids] == [" ".join(map(str, x.ids)) for x in t.encode_batch(calm, add_special_tokens=False)]
