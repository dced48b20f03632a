"""run() of the pipeline against a plain Python version of its stages on the smallest tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from memloom.llm.pii import find_personal_data
from memloom.llm.quality import score_quality
from tests.llm.test_contracts import brute_components

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def masked(text, spans):
    out, at = "", 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"], s["kind"])):
        if s["start"] >= at:
            out += text[at : s["start"]] + f"<{s['kind'].upper()}>"
        at = max(at, s["end"])
    return out + text[at:]


def mixed(rows):
    """(doc_id, text) of the mix of (doc_id, text, source) rows."""
    size = {r[0]: len(re.findall(WORD, r[1])) for r in rows}
    sources = sorted({r[2] for r in rows})
    total = {s: sum(size[r[0]] for r in rows if r[2] == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, left, free = {}, float(sum(total.values())), set(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * total[s] for s in full}
        left -= sum(3 * total[s] for s in full)
        free -= full
    out = []
    for s in sources:
        order = sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(f"{r[0]}mix-1".encode()).hexdigest(), r[0]))
        budget = int(target[s] + 1e-6)
        while budget > 0:
            for key, text, _ in order:
                n = min(size[key], budget)
                budget -= n
                if n == size[key] and n:
                    out.append((key, text))
                elif n:
                    out.append((key, text[: [m.end() for m in re.finditer(WORD, text)][n - 1]]))
    return out


def test_run_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = [r["doc_id"] for r in score_quality(docs, labels).filter("score >= 0.5").collect()]
    kept = docs.filter(F.col("doc_id").isin(good))
    of = brute_components(kept, 5, 80)
    first = kept.filter(F.col("doc_id").isin([k for k, c in of.items() if k == c]))
    spans = {r["doc_id"]: r["spans"] for r in find_personal_data(first).collect()}
    rows = [(r["doc_id"], masked(r["text"], spans[r["doc_id"]]), r["source"]) for r in first.collect()]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    want = Counter()
    for key, text in mixed(rows):
        ids = t.encode(text, add_special_tokens=False).ids
        want[key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
