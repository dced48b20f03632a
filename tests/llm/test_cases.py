"""Defined cases of the ten operators: empty tables, odd rows, clashing names; and what op2, op4 and op7 add."""

from __future__ import annotations

import random
import string
import uuid

import pytest
from pyspark.sql import functions as F

from memloom.llm import bpe, mix, neardup, pii, quality, secrets, spotsigs, topk, toxicity
from memloom.llm.wordpiece import LongestMatch, count_tokens
from tests.llm.test_contracts import ODD, SCHEMA, VOCABULARY

NAMES = ("_row", "_marked", "_bucket", "_pii_base", "_pii_all", "_mix_key", "_mix_size", "n", "kept", "score", "signature", "h")
OPERATORS = {
    "bpe": lambda d, l: bpe.digests(d, VOCABULARY), "pii": lambda d, l: pii.find_personal_data(d), "secrets": lambda d, l: secrets.find_secrets(d),
    "mix": lambda d, l: mix.mix_sources(d), "toxicity": toxicity.score_toxicity, "quality": quality.score_quality,
    "tokens": lambda d, l: count_tokens(d, ["a"], ["b"]), "spotsigs": lambda d, l: spotsigs.edited_fingerprints(d),
    "neardup": lambda d, l: neardup.near_duplicates(d), "keep_good": quality.keep_good, "one_of_each": lambda d, l: neardup.one_of_each(d),
    "mask": lambda d, l: pii.mask_personal_data(d), "mixed": lambda d, l: mix.mixed_documents(d),
}
SAME_COLUMNS = ("keep_good", "one_of_each", "mask", "mixed")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (5, 0, 1), (6, 1, None), (7, None, 0), (9, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def clashing(spark):
    twice = spark.createDataFrame([*ODD, ODD[5], (12, "word " * 30000, "en", "b", 0)], SCHEMA)
    return twice.select("*", *(F.lit(str(k)).alias(n) for k, n in enumerate(NAMES)))


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"neardup"}))  # one_of_each runs it
def test_odd_rows_and_clashing_names(clashing, labels, name):
    got = OPERATORS[name](clashing, labels)
    rows = got.collect()
    if name in SAME_COLUMNS:
        assert got.columns == clashing.columns
        assert all(r[n] == str(k) for r in rows for k, n in enumerate(NAMES))
    else:
        assert len(rows) == clashing.count()


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - set(SAME_COLUMNS)))
def test_empty_tables(clashing, labels, name):
    assert OPERATORS[name](clashing.limit(0), labels.limit(0)).count() == 0


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [5000.0, 1.0]), (50, [-4096.0, 2.0]), (3, [1.0]), (4, []), (5, [float("nan"), 1.0]), (6, None), (7, [None, 1.0]), (None, [1.0, 1.0]), (0, [5000.0, 1.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    of_50 = [(r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 50]
    low = -4096 * 256 * 5000 * 256 + 2 * 256 * 256
    assert of_50 == [(1, 4, 0), (2, 3, -4096 * 256 * 256), (3, 0, low), (4, 0, low)]
    assert all(r["vec_id"] != 0 for r in got if r["query_id"] == 0)
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_added_personal_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    planted = [
        "we met Maria Garcia yesterday in town", "please call 555-123-4567 now", "her ssn is 078-05-1120 okay", "he lives at 12 Baker Street in town",
        "write to @maria_g for more", "pay to DE89 3704 0044 0532 0130 00 please", "thanks to Mr Smith for all", "my name is Peter",
        "signed by Dr. Emma Schmidt then", "tel 030 5551 2345 ja", "call me at (212) 555-0188 today", "wohnt in der Hauptstraße 12 dort",
    ]
    clean = [
        "on 2024-10-01 we left", "version 10.20.30 is out", "the Apache License is here", "isbn 978-3-16-148410-0 was", "from 1990-1995 it was",
        "In New York City it rained", "the part 12345678 is gone", "At At At At", "plain words only", "page 12 of 240",
    ]
    rows = [(10**6 + k, t) for k, t in enumerate(planted + clean)]
    found = pii.find_personal_data(docs.unionAll(spark.createDataFrame(rows, "doc_id long, text string"))).filter("doc_id >= 1000000").collect()
    hit = {r["doc_id"] - 10**6 for r in found if len(r["spans"]) > len(r["base"])}
    assert len([k for k in hit if k < len(planted)]) >= 0.9 * len(planted)
    assert not [clean[k - len(planted)] for k in hit if k >= len(planted)]


def test_added_secrets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    dice = random.Random(3)

    def drawn(n, signs):
        return "".join(dice.choice(signs) for _ in range(n))

    planted = [drawn(n, string.ascii_letters + string.digits) for n in (10, 12, 16, 20, 32) for _ in range(10)] + [drawn(24, string.ascii_letters) for _ in range(10)]
    clean = [str(uuid.UUID(int=dice.getrandbits(128))) for _ in range(30)]
    clean += ["getUserNameFromList", "config_option_default", "/usr/local/bin/python", "internationalization", "-" * 30, "x" * 40, "responsabilities", "2024-10-01"]
    rows = [(10**6 + k, f"some {t} here") for k, t in enumerate(planted + clean)]
    model = secrets.fit(secrets.default_samples(spark, docs, "doc_id", "text"))  # the planted strings take no part in training
    found = secrets.with_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    hit = {r["doc_id"] - 10**6 for r in found if r["_secret_all"]}
    assert len([k for k in hit if k < len(planted)]) >= 0.9 * len(planted)
    assert len([k for k in hit if k >= len(planted)]) <= 0.05 * len(clean)


def test_reliabilities_and_weights():
    yes, no = (1, 0, 0, 0, 0, 0, 0, 1, 1), (-1, 0, 0, 0, 0, 0, 0, -1, -1)
    share, table = pii.reliabilities([(yes, 300), (no, 700)])
    assert len(yes) == len(pii.LABELERS) and 0.2 < share < 0.4
    assert pii.posterior(yes, share, table) > 0.9 > 0.1 > pii.posterior(no, share, table)
    on, off = tuple([1] + [0] * (len(pii.FEATURES) - 2)), tuple([0] * (len(pii.FEATURES) - 1))
    w = pii.logistic([(on, 1.0, 500.0), (off, 0.0, 500.0)])
    assert w[0] + w[-1] > 0 > w[-1]


def test_longest_match_equals_greedy_search():
    dice = random.Random(11)
    pieces = ["".join(dice.choice("abc") for _ in range(dice.randint(1, 4))) for _ in range(40)]
    first, later = pieces[:25] + ["a", "b"], pieces[15:] + ["a", "c"]
    automaton = LongestMatch(first, later)
    for _ in range(3000):
        word = "".join(dice.choice("abc") for _ in range(dice.randint(1, 12)))
        at, n = 0, 0
        while at < len(word):
            own = [len(p) for p in (later if at else first) if word.startswith(p, at)]
            if not own:
                n = 0
                break
            at, n = at + max(own), n + 1
        assert automaton.count(word) == n, word
