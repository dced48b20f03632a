"""The secret models on identifiers of words that no sample holds, and on tokens with usual prefixes."""

from __future__ import annotations

import random
import string

import pytest

from memloom.llm import secrets

# Words of the identifiers below; none is in the word list, and the documents' words are invented.
UNSEEN = (
    "factory singleton proxy bean beautiful soup postgres alchemy widget gadget invoice ledger pigeon marble whistle kettle bridge harbor "
    "turbine glacier meadow velvet cactus falcon lantern pepper saddle thunder violin walnut yellow zipper grammar hostel jungle kitchen"
).split()
FALSE_ALARMS = (
    "XMLHttpRequestFactory", "JSONWebTokenParser", "BeautifulSoup4", "PostgreSQL-9_6", "sqlalchemy-utils", "AbstractSingletonProxyFactoryBean",
    "Donaudampfschifffahrtsgesellschaft", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnop", "iPhone14ProMax256GB", "getElementById", "12345678901234",
)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return secrets.fit(secrets.default_samples(spark, docs, "doc_id", "text"))


def reported(spark, model, tokens):
    rows = spark.createDataFrame([(k, f"some {t} here") for k, t in enumerate(tokens)], "doc_id long, text string")
    found = secrets.with_secrets(rows, model).collect()
    return [tokens[r["doc_id"]] for r in found if r["_secret_all"]]


def test_identifiers_of_unseen_words_are_no_secrets(spark, model):
    assert not set(UNSEEN) & set(secrets.WORDS.split())
    dice, made = random.Random(4), []
    while len(made) < 200:
        a, b, c = dice.sample(UNSEEN, 3)
        styles = (f"{a}_{b}_{c}", f"{a}-{b}", a + b.title() + c.title(), a.title() + b.title() + "2", f"{a}_{b}".upper(), f"HTTP{a.title()}{b.title()}", f"{a.title()}-{dice.randrange(99)}_{dice.randrange(9)}", a + b)
        made += [x for x in styles if len(x) >= secrets.SHORTEST]
    made = made[:200]
    assert len(reported(spark, model, made)) <= 0.05 * len(made)
    assert reported(spark, model, list(FALSE_ALARMS)) == []


def test_tokens_with_usual_prefixes_are_found(spark, model):
    dice, signs = random.Random(6), string.ascii_letters + string.digits
    prefixes = (("ghp_", 36), ("sk_live_", 24), ("AIza", 35), ("glpat-", 20), ("npm_", 36), ("sk-", 48), ("SG", 22), ("", 16))
    tokens = [p + "".join(dice.choice(signs) for _ in range(n)) for p, n in prefixes for _ in range(25)]
    assert len(reported(spark, model, tokens)) >= 0.9 * len(tokens)
    assert reported(spark, model, ["ghp_16C7e42F292c6912E7710c838347Ae178B4a"])


def test_samples_without_forms_and_without_rows(spark):
    rows = spark.createDataFrame([("getUserName", False), ("q8Zx0LpV2kTr", True), (None, True), ("x", None)], "text string, random boolean")
    weights, least = secrets.fit(rows)
    assert len(weights) == 1 and len(least) == len(secrets.LONGER) + 1
    weights, least = secrets.fit(rows.limit(0))
    assert len(weights) == 1 and all(m == secrets.SAFETY for m in least)
