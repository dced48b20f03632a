"""Secrets by character Markov models, in DataFrame functions only.

Method. First-order Markov models over letters, digits and a few marks are trained
from labelled samples: one on random strings, and one on each form of ordinary ones:
words and identifiers, and codes of lower and of upper case (hashes, UUIDs, numbers,
runs of the alphabet). Codes stand apart, so that hexadecimal digits do not make
every mixture of letters and digits look ordinary. A token of SHORTEST signs or more is scored by the
log-likelihood ratio of its first sign and its transitions, random against the
likeliest ordinary form. It becomes a span if the ratio exceeds the margin for its length and
nothing else is asked of it; base patterns (assignments, access keys, long hexadecimal
runs) always stay. The model of words is blended with one that sees only the kinds of signs (small,
capital, digit, mark), by BLEND: words of other languages are strange letter by letter, but
not in the order of kinds.

Margins come from samples that were kept out of training: in each range of lengths, what
all but one in HELD_PASS of the ordinary ones stay below, and SAFETY nats more.
Identifiers are held out by word: one word in four builds identifiers for the margins alone.
Tokens shorter than SHORTEST hold too few signs for the ratio to decide and are not scored.

Samples are a DataFrame of (text, random) and, where known, form and held. The default ones are
random strings drawn by hashing; identifiers in usual styles, half of them of a word list and half of at most
SAMPLE_WORDS words of documents, least hash first; codes; and, as ordinary text, all words of up to 64 letters
of at most SAMPLE_DOCS documents. Transitions are counted in Spark; the tables have one number for
each pair of signs, whatever the corpus. Texts are searched once, in place, with no shuffle.

Defined cases. A null text is empty and has no spans. A text without long tokens
gets base spans only, an empty table no rows. A ratio equal to the margin is no
secret. Equal texts get equal spans. Very long texts are searched whole. Further
columns, whatever their names, take no part.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.pii import digest
from memloom.llm.shared import cut
from memloom.llm.spans import find, no_spans, overlaps, parts, tagged

__all__ = ["BASE_KINDS", "KINDS", "digest", "find_secrets"]

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
#: Documents whose words are samples of ordinary text, and strings drawn of each form.
SAMPLE_DOCS, SAMPLE_DRAWN = 2000, 3000
#: Words of documents that build identifiers.
SAMPLE_WORDS = 4000
#: Forms of samples; a token's ratio is its least one over the ordinary forms.
RANDOM, ORDINARY = "random", ("words", "lower", "upper")
#: The weight of the kinds of signs in each form's model.
BLEND = {"random": 0.02, "words": 0.2, "lower": 0.001, "upper": 0.001}
#: The shortest token to score, and the least length of each further range of lengths.
SHORTEST, LONGER = 10, (13, 16, 20, 25, 33)
#: Of how many ordinary samples one may pass, and what is added to the margin, in nats.
HELD_PASS, SAFETY = 5000, 4.0
SIGNS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(SIGNS)
#: The row of the table for a token's first sign.
FIRST = SIZE

# Base patterns, and the tokens that the models score.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]++"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = rf"(?<![\p{{L}}\p{{N}}+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}+(?![\p{{L}}\p{{N}}])"
# Words of which ordinary identifiers are made.
WORDS = (
    "get set user name value index count list item file path read write open close start stop time date table "
    "column row key data model view load save update delete insert select query result error message config "
    "option default server client request response session account order product price total number string "
    "array object class method function module package version release build test check parse format convert "
    "input output buffer stream thread process memory cache storage network address image color width height "
    "usr local bin lib home var etc src opt tmp http www com org html json python java main docs assets static"
)


# Short names in capitals that stand in identifiers.
CAPITALS = "XML HTTP JSON SQL API URL HTML CSS ID UI IO DB TCP UDP DNS SSH PDF CSV UTF GPU CPU"


def find_assignments(text: Column, maybe: Column) -> Column:
    """Spans of ASSIGN whose assigned part has six letters or more."""
    spans = find(text, ASSIGN, maybe)
    assigned = F.when(maybe, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>"))
    both = F.zip_with(spans, assigned, lambda s, a: F.when(F.length(a) >= 6, s))
    return F.filter(both, lambda s: s.isNotNull())


def base_spans(text: Column) -> Column:
    found = (
        ("assign", find_assignments(text, text.contains("=") | text.contains(":"))),
        ("access", F.filter(find(text, ACCESS, text.contains("AKIA")), lambda s: F.length(s["match"]) >= 20)),
        ("hex", find(text, HEX, text.rlike("[0-9a-f]{24}"))),
    )
    return F.concat(*(tagged(s, kind) for kind, s in found))


def kept_out(word: str) -> bool:
    """Whether a word (small letters) builds identifiers for the margins alone."""
    return zlib.crc32(word.encode()) % 4 == 0


def identifiers(spark: SparkSession, words: list[str], salt: str, n: int) -> DataFrame:
    """(text): n times the usual styles of identifiers of one to three of the words, drawn by hash."""
    pool, short = F.split(F.lit(" ".join(words)), " "), F.split(F.lit(CAPITALS), " ")

    def pick(pool: Column, k: int) -> Column:
        return F.element_at(pool, (F.pmod(F.xxhash64(F.lit(salt), "id", F.lit(k)), F.size(pool)) + 1).cast("int"))

    drawn = spark.range(n).select("id", *[pick(pool, k).alias(c) for k, c in enumerate("abc")], pick(short, 3).alias("s"), F.pmod(F.xxhash64(F.lit(salt), "id", F.lit(4)), F.lit(400)).cast("string").alias("d"))
    a, b, c, s, d = map(F.col, "abcsd")
    big_a, big_b, big_c = map(F.initcap, (a, b, c))
    made = (
        F.concat_ws("_", a, b, c), F.concat_ws("-", a, b, c), F.concat_ws("/", a, b, c), F.concat_ws("/", F.lit(""), a, b, c), F.concat_ws("-", a, b), F.concat(a, b), F.concat(a, b, c),
        F.concat(a, big_b, big_c), F.concat(big_a, big_b, big_c), F.upper(F.concat_ws("_", a, b)), F.upper(F.concat_ws("_", a, b, c)), F.upper(F.concat(a, b)), F.concat_ws("_", a, b, d),
        F.concat(s, big_a, big_b), F.concat(big_a, s, big_b), F.concat(big_a, big_b, d), F.concat(F.concat_ws("-", big_a, d), F.lit("_"), F.length(b).cast("string")), F.concat_ws("-", big_a, big_b),
        F.concat(a, big_b, d, big_c), F.concat(F.lower(s), big_a, d, s),
    )
    return drawn.select(F.explode(F.array(*made)).alias("text"))


def default_samples(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, random, form, held): drawn random strings and codes; identifiers and words, of a list and of a bounded number of documents."""

    def drawn(salt: str) -> DataFrame:
        return spark.range(SAMPLE_DRAWN).select("id", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"))

    def labelled(rows: DataFrame, form: str, held: Column | None = None) -> DataFrame:
        own = F.pmod(F.xxhash64("text"), F.lit(4)) == 0 if held is None else held
        return rows.select("text", F.lit(form == RANDOM).alias("random"), F.lit(form).alias("form"), own.alias("held"))

    code = F.base64(F.unhex("h"))
    plain = F.regexp_replace(code, "[+/=]", "")
    size = (F.lit(SHORTEST) + F.pmod("id", F.lit(31))).cast("int")
    small = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.char(F.lit(97) + F.conv(F.substring(F.col("h"), k * 2 + 1, F.lit(2)), 16, 10).cast("int") % 26)), "")
    forms = (code, F.substring(plain, F.lit(1), size), F.upper(F.substring(plain, 1, 20)), F.lower(F.substring(plain, F.lit(1), size)), F.substring(small, F.lit(1), size))
    random = drawn("r").select(F.explode(F.array(*forms)).alias("text"))
    pieces = [F.substring("h", x, n) for x, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    digits = F.substring(F.regexp_replace("h", "[a-f]", ""), 1, 16)
    codes = (
        F.concat_ws("-", *pieces), F.substring("h", 1, 12), F.substring("h", 1, 40), digits,
        F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)),
        F.repeat(F.substring(F.lit(SIGNS), F.pmod("id", F.lit(SIZE)).cast("int") + 1, F.lit(1)), (F.lit(SHORTEST) + F.col("id") / SIZE).cast("int")),
        F.substring(F.lit(SIGNS[:26]), F.pmod("id", F.lit(16)).cast("int") + 1, size), F.substring(F.lit("0123456789" * 5), F.pmod("id", F.lit(10)).cast("int") + 1, size),
    )
    lower = drawn("o").select(F.explode(F.array(*codes)).alias("text"))
    few = docs.select(id_col).filter(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_DOCS)
    text = docs.select(id_col, text_col).join(F.broadcast(few.distinct()), id_col)
    ordinary = text.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"(?<![\p{L}\p{N}+/_=-])[A-Za-z]{3,64}+(?![\p{L}\p{N}+/_=-])"), F.lit(0))).alias("text"))
    ordinary = cut(ordinary.groupBy("text").agg(F.count("*").alias("n")))
    known = ordinary.select(F.lower("text").alias("w")).distinct().orderBy(F.xxhash64("w"), "w").limit(SAMPLE_WORDS)
    lists = {"list": WORDS.split(), "docs": [r["w"] for r in known.collect()]}
    out = labelled(random, RANDOM).unionAll(labelled(lower, "lower")).unionAll(labelled(lower.select(F.upper("text").alias("text")), "upper"))
    for name, words in lists.items():
        for held in (False, True):
            own = sorted(w for w in words if kept_out(w) == held)
            if own:
                built = identifiers(spark, own, f"{name}{held}", SAMPLE_DRAWN // (4 if held else 2))
                out = out.unionAll(labelled(built, "words", F.lit(held)))
    repeated = ordinary.select(F.lower("text").alias("w"), F.explode(F.array("text", F.upper("text"))).alias("text"))
    return out.unionAll(labelled(repeated, "words", F.crc32(F.col("w").cast("binary")) % 4 == 0))


def length_range(size: Column) -> Column:
    """The place of a token's length among the ranges."""
    return sum(((size >= n).cast("int") for n in LONGER), F.lit(0))


def kind_of(sign: int) -> int:
    """Small letter, capital, digit, mark; the begin of a token."""
    return (sign >= 26) + (sign >= 52) + (sign >= 62) + (sign >= FIRST)


def logs(seen: list[list[float]], blend: float) -> list[float]:
    """Log probabilities of each sign after each sign, by place before * SIZE + sign, from counts.

    With the weight `blend` the next sign's kind follows the kind before, and within its
    kind half the weight goes by the sign's own rate, half to all signs alike.
    """
    kinds = [kind_of(s) for s in range(SIZE)]
    members = [kinds.count(k) for k in range(4)]
    rate = [sum(row[s] for row in seen) for s in range(SIZE)]
    of_kind = [sum(r for r, k in zip(rate, kinds, strict=True) if k == j) for j in range(4)]
    follows = [[sum(seen[a][s] for a in range(SIZE + 1) if kind_of(a) == k for s in range(SIZE) if kinds[s] == j) for j in range(4)] for k in range(5)]
    out = []
    for before in range(SIZE + 1):
        total, row = sum(seen[before]), follows[kind_of(before)]
        for s in range(SIZE):
            j = kinds[s]
            coarse = row[j] / sum(row) * 0.5 * (rate[s] / of_kind[j] + 1 / members[j])
            out.append(math.log((1 - blend) * seen[before][s] / total + blend * coarse))
    return out


def train(samples: DataFrame) -> list[list[float]]:
    """For each ordinary form that has samples the log ratio of each first sign's and transition's probabilities, random over ordinary."""
    whole = samples.filter(F.col("text").rlike("^[A-Za-z0-9+/_=-]{2,}$"))
    signs = whole.select("form", F.split("text", "").alias("c"))
    ahead = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda x, y: F.concat(x, y))
    pairs = signs.select("form", F.explode(F.concat(F.slice("c", 1, 1), ahead)).alias("pair"))
    rows = pairs.groupBy("form", "pair").agg(F.count("*").alias("n"))
    place = {c: k for k, c in enumerate(SIGNS)}
    seen = {f: [[0.3] * SIZE for _ in range(SIZE + 1)] for f in (RANDOM, *ORDINARY)}
    found = set()
    for r in rows.collect():  # at most SIZE * (SIZE + 1) pairs of each form
        before = FIRST if len(r["pair"]) == 1 else place[r["pair"][0]]
        seen[r["form"]][before][place[r["pair"][-1]]] += r["n"]
        found.add(r["form"])
    random = logs(seen[RANDOM], BLEND[RANDOM])
    kept = [f for f in ORDINARY if f in found] or ["words"]
    return [[x - y for x, y in zip(random, logs(seen[f], BLEND[f]), strict=True)] for f in kept]


def table_of(weights: list[list[float]]) -> Column:
    """The tables one after another, as a constant."""
    return F.split(F.lit(",".join(f"{w:.6g}" for table in weights for w in table)), ",").cast("array<double>")


def ratio(token: Column, table: Column, forms: int) -> Column:
    """Log-likelihood ratio of a token of SIGNS only: the least one over the tables of so many ordinary forms."""

    def step(acc: Column, c: Column) -> Column:
        here = F.instr(F.lit(SIGNS), c) - 1
        sums = [(acc[f"sum{k}"] + F.get(table, acc["last"] * SIZE + here + k * SIZE * (SIZE + 1))).alias(f"sum{k}") for k in range(forms)]
        return F.struct(here.alias("last"), *sums)

    begin = F.struct(F.lit(FIRST).alias("last"), *[F.lit(0.0).alias(f"sum{k}") for k in range(forms)])
    return F.aggregate(F.split(token, ""), begin, step, lambda acc: F.least(*[acc[f"sum{k}"] for k in range(forms)]) if forms > 1 else acc["sum0"])


def margins(held: DataFrame, weights: list[list[float]]) -> list[float]:
    """Per range of lengths, the ratio that a secret must exceed, from ordinary samples kept out of training.

    A range without samples takes the margin of the one below it.
    """
    known = held.filter(~F.col("random") & F.col("text").rlike(f"^[A-Za-z0-9+/_=-]{{{SHORTEST},}}$")).select("text").distinct()
    scored = known.select(length_range(F.length("text")).alias("range"), ratio(F.col("text"), table_of(weights), len(weights)).alias("ratio"))
    high = scored.groupBy("range").agg(F.percentile_approx("ratio", 1 - 1 / HELD_PASS, 10 * HELD_PASS).alias("m"))
    found = {r["range"]: r["m"] for r in high.collect()}
    out: list[float] = []
    for k in range(len(LONGER) + 1):
        out.append(max(0.0, found[k]) + SAFETY if k in found else (out[-1] if out else SAFETY))
    return out


def fit(samples: DataFrame) -> tuple[list[list[float]], list[float]]:
    """(tables of log ratios, margins) from labelled samples (text, random).

    Samples without the columns form and held are words unless random, and one in four is kept for the margins.
    """
    if "form" not in samples.columns:
        samples = samples.withColumn("form", F.when(F.col("random"), RANDOM).otherwise(ORDINARY[0]))
    if "held" not in samples.columns:
        samples = samples.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(4)) == 0)
    samples = cut(samples.filter(F.col("text").isNotNull() & F.col("random").isNotNull()))
    weights = train(samples.filter(~F.col("held")))
    return weights, margins(samples.filter("held"), weights)


def with_secrets(docs: DataFrame, model: tuple[list[list[float]], list[float]], text_col: str = "text", prefix: str = "_secret_") -> DataFrame:
    """docs with the columns base and all (arrays of spans), their names prefixed."""
    weights, least = model
    base, tokens, every = (f"{prefix}{x}" for x in ("base", "tokens", "all"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    table, bounds = table_of(weights), F.array(*map(F.lit, least))
    out = docs.withColumn(base, base_spans(text)).withColumn(tokens, find(text, TOKEN, text.rlike(f"[A-Za-z0-9+/_=-]{{{SHORTEST}}}")))
    random = F.filter(tokens, lambda s: ratio(s["match"], table, len(weights)) > F.get(bounds, length_range(F.length(s["match"]))))
    alone = F.filter(random, lambda s: ~F.exists(base, lambda b: overlaps(s, b)))
    found = F.when(F.size(tokens) > 0, alone).otherwise(no_spans())
    plain = F.transform(base, lambda s: F.struct(*parts(s)))
    return out.withColumn(every, F.concat(plain, tagged(found, "random"))).drop(tokens)


def find_secrets(
    docs: DataFrame, samples: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, base and spans, arrays of (kind, start, end, match) in code points."""
    slim = docs.select(id_col, text_col)
    model = fit(samples if samples is not None else default_samples(docs.sparkSession, slim, id_col, text_col))
    return with_secrets(slim, model, text_col).select(
        id_col, F.col("_secret_base").alias("base"), F.col("_secret_all").alias("spans")
    )
