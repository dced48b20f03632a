"""Personal data by weak supervision, in DataFrame functions only.

Method. Beside the base patterns, loose generators propose spans: runs of
capitalised words, groups of digits, handles, street addresses and account
numbers. Labelers vote on each proposal, for, against or abstaining: patterns
(forms of numbers, dates and versions, digit counts, check sums), gazetteers
(titles, given names, surnames, ordinary words) and context (the words before,
the case of the neighbours). Votes are counted over all documents;
expectation-maximisation on these counts estimates how reliable each labeler is
and how likely each pattern of votes is personal data. A logistic regression on
the spans' features, fitted to these probabilities, is the final classifier: it
alone decides on proposed spans. Base spans that pass their checks always stay,
and take no part in the training.

The estimate starts from stated beliefs about each labeler (BELIEFS), which keep
a share of PRIOR of its weight, at every size of the corpus: where no proposal is
personal data, as in most corpora of plain prose, the classes don't drift.

There are 3 ** 9 patterns of votes and 2 ** 14 of features at most, so what
reaches the driver is bounded, whatever the corpus. The texts are read twice,
once to count and once to decide; nothing but counts is shuffled.

Defined cases. A null text is empty and has no spans; masked, it stays null. An
empty table, or one without proposals, has base spans only. Equal rows get equal
spans. Of proposed spans that overlap a base span none is added, and of those
that overlap one another the kind later in KINDS goes. Very long texts are
searched whole. Further columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import cut
from memloom.llm.skew import fresh_prefix
from memloom.llm.spans import find, listing, masked, overlaps, parts, tagged

BASE_KINDS = ("email", "ip", "card", "phone")
LOOSE_KINDS = ("iban", "address", "handle", "number", "name")
KINDS = (*BASE_KINDS, *LOOSE_KINDS)
ROUNDS, STEPS = 60, 40
#: The beliefs' share of the weight of all spans, and their least weight in spans.
PRIOR, LEAST_PRIOR = 0.1, 50.0
#: A proposed span is added from this probability on.
LEAST_PROBABILITY = 0.8
#: Letters before and after a span that context labelers read.
CONTEXT, AFTER = 32, 4

# Base patterns, written so that no run is tried from each of its letters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
# Words of the gazetteers and of the context labelers.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Don|Doña"
GIVEN_NAMES = (
    "Ahmed|Alice|Ana|Andrea|Anna|Anne|Antonio|Barbara|Carlos|Charles|Claire|Daniel|David|Elena|Elizabeth|Emma|Fatima|Francisco|"
    "Frank|Hans|Ivan|James|Jane|Jean|Jennifer|John|José|Juan|Julia|Karl|Klaus|Laura|Linda|Louis|Lucia|Luis|Manuel|Maria|María|"
    "Marie|Mark|Martin|Mary|Michael|Mohammed|Nicolas|Olga|Patricia|Paul|Peter|Petra|Pierre|Richard|Robert|Sarah|Sofia|Sophie|"
    "Stefan|Susan|Thomas|William|Wolfgang"
)
SURNAMES = (
    "Becker|Bernard|Brown|Davis|Dubois|Fernández|Fischer|Garcia|García|Gonzalez|González|Johnson|Jones|Lopez|López|Martin|"
    "Martinez|Martínez|Meyer|Miller|Moreau|Müller|Petit|Rodriguez|Rodríguez|Sanchez|Sánchez|Schmidt|Schneider|Schulz|Smith|"
    "Taylor|Wagner|Weber|Williams|Wilson"
)
ORDINARY = (
    "A|An|And|Any|Apache|April|At|August|Avenue|By|City|Company|Copyright|County|Court|December|Der|Die|El|En|February|For|"
    "Foundation|Free|From|General|He|High|I|If|In|Is|It|January|July|June|La|Le|Les|Library|License|Licence|Los|March|May|New|No|"
    "North|November|October|Of|On|Or|Public|Road|September|She|South|State|States|Street|That|The|This|To|Und|United|University|"
    "Version|Was|We|West|With|You"
)
CALLS = (
    "tel|phone|call|mobile|fax|contact|ssn|passport|account|iban|telefon|téléphone|teléfono|handy|konto|name is|named|signed|dear|"
    "sincerely|regards|patient|born|lives at|living at|address|adresse|reach me at"
)
OTHERS = (
    "version|release|page|pages|chapter|figure|fig|table|isbn|issn|doi|line|section|part|price|total|year|years|license|licence|no|"
    "nr|build|rfc|item|order|model|ratio|in|since|until|from|v"
)
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Place|Terrace"
CAP = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}++(?:-\p{Lu}\p{Ll}++)?+"
NAME = (
    rf"(?<![\p{{L}}\p{{N}}])(?!(?:Dear|Hello|Hi|From|To|Contact|Call)\x20)(?:(?:{TITLES})\.?+\x20{CAP}(?:\x20{CAP}){{0,2}}+|"
    rf"{CAP}(?:\x20{CAP}){{1,3}}+|(?<=(?:name is|named|signed|Dear|dear)\x20){CAP})(?![\p{{L}}\p{{N}}])"
)
NUMBER = r"(?:\G|(?<![0-9]))(?:\(?[0-9]{2,4}+\)?[\x20./-]?[0-9]{2,4}+(?:[\x20./-][0-9]{2,6}+)++|[0-9]{7,16}+(?![0-9]))"
HANDLE = r"(?<![\p{L}\p{N}@._%+-])@[A-Za-z_][A-Za-z0-9_]{2,29}+(?![A-Za-z0-9_@])"
ADDRESS = rf"(?<![0-9\p{{L}}])[0-9]{{1,5}}+[A-Za-z]?\x20(?:{CAP}\x20){{1,3}}?(?:{STREETS})\b|\p{{Lu}}\p{{Ll}}+?(?:straße|strasse|gasse|weg)\x20[0-9]{{1,4}}+|\b(?:rue|calle|avenida|avenue)\x20(?:de\x20)?(?:la\x20)?{CAP}\x20[0-9]{{1,4}}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
DATE = (
    r"^(?:(?:1[89]|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]|[0-3]?[0-9][./-][0-3]?[0-9][./-](?:(?:1[89]|20)[0-9]{2}|[0-9]{2})|"
    r"(?:1[89]|20)[0-9]{2}(?:[\x20/-](?:1[89]|20)?[0-9]{2})++)$"
)
VERSION = r"^[0-9]++(?:\.[0-9]++){1,4}+$"
STRICT = (
    r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^\(?0[0-9]{1,4}\)?[\x20/-][0-9]{3,4}[\x20-][0-9]{3,4}$|"
    r"^0[0-9](?:[\x20.][0-9]{2}){4}$"
)

#: Labelers, with the beliefs of the start: P(for | personal), P(for | not), P(against | personal), P(against | not).
BELIEFS = {
    "form": (0.4, 0.01, 0.01, 0.3), "digit count": (0.2, 0.14, 0.02, 0.2), "check sum": (0.15, 0.005, 0.02, 0.05),
    "title": (0.15, 0.002, 0.001, 0.001), "given name": (0.25, 0.005, 0.001, 0.001), "surname": (0.2, 0.005, 0.001, 0.001),
    "ordinary words": (0.001, 0.001, 0.01, 0.4), "context": (0.4, 0.02, 0.02, 0.15), "neighbours": (0.4, 0.25, 0.02, 0.3),
}
LABELERS = tuple(BELIEFS)
#: Features of the classifier, with the weights that it starts from; the last is the intercept.
FEATURES = {
    "account": 3.5, "address": 3.0, "handle": 2.6, "name": -0.5, "strict form": 3.5, "9 to 11 digits": 0.3, "date": -3.0, "version": -4.0,
    "check sum": 1.5, "called for": 2.5, "other context": -3.0, "title or given name": 3.5, "surname": 2.5, "ordinary words or neighbours": -4.5,
    "any": -1.0,
}
#: How strongly the weights keep to these, as a share of all spans' weight: features that few spans have keep theirs.
KEEP = 0.02


def words_of(words: str) -> str:
    """A pattern for one of the words, whole."""
    return rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"


def candidates(text: Column) -> Column:
    """All proposed spans: kind, start, end, match, ok (a base span that passes its checks)."""
    digits = text.rlike("[0-9]")
    found = {
        "email": find(text, EMAIL, text.contains("@")),
        "ip": find(text, IP, digits & text.contains(".")),
        "card": find(text, CARD, digits),
        "phone": find(text, PHONE, text.contains("+")),
        "iban": find(text, IBAN, text.rlike("[A-Z]{2}[0-9]{2}")),
        "address": find(text, ADDRESS, digits),
        "handle": find(text, HANDLE, text.contains("@")),
        "number": find(text, NUMBER, digits),
        "name": find(text, NAME, text.rlike(rf"\p{{Lu}}\p{{Ll}}+\x20\p{{Lu}}|(?:{TITLES})\.?\x20\p{{Lu}}|(?:name is|named|signed|[Dd]ear)\x20\p{{Lu}}")),
    }

    def ok(kind: str, m: Column) -> Column:
        plain = F.regexp_replace(m, "[^0-9]", "")
        size = F.length(plain)
        return {
            "email": F.lit(True),
            "ip": m.rlike(IP_PARTS),
            "card": size.between(12, 19) & F.call_function("luhn_check", plain),
            "phone": size.between(9, 15),
        }.get(kind, F.lit(False))

    def all_of(kind: str) -> Column:
        return F.transform(
            tagged(found[kind], kind), lambda s: F.struct(*parts(s), ok(kind, s["match"]).alias("ok"))
        )

    return F.concat(*map(all_of, KINDS))


def mod_97(account: Column) -> Column:
    """The remainder by which account numbers are checked: their first four signs go last, letters count from 10."""
    plain = F.regexp_replace(account, r"\x20", "")
    signs = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        n = F.conv(c, 36, 10).cast("int")
        return (acc * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.aggregate(signs, F.lit(0), step)


def judged(text: Column, spans: Column) -> Column:
    """spans with votes (-1, 0 or 1 of each labeler) and features (0 or 1 each)."""

    def vote(yes: Column, no: Column) -> Column:
        return F.when(no, -1).when(yes, 1).otherwise(0)

    never = F.lit(False)

    def one(s: Column) -> Column:
        m, kind = s["match"], s["kind"]
        plain = F.regexp_replace(m, "[^0-9]", "")
        size = F.length(plain)
        at = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = F.substring(text, at + 1, s["start"] - at)
        after = F.substring(text, s["end"] + 1, F.lit(AFTER))
        low = F.lower(before)
        number, name = kind == "number", kind == "name"
        is_date, is_version = m.rlike(DATE), m.rlike(VERSION)
        strict = number & ~is_date & m.rlike(STRICT)
        calls = low.rlike(rf"(?<!\p{{L}})(?:{CALLS})[^\p{{L}}]{{0,4}}$")
        others = low.rlike(rf"(?<!\p{{L}})(?:{OTHERS})[^\p{{L}}]{{0,3}}$") | before.rlike(r"[$€£#]\x20?$")
        title = name & m.rlike(words_of(TITLES))
        given = name & m.rlike(words_of(GIVEN_NAMES))
        family = name & m.rlike(words_of(SURNAMES))
        ordinary = name & (m.rlike(words_of(ORDINARY)) | m.rlike(r"(\p{Lu}\p{Ll}+)\x20\1(?!\p{L})"))
        crowded = name & (before.rlike(r"\p{Lu}[\p{L}'’,.-]*\x20$") | after.rlike(r"^[,.]?\x20\p{Lu}"))
        inside = before.rlike(r"\p{Ll},?\x20$") & ~crowded
        form = strict | kind.isin("iban", "address", "handle")
        checked = ((kind == "iban") & (mod_97(m) == 1)) | (number & size.between(13, 19) & F.call_function("luhn_check", plain))
        votes = F.array(
            vote(form, number & (is_date | is_version)),
            vote(number & size.between(9, 11), number & (size < 7)),
            vote(checked, (kind == "iban") & ~checked),
            vote(title, never),
            vote(given, never),
            vote(family, never),
            vote(never, ordinary),
            vote(calls, (number | name) & others & ~calls),
            vote(inside, crowded),
        )
        features = F.array(
            *[
                x.cast("int")
                for x in (
                    kind == "iban", kind == "address", kind == "handle", name, strict, number & size.between(9, 11), number & is_date, number & is_version & ~is_date,
                    checked, calls, others & ~calls, title | given, family, ordinary | crowded,
                )
            ]
        )
        return F.struct(*parts(s), votes.alias("votes"), features.alias("features"))

    return F.transform(spans, one)


def believed() -> list[list[list[float]]]:
    """P(vote | class) by class, labeler and vote (against, abstaining, for), as believed at the start."""
    rows = BELIEFS.values()
    return [[[no, 1 - yes - no, yes] for yes, no in pairs] for pairs in ([(b[1], b[3]) for b in rows], [(b[0], b[2]) for b in rows])]


def reliabilities(counts: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[list[list[float]]]]:
    """(share of personal data, P(vote | class) by class, labeler and vote) by expectation-maximisation.

    The beliefs count as PRIOR of all spans, at least LEAST_PRIOR, in each round.
    """
    start = believed()
    n = len(start[0])
    prior = max(LEAST_PRIOR, PRIOR * sum(w for _, w in counts))
    share, table = 0.25, start
    for _ in range(ROUNDS):
        seen = [[[prior * x for x in row] for row in rows] for rows in start]
        total = [0.75 * prior, 0.25 * prior]
        for votes, weight in counts:
            p = posterior(votes, share, table)
            for y, q in ((0, 1 - p), (1, p)):
                total[y] += weight * q
                for k in range(n):
                    seen[y][k][votes[k] + 1] += weight * q
        share = min(0.99, max(0.01, total[1] / sum(total)))
        table = [[[x / sum(row) for x in row] for row in seen[y]] for y in range(2)]
    return share, table


def posterior(votes: tuple[int, ...], share: float, table: list[list[list[float]]]) -> float:
    """The probability of personal data; a labeler that abstains says nothing."""
    odds = math.log(share / (1 - share))
    for k, v in enumerate(votes):
        if v:
            odds += math.log(table[1][k][v + 1] / table[0][k][v + 1])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def logistic(rows: list[tuple[tuple[int, ...], float, float]]) -> list[float]:
    """Weights of FEATURES, by Newton steps from the given ones, to which KEEP pulls them.

    A row holds features, the mean of its soft labels, and their number.
    """
    given = list(FEATURES.values())
    n, w = len(given), given
    scale = sum(c for _, _, c in rows)
    for _ in range(STEPS):
        slope = [KEEP * (g - x) for g, x in zip(given, w, strict=True)]
        bend = [[KEEP * (i == j) for j in range(n)] for i in range(n)]
        for f, p, c in rows:
            on = [i for i, x in enumerate(f) if x] + [n - 1]
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in on)))))
            for i in on:
                slope[i] += c / scale * (p - q)
                for j in on:
                    bend[i][j] += c / scale * q * (1 - q)
        step = _solve(bend, slope)
        w = [a + b for a, b in zip(w, step, strict=True)]
        if max(map(abs, step)) < 1e-8:
            break
    return w


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination for a positive definite matrix."""
    m = [[*row, x] for row, x in zip(a, b, strict=True)]
    for i in range(len(m)):
        for j in range(i + 1, len(m)):
            r = m[j][i] / m[i][i]
            m[j] = [x - r * y for x, y in zip(m[j], m[i], strict=True)]
    out = [0.0] * len(m)
    for i in reversed(range(len(m))):
        out[i] = (m[i][-1] - sum(m[i][j] * out[j] for j in range(i + 1, len(m)))) / m[i][i]
    return out


def fit(docs: DataFrame, text_col: str = "text") -> list[float] | None:
    """The span classifier's weights from all proposed spans of all documents; None without any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    loose = F.filter(candidates(F.col("text")), lambda s: s["kind"].isin(*LOOSE_KINDS))
    spans = docs.select(text.alias("text")).withColumn("c", loose).filter(F.size("c") > 0)
    one = spans.select(F.explode(judged(F.col("text"), F.col("c"))).alias("s"))
    groups = cut(one.groupBy("s.votes", "s.features").agg(F.count("*").alias("n")))
    counted = groups.groupBy("votes").agg(F.sum("n").alias("n")).collect()  # 3 ** 9 patterns at most
    if not counted:
        return None
    share, table = reliabilities(sorted((tuple(r["votes"]), r["n"]) for r in counted))
    odds = F.lit(math.log(share / (1 - share)))
    for k in range(len(LABELERS)):
        ratios = [F.lit(math.log(a / b) if v else 0.0) for v, a, b in zip((-1, 0, 1), table[1][k], table[0][k], strict=True)]
        odds = odds + F.get(F.array(*ratios), F.get("votes", F.lit(k)) + 1)
    likely = 1 / (1 + F.exp(-odds))
    soft = groups.groupBy("features").agg(F.sum("n").alias("n"), F.sum(F.col("n") * likely).alias("p")).collect()  # 2 ** 14 at most
    return logistic(sorted((tuple(r["features"]), r["p"] / r["n"], float(r["n"])) for r in soft))


def with_spans(docs: DataFrame, weights: list[float] | None, text_col: str = "text", prefix: str = "_pii_") -> DataFrame:
    """docs with the columns base and all (arrays of spans), their names prefixed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, proposed, every = (f"{prefix}{x}" for x in ("base", "proposed", "all"))

    def likely(s: Column) -> Column:
        odds = F.aggregate(
            F.zip_with(s["features"], F.array(*map(F.lit, weights[:-1])), lambda x, w: x * w), F.lit(weights[-1]), lambda a, x: a + x
        )
        return odds >= math.log(LEAST_PROBABILITY / (1 - LEAST_PROBABILITY))

    rank = F.array(*map(F.lit, KINDS))

    def place(s: Column) -> Column:
        return F.array_position(rank, s["kind"])

    plain = F.transform(base, lambda s: F.struct(*parts(s)))
    # A match of a base pattern that fails its checks is never added.
    loose = F.filter(proposed, lambda s: s["kind"].isin(*LOOSE_KINDS) & ~F.exists(base, lambda b: overlaps(s, b)))
    out = docs.withColumn(proposed, candidates(text)).withColumn(base, F.filter(proposed, lambda s: s["ok"]))
    if weights is None:
        return out.withColumn(every, plain).drop(proposed)
    # The added spans are bound once by a transform of one element.
    chosen = F.array(F.transform(F.filter(judged(text, loose), likely), lambda s: F.struct(*parts(s))))
    added = F.element_at(
        F.transform(chosen, lambda all_: F.filter(all_, lambda s: ~F.exists(all_, lambda b: (place(b) < place(s)) & overlaps(s, b)))), 1
    )
    # Most texts have no proposal; for them nothing is judged.
    return out.withColumn(every, F.when(F.exists(proposed, lambda s: s["kind"].isin(*LOOSE_KINDS)), F.concat(plain, added)).otherwise(plain)).drop(proposed)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base and spans, arrays of (kind, start, end, match) in code points."""
    slim = docs.select(id_col, text_col)
    return with_spans(slim, fit(slim, text_col), text_col).select(
        id_col, F.col("_pii_base").alias("base"), F.col("_pii_all").alias("spans")
    )


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every found span replaced by its kind, such as <EMAIL>; null texts stay null."""
    prefix = fresh_prefix(docs.columns, "_pii_")
    found = with_spans(docs, fit(docs, text_col), text_col, prefix)
    return found.withColumn(text_col, masked(F.col(text_col), F.col(f"{prefix}all"))).select(*docs.columns)


def digest(found: DataFrame, kinds: tuple[str, ...], base_kinds: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """id, counts by base kind and of all spans, SHA-256 of the base listing, and the listing of all spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, base_kinds)
    return found.select(
        id_col, *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(listing(F.col("base"), kinds), 256).alias("base_sha256"),
        listing(F.col("spans"), kinds).alias("spans"),
    )
