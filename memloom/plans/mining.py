"""Queries of chunks, stated preferences, names and vector duplicates with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import chunks as ch
from memloom.operators import preferences as pr
from memloom.operators import vectors as vec
from memloom.sources import views as v

CHARS, CHARS_OVER, WORDS, WORDS_OVER = 400, 40, 40, 8
#: What the parts' messages say before and after a part's name, by p_partkey modulo 9.
SAYINGS = (
    ("I really like ", " because it is sweet. Nothing else matters"), ("Well. My favorite color is ", ", truly! See you"), ("I hate ", " and more! I love jazz and beer"),
    ("I don't want ", "?"), ("Some of ", " is overrated"), ("I am a morning coffee person. ", ""), ("I usually go for trips, mostly.\nI can't stand ", ";:"),
    ("I like so ", "and on"), ("", ""),
)


def _said(s, d):
    p = v.table(s, d, "part")
    place = F.col("p_partkey") % len(SAYINGS)
    ends = [F.element_at(F.array(*[F.lit(x[i]) for x in SAYINGS]), (place + 1).cast("int")) for i in (0, 1)]
    return p.select(F.col("p_partkey").alias("id"), F.concat(ends[0], "p_name", ends[1]).alias("content"))


def _seen(s, d):
    return v.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Saw "), F.upper("p_name"), F.lit(" and more of "), F.initcap("p_type"), F.lit(" It")).alias("content"))


def _texts(s, d):
    return v.table(s, d, "documents").select("doc_id", "text")


def _digested(chunks):
    return chunks.select("doc_id", "place", "start", "end", F.md5("text").alias("digest"))


def _twins(s, d):
    """Pairs of vectors of one label, one among the other's five nearest, lesser id first."""
    all_ = v.vectors(s, d)
    near = vec.knn_join(all_, all_, 5, "label").filter(F.col("score") >= 0.2)
    return near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.round("score", 6).alias("score")).distinct()


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _told_sql() -> str:
    line = "chr(10)"
    said = " ".join(f"WHEN {i} THEN {_quoted(a.replace(chr(10), '<NL>'))} || p_name || {_quoted(b)}" for i, (a, b) in enumerate(SAYINGS))
    found = " ".join(
        f"WHEN regexp_matches(s, {_quoted(p)}, 'is') THEN {{'sentiment': '{kind}', 'confidence': {c}::DOUBLE, 'raw': regexp_extract(s, {_quoted(p)}, 1, 'is')}}"
        for kind, patterns in (("positive", pr.POSITIVE), ("negative", pr.NEGATIVE)) for p, c in patterns
    )
    hits = ", ".join("(" + " + ".join(f"contains(lower(s), '{w}')::INT" for w in words) + ")" for words in pr.CATEGORIES.values())
    names = ", ".join(f"'{c}'" for c in pr.CATEGORIES)
    bare = r"regexp_replace(trim({0}), '[.,!?;:]+$', '')"
    own = f"trim(regexp_replace({bare.format('f.raw')}, {_quoted(pr.CLAUSES + '.*$')}, '', 's'))"
    return f"""WITH m AS (SELECT p_partkey AS id, replace(CASE p_partkey % {len(SAYINGS)} {said} END, '<NL>', {line}) AS content FROM part),
      l AS (SELECT id, string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || {line}, 'g'), {line}) AS parts FROM m),
      s AS (SELECT id, unnest(parts) AS raw_s, generate_subscripts(parts, 1) - 1 AS place FROM l),
      t AS (SELECT id, CAST(place AS INT) AS place, trim(raw_s) AS s FROM s WHERE length(trim(raw_s)) >= {pr.LEAST}),
      f AS (SELECT *, CASE {found} END AS f, [{hits}] AS h FROM t),
      r AS (SELECT id, place, f.sentiment AS sentiment, regexp_replace({own}, '[.,!?;:]+$', '') AS preference,
        CASE WHEN list_max(h) = 0 THEN 'general' ELSE ([{names}])[list_position(h, list_max(h))] END AS category, f.confidence AS confidence, s AS sentence FROM f WHERE f IS NOT NULL)
      SELECT * FROM r WHERE length(preference) > 2"""


def _end(start: str) -> str:
    """SQL of a chunk's end by its start."""
    hard = f"least({start} + {CHARS}, length(text))"
    low = f"greatest({hard} - {ch.NEAR}, {start})"
    stop = f"length(regexp_extract(substring(text, {low} + 1, {hard} - {low}), '^(.*[.!?]\\s+)', 1, 's'))"
    return f"CASE WHEN {hard} < length(text) AND {stop} > 0 THEN {low} + {stop} ELSE {hard} END"


NORM = "sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[])))"
COSINE = f"list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / ({NORM.format('a.embedding')} * {NORM.format('b.embedding')})"

QUERIES = {
    "EX-10_chunks_by_chars": lambda s, d: _digested(ch.chunks_by_chars(_texts(s, d), CHARS, CHARS_OVER)),
    "EX-11_chunks_by_words": lambda s, d: _digested(ch.chunks_by_words(_texts(s, d), WORDS, WORDS_OVER)),
    "TX-01_preferences": lambda s, d: pr.preferences(_said(s, d)),
    "TX-03_name_runs": lambda s, d: pr.name_runs(_seen(s, d)),
    "DD-09_duplicate_pairs": _twins,
}
ORACLES = {
    "EX-10_chunks_by_chars": f"""WITH RECURSIVE c AS (SELECT doc_id, text, 0::BIGINT AS place, 0::BIGINT AS s, CAST({_end('0')} AS BIGINT) AS e FROM documents WHERE length(text) > 0
      UNION ALL SELECT doc_id, text, place + 1, e - {CHARS_OVER}, CAST({_end(f'(e - {CHARS_OVER})')} AS BIGINT) FROM c WHERE e < length(text))
      SELECT doc_id, CAST(place AS INT) AS place, s AS start, e AS "end", md5(substring(text, s + 1, e - s)) AS digest FROM c""",
    "EX-11_chunks_by_words": f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\\s*\\S+') AS ws FROM documents WHERE text <> ''),
      u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM t),
      p AS (SELECT doc_id, i, CAST(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e, length(regexp_replace(w, '^\\s+', '')) AS n FROM u),
      x AS (SELECT t.doc_id, text, CAST(a.i // {WORDS - WORDS_OVER} AS INT) AS place, a.e - a.n AS s,
          b.e + CASE WHEN a.i + {WORDS} < len(ws) THEN length(regexp_extract(substring(text, b.e + 1, {ch.NEAR}), '^.*?[.!?]\\s', 0, 's')) ELSE 0 END AS e
        FROM t JOIN p a USING (doc_id) JOIN p b ON b.doc_id = t.doc_id AND b.i = least(a.i + {WORDS}, len(ws)) - 1
        WHERE len(ws) > {WORDS} AND a.i % {WORDS - WORDS_OVER} = 0 AND (a.i + {WORDS_OVER} < len(ws)))
      SELECT doc_id, place, s AS start, e AS "end", md5(substring(text, s + 1, e - s)) AS digest FROM x
      UNION ALL SELECT doc_id, 0, 0, length(text), md5(text) FROM t WHERE len(ws) <= {WORDS}""",
    "TX-01_preferences": _told_sql(),
    "TX-03_name_runs": """WITH m AS (SELECT p_partkey AS id, string_split('Saw ' || upper(p_name) || ' and more of ' ||
          array_to_string(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1]) || x[2:]), ' ') || ' It', ' ') AS w FROM part),
      r AS (SELECT id, w[i:i + 3] AS r FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM m)),
      n AS (SELECT id, r, coalesce(nullif(list_position(list_transform(r, lambda x: regexp_matches(x, '^[A-Z]')), false), 0) - 1, len(r)) AS n FROM r)
      SELECT DISTINCT id, array_to_string(r[1:n], ' ') AS name FROM n WHERE n > 1 AND length(r[1]) > 2""",
    "DD-09_duplicate_pairs": f"""WITH s AS (SELECT a.vec_id AS i, b.vec_id AS o, {COSINE} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, o) AS k FROM s)
      SELECT DISTINCT least(i, o) AS a, greatest(i, o) AS b, round(score, 6) AS score FROM r WHERE k <= 5 AND score >= 0.2""",
}
