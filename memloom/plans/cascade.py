"""Queries of the score cascade and its resolvers with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import cascade as ca
from memloom.operators import scores as sc
from memloom.plans import resolution as rp
from memloom.sources import views as v

#: case, type, names, vector, contexts, alias groups, and the score and kind of evidence that the rules give.
CASES = (
    ("equal", "PERSON", "Ada Lovelace", "ada lovelace", None, None, None, None, None, 1.0, "exact"),
    ("aliases", "LOCATION", "Big Apple", "New York", None, None, None, ["nyc"], ["nyc", "ny"], 1.0, "alias"),
    ("no shared group", "LOCATION", "Kansas", "Kansas City", None, None, None, ["ks"], ["kc"], 0.88, "prefix"),
    ("acronym", "ORGANIZATION", "N.W.L.", "North West Lines", None, None, None, None, None, 0.97, "acronym"),
    ("no acronym of a person", "PERSON", "ITS", "Isabel Turner Smith", None, None, None, None, None, None, None),
    ("prefix", "ORGANIZATION", "Apple", "Apple Bank", None, None, None, None, None, 0.88, "prefix"),
    ("prefix with vectors", "ORGANIZATION", "Apple", "Apple Bank", 0.99, None, None, None, None, 0.88, "prefix"),
    ("prefix in context", "ORGANIZATION", "Northwind", "Northwind Logistics", None, "ships freight from the depot", "from the depot freight ships daily", None, None, 0.92, "prefix"),
    ("same source", "ORGANIZATION", "Northwind", "Northwind Logistics", None, "ships freight", "it SHIPS  freight daily", None, None, 0.88, "prefix"),
    ("few bits", "PERSON", "Turner", "Isabel Turner", None, None, None, None, None, 0.65, "fuzzy"),
    ("inside", "PERSON", "Lovelace King", "Ada Lovelace King", None, None, None, None, None, 0.85, "fuzzy"),
    ("word order", "PERSON", "Lovelace Ada", "Ada Lovelace", None, None, None, None, None, 1.0, "fuzzy"),
    ("order and vectors", "PERSON", "Lovelace Ada", "Ada Lovelace", 0.5, None, None, None, None, 0.764706, "both"),
)
SCHEMA = "case string, type string, name_a string, name_b string, vector double, context_a string, context_b string, group_a array<string>, group_b array<string>, want double, kind string"
#: Pairs of keys whose scorers have values that follow from whole words.
SCORED = (
    ("new york university", "new york", "token_set_ratio", 1.0), ("ada lovelace", "lovelace ada", "token_sort_ratio", 1.0), ("isabel turner", "turner", "partial_ratio", 1.0),
    ("isabel turner", "turner", "WRatio", 0.9), ("isabel turner", "turner", "ratio", 0.631579), ("", "turner", "fuzzy", 0.0), ("abcd", "bcde", "ratio", 0.75), ("ab", "cd", "fuzzy", 0.0),
)


def _judged(s, d):
    cases = s.createDataFrame(CASES, SCHEMA)
    keys = {k: ca.rs.name_key(F.col(f"name_{k}"), F.col("type")) for k in ("a", "b")}
    seen = F.col("want").isNotNull()
    judged = ca.judged(cases.withColumns(keys))
    # where no rule fixes the score, only that it stays below the review band is told
    return judged.select("case", F.when(seen, F.round("score", 6)).alias("score"), F.when(seen, F.col("match")).alias("match"), (F.col("score") >= ca.rs.REVIEW).alias("found"))


def _scored(s, d):
    rows = s.createDataFrame(SCORED, "a string, b string, scorer string, want double")
    each = [F.when(F.col("scorer") == n, sc.score(n, "a", "b")) for n in sc.SCORERS]
    return rows.select("a", "b", "scorer", F.round(F.coalesce(*each), 6).alias("score"))


def _thresholds(s):
    return s.createDataFrame([("PERSON", 0.95, 0.9)], "type string, auto double, review double")


def _cascaded(s, d):
    return ca.cascaded(rp._mentions(s, d), rp._parts(s, d), _thresholds(s))


def _swapped(s, d):
    """Part names with their first word last, and the parts of one size and brand with each."""
    p = v.table(s, d, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    m = p.select(F.col("p_partkey").alias("mention"), F.regexp_replace(F.upper("p_name"), r"^(\S+) (.*)$", "$2  $1").alias("name"), "p_size", "p_brand")
    return m, p.select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("other"), "p_size", "p_brand"), ["p_size", "p_brand"]


def _unmatched(s, d):
    """Part names of each brand, every second one with its first word last."""
    p = v.table(s, d, "part")
    key = F.when(F.col("p_partkey") % 2 == 0, F.regexp_replace("p_name", r"^(\S+) (.*)$", "$2 $1")).otherwise(F.col("p_name"))
    return p.select(F.col("p_brand").alias("episode"), F.lit("OBJECT").alias("type"), F.col("p_partkey").alias("id"), key.alias("key"))


def _values(rows) -> str:
    def one(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x).lower()

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


WORDS = "list_sort(string_split(lower({0}), ' '))"
QUERIES = {
    "RS-09_cascade_cases": _judged,
    "RS-05_equal_keys_first": lambda s, d: _cascaded(s, d).filter("match = 'exact'").select("mention", "entity", "score", "action"),
    "RS-09_cascade": _cascaded,
    "RS-14_second_pass": lambda s, d: ca.anchored(_unmatched(s, d), "token_sort_ratio", 0.999),
    "RS-17_fuzzy_resolver": lambda s, d: ca.fuzzy_among(*_swapped(s, d), threshold=0.999),
    "STR-01_scorers": _scored,
}
ORACLES = {
    "RS-09_cascade_cases": f"""SELECT "case", score, match, coalesce(score >= 0.85, false) AS found FROM (VALUES {_values([(c[0], c[9], c[10]) for c in CASES])}) t("case", score, match)""",
    "RS-05_equal_keys_first": f"""{rp.KEYED} SELECT m.id AS mention, min(e.id) AS entity, 1.0::DOUBLE AS score, 'merged' AS action FROM m JOIN e USING (key) GROUP BY m.id""",
    "RS-14_second_pass": f"""SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand, {WORDS.format('p_name')}) AS anchor_id, 1.0::DOUBLE AS score FROM part""",
    "RS-17_fuzzy_resolver": f"""SELECT a.p_partkey AS mention, min(b.p_partkey) AS entity, 1.0::DOUBLE AS score FROM part a JOIN part b
      ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND {WORDS.format('a.p_name')} = {WORDS.format('b.p_name')} GROUP BY 1""",
    "STR-01_scorers": f"SELECT * FROM (VALUES {_values(SCORED)}) t(a, b, scorer, score)",
}
