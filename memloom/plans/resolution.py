"""Queries of entity resolution and its metrics with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import resolution as rs
from memloom.sources import views as v


def _parts(s, d):
    p = v.table(s, d, "part")
    name = F.concat(F.lit("The "), "p_name", F.lit(", Inc."))
    return p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.lit("ORGANIZATION").alias("type")).withColumn("key", rs.name_key(F.col("name"), F.col("type")))


def _mentions(s, d):
    """Upper-case part names, every third with its last word gone."""
    p = v.table(s, d, "part")
    cut = F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace("p_name", r" [^ ]+$", "")).otherwise(F.col("p_name"))
    return p.select((F.col("p_partkey") + 1_000_000).alias("id"), F.upper(cut).alias("name"), F.lit("ORGANIZATION").alias("type")).withColumn("key", rs.name_key(F.col("name"), F.col("type")))


def _clusters(s, d):
    return v.table(s, d, "lineitem").select(F.col("l_suppkey").alias("predicted"), (F.col("l_partkey") % 50).alias("gold"))


def _items(s, d, column: str):
    return v.table(s, d, "lineitem").select(F.col("l_returnflag").alias("type"), (F.col(column) % 200).alias("item"))


KEYED = """WITH e AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^\\pL\\pN&]+', ' ', 'g')) AS key FROM part),
  m AS (SELECT p_partkey + 1000000 AS id, trim(regexp_replace(lower(CASE WHEN p_partkey % 3 = 0 THEN regexp_replace(p_name, ' [^ ]+$', '') ELSE p_name END),
    '[^\\pL\\pN&]+', ' ', 'g')) AS key FROM part),
  eb AS (SELECT DISTINCT id, unnest(['<' || split_part(key, ' ', 1), '>' || split_part(key, ' ', -1)]) AS block FROM e),
  mb AS (SELECT DISTINCT id, unnest(['<' || split_part(key, ' ', 1), '>' || split_part(key, ' ', -1)]) AS block FROM m),
  ok AS (SELECT block FROM eb GROUP BY block HAVING count(*) <= 60),
  p AS (SELECT DISTINCT mb.id AS mention, eb.id AS entity FROM mb JOIN ok USING (block) JOIN eb USING (block))"""

_CASES = (
    ("Co Op Bank Ltd", "ORG"), ("Dr. Ada Lovelace Jr.", "PERSON"), ("Henry Tudor IV", "USER"), ("John Mr Smith", "PERSON"), ("Sony NV", "COMPANY"),
    ("The", "ORGANIZATION"), ("The The", "ORGANIZATION"), ("Inc", "ORGANIZATION"), ("!!", "PERSON"), ("AT&T Inc.", "ORGANIZATION"),
)

QUERIES = {
    "RS-01_key_cases": lambda s, d: s.createDataFrame(_CASES, "name string, type string").select("name", rs.name_key(F.col("name"), F.col("type")).alias("key")),
    "RS-01_name_keys": lambda s, d: v.entity_observations(s, d).select("seq", rs.name_key(F.col("name"), F.col("type")).alias("key")),
    "RS-01_name_entropy": lambda s, d: v.table(s, d, "nation").select("n_nationkey", F.round(rs.entropy(F.lower("n_name")), 6).alias("bits"), rs.initials(F.lower("n_name")).alias("initials")),
    "RS-02_exact_blocking": lambda s, d: rs.exact_matches(_mentions(s, d), _parts(s, d)),
    "RS-03_end_word_blocking": lambda s, d: rs.block_pairs(_mentions(s, d), _parts(s, d)),
    "RS-09_decisions": lambda s, d: rs.resolved(_mentions(s, d), _parts(s, d)).select("mention", "score", "action"),
    "RS-11_gazetteer": lambda s, d: rs.gazetteer(v.table(s, d, "part").select(F.lower("p_name").alias("key"), F.col("p_brand").alias("canonical"))),
    "MT-01_entity_scores": lambda s, d: rs.matched(_items(s, d, "l_partkey"), _items(s, d, "l_suppkey"), ["type", "item"]),
    "MT-04_b_cubed": lambda s, d: rs.b_cubed(_clusters(s, d)).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]),
}
ORACLES = {
    "RS-01_name_keys": f"""{v.with_sql('entity_obs')}, w AS (
        SELECT seq, type, regexp_replace(trim(regexp_replace(lower(name), '[^\\pL\\pN&]+', ' ', 'g')), '^((the|a|an) )+', '') AS k FROM entity_obs)
      SELECT seq, CASE WHEN type = 'ORGANIZATION' THEN regexp_replace(k, '( ({'|'.join(rs.LEGAL_FORMS)}))+$', '')
        WHEN type = 'PERSON' THEN regexp_replace(regexp_replace(k, '^(({'|'.join(rs.TITLES)}) )+', ''), '( ({'|'.join(rs.SUFFIXES)}))+$', '') ELSE k END AS key FROM w""",
    "RS-01_key_cases": """SELECT * FROM (VALUES ('Co Op Bank Ltd', 'co op bank'), ('Dr. Ada Lovelace Jr.', 'ada lovelace'), ('Henry Tudor IV', 'henry tudor'),
      ('John Mr Smith', 'john mr smith'), ('Sony NV', 'sony'), ('The', 'the'), ('The The', 'the'), ('Inc', 'inc'), ('!!', '!!'), ('AT&T Inc.', 'at&t')) t(name, key)""",
    "RS-02_exact_blocking": f"{KEYED}, k AS (SELECT key, min(id) AS entity FROM e GROUP BY key) SELECT m.id AS mention, entity FROM m JOIN k USING (key)",
    "RS-03_end_word_blocking": f"{KEYED} SELECT * FROM p",
    "RS-09_decisions": f"""{KEYED}, ek AS (SELECT DISTINCT key FROM e), mk AS (SELECT DISTINCT key FROM m),
      s AS (SELECT mk.key, max(CASE WHEN mk.key = ek.key THEN 1.0::DOUBLE ELSE
        2 * len(list_intersect(string_split(mk.key, ' '), string_split(ek.key, ' '))) /
        (len(list_distinct(string_split(mk.key, ' '))) + len(list_distinct(string_split(ek.key, ' '))))::DOUBLE END) AS score
        FROM mk JOIN ek ON split_part(mk.key, ' ', 1) = split_part(ek.key, ' ', 1) OR split_part(mk.key, ' ', -1) = split_part(ek.key, ' ', -1) GROUP BY mk.key)
      SELECT m.id AS mention, round(score, 6) AS score, CASE WHEN score >= 0.9 THEN 'merged' WHEN score >= 0.85 THEN 'review' ELSE 'created' END AS action
      FROM m LEFT JOIN s ON s.key = m.key""",
    "RS-11_gazetteer": "SELECT lower(p_name) AS key, min(p_brand) AS canonical FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1",
    "RS-01_name_entropy": """WITH c AS (SELECT n_nationkey, n_name, unnest(string_split(lower(n_name), '')) AS c FROM nation),
      n AS (SELECT n_nationkey, n_name, c, count(*)::DOUBLE AS n FROM c WHERE c <> ' ' GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY n_nationkey) AS t FROM n)
      SELECT n_nationkey, round(sum(-(n / t) * log2(n / t)), 6) AS bits, upper(array_to_string(list_transform(string_split(any_value(lower(n_name)), ' '), lambda w: w[1]), '')) AS initials
      FROM t GROUP BY n_nationkey""",
    "MT-01_entity_scores": """WITH p AS (SELECT l_returnflag AS type, l_partkey % 200 AS item, count(*) AS p FROM lineitem GROUP BY ALL),
      g AS (SELECT l_returnflag AS type, l_suppkey % 200 AS item, count(*) AS g FROM lineitem GROUP BY ALL),
      b AS (SELECT type, coalesce(p, 0) AS p, coalesce(g, 0) AS g FROM p FULL JOIN g USING (type, item)),
      c AS (SELECT type, CAST(sum(least(p, g)) AS BIGINT) AS tp, CAST(sum(p - least(p, g)) AS BIGINT) AS fp, CAST(sum(g - least(p, g)) AS BIGINT) AS fn FROM b GROUP BY type)
      SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + (fp + fn) / 2), 6) AS f1 FROM c""",
    "MT-04_b_cubed": """WITH c AS (SELECT l_suppkey AS p, l_partkey % 50 AS g, count(*) AS n FROM lineitem GROUP BY ALL),
      w AS (SELECT n, sum(n) OVER (PARTITION BY p) AS np, sum(n) OVER (PARTITION BY g) AS ng FROM c),
      r AS (SELECT sum(n * n / np) / sum(n) AS precision, sum(n * n / ng) / sum(n) AS recall FROM w)
      SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM r""",
}
