"""Query and SQL of the near-duplicate components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm.neardup import near_duplicates
from memloom.llm.shared import documents


def op9_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"), words=4, percent=80)


QUERIES = {"op9_minhash_near_duplicates": op9_minhash_near_duplicates}
ORACLES = {
    "op9_minhash_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, least) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.least FROM reach r JOIN edges e ON e.a = r.node WHERE r.least < e.b)
SELECT r.node AS doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(r.least) AS component_id, min(r.least) = r.node AS kept
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.node GROUP BY r.node"""
}
