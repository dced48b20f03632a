"""Query and SQL of the SpotSigs fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm.shared import documents
from memloom.llm.spotsigs import COMMON, edited_fingerprints


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir, "doc_id", "text"))


def _sets(name: str, words: str) -> str:
    """SQL for a table of doc_id and its signatures s, from the column of word lists `words` of the table words.

    Content words are numbered within a text; an anchor's chain has the numbers
    after that of the last content word before it.
    """
    common = "(" + ", ".join(f"'{w}'" for w in COMMON) + ")"
    return f"""
{name}_w AS (SELECT doc_id, unnest({words}) AS w, unnest(range(1, len({words}) + 1)) AS k FROM words),
{name}_c AS (SELECT doc_id, k, w, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM {name}_w WHERE w NOT IN {common}),
{name}_a AS (
  SELECT doc_id, w, r FROM (
    SELECT doc_id, w, w IN {common} AS anchor, sum(CASE WHEN w IN {common} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS r FROM {name}_w)
  WHERE anchor),
{name}_s AS (
  SELECT a.doc_id, list_sort(list_distinct(list(substr(md5(a.w || ' ' || x.w || ' ' || y.w), 1, 8)))) AS s
  FROM {name}_a a JOIN {name}_c x ON x.doc_id = a.doc_id AND x.r = a.r + 1 JOIN {name}_c y ON y.doc_id = a.doc_id AND y.r = a.r + 2 GROUP BY a.doc_id),
{name} AS (
  SELECT doc_id, CASE WHEN f.s IS NOT NULL THEN f.s WHEN len({words}) > 0 THEN [substr(md5(array_to_string({words}, ' ')), 1, 8)] ELSE [] END AS s
  FROM words LEFT JOIN {name}_s f USING (doc_id))"""


def _words(text: str) -> str:
    return rf"list_filter(string_split(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _likeness(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE {common}::DOUBLE / (len({a}) + len({b}) - {common}) END"


QUERIES = {"op8_spotsigs": op8_spotsigs}
ORACLES = {
    "op8_spotsigs": f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
sequence AS (
  SELECT doc_id, text, length(text) AS n,
         coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS next_id FROM texts),
edits AS (
  SELECT s.*, substr(s.text, 1, (n - n // 2)::BIGINT) || substr(t.text, 1, (n // 2)::BIGINT) AS edited
  FROM sequence s JOIN texts t ON t.doc_id = s.next_id),
words AS (SELECT doc_id, next_id, n, edited, {_words('text')} AS w, {_words('edited')} AS e FROM edits),
{_sets('own', 'w')}, {_sets('changed', 'e')}
SELECT t.doc_id, t.n AS n_chars, sha256(t.edited) AS edited_sha256, array_to_string(a.s, '') AS fingerprint,
       array_to_string(c.s, '') AS edited_fingerprint,
       {_likeness('a.s', 'c.s')} AS near_edited, {_likeness('a.s', 'b.s')} AS near_next
FROM words t JOIN own a ON a.doc_id = t.doc_id JOIN changed c ON c.doc_id = t.doc_id JOIN own b ON b.doc_id = t.next_id"""
}
