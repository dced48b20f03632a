"""Query and SQL of the source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm.mix import mix_sources
from memloom.llm.shared import documents


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir, "doc_id", "text", "source"))


QUERIES = {"op5_mix_sources": op5_mix_sources}
ORACLES = {
    "op5_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 't') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR || 'mix-1', 'mix-1' || coalesce(text, ''))) AS k
  FROM documents),
per AS (SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src),
ranked AS (SELECT *, ((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM ranked
  WINDOW b AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fit AS (SELECT level FROM levels WHERE level <= cap / w ORDER BY cap / w, src LIMIT 1),
target AS (SELECT src, source_size, least(cap::DOUBLE, (SELECT level FROM fit) * w) AS target FROM ranked),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         (sum(s.size) OVER (PARTITION BY s.src ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS before,
         coalesce(floor(t.target)::BIGINT // nullif(t.source_size, 0), 0)::BIGINT AS passes
  FROM sized s JOIN target t USING (src))
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, floor(target)::BIGINT - passes * source_size - before)))::BIGINT AS taken
FROM placed"""
}
