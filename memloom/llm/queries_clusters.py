"""Query and SQL of the exponion clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm.clusters import cluster

ROUNDS = 10


def op12_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=ROUNDS, width=64)


def _round(n: int) -> str:
    """Assignment a{n} to the centroids c{n}, and the centroids c{n + 1} that follow."""
    return f"""
a{n} AS (
  SELECT row, cluster, distance FROM (
    SELECT v.row, c.cluster, (list_inner_product(v.e, v.e) + list_inner_product(c.e, c.e) - 2 * list_inner_product(v.e, c.e))::BIGINT AS distance
    FROM v CROSS JOIN c{n} c)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1),
s{n} AS (
  SELECT cluster, list(m ORDER BY i) AS e FROM (
    SELECT cluster, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::DOUBLE AS m
    FROM (SELECT a.cluster, unnest(v.e)::HUGEINT AS x, unnest(range(64)) AS i FROM a{n} a JOIN v USING (row)) GROUP BY cluster, i)
  GROUP BY cluster),
c{n + 1} AS (SELECT c.cluster, coalesce(s.e, c.e) AS e FROM c{n} c LEFT JOIN s{n} s USING (cluster))"""


QUERIES = {"op12_exponion_clusters": op12_exponion_clusters}
ORACLES = {
    "op12_exponion_clusters": f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY key NULLS LAST, e) - 1 AS cluster, e
  FROM (SELECT sha256('3:' || vec_id) AS key, e FROM v) QUALIFY row_number() OVER (ORDER BY key NULLS LAST, e) <= 8),
{",".join(_round(n) for n in range(ROUNDS))},
{_round(ROUNDS).split("s10 AS")[0].strip().rstrip(",")},
t AS (SELECT cluster, sum(distance)::BIGINT AS s FROM a{ROUNDS} GROUP BY cluster)
SELECT v.vec_id, a.cluster::INT AS cluster, a.distance, t.s AS cluster_inertia, (SELECT sum(s)::BIGINT FROM t) AS inertia,
  sha256(array_to_string(list_transform(c.e, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} a USING (row) JOIN c{ROUNDS} c USING (cluster) JOIN t USING (cluster)"""
}
