"""Graph queries with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import graph as g
from memloom.sources import views as v

G = v.with_sql("edge")
U = f"{G}, u AS (SELECT src AS a, dst AS b, type FROM edge UNION ALL SELECT dst, src, type FROM edge), l AS (SELECT DISTINCT a, b FROM u)"
START, END = 1_000_001, 2_000_003


def _ranks(rounds: int) -> str:
    """PageRank as a chain of common table expressions."""
    steps = [
        f"""{G}, k AS (SELECT DISTINCT src, dst FROM edge), o AS (SELECT src, count(*) AS degree FROM k GROUP BY src),
        n AS (SELECT node, degree, (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM k UNION ALL SELECT dst FROM k)) AS n
          FROM (SELECT src AS node FROM k UNION SELECT dst FROM k) LEFT JOIN o ON o.src = node),
        r0 AS (SELECT node, degree, n, 1.0::DOUBLE / n AS rank FROM n)"""
    ]
    for i in range(rounds):
        steps.append(f"""g{i} AS (SELECT dst AS node, sum(rank / degree) AS got FROM k JOIN r{i} ON node = src GROUP BY dst),
        d{i} AS (SELECT coalesce(sum(rank), 0) AS loose FROM r{i} WHERE degree IS NULL),
        r{i + 1} AS (SELECT n.node, n.degree, n.n, 0.15::DOUBLE / n.n + 0.85::DOUBLE * (coalesce(got, 0) + loose / n.n) AS rank FROM n LEFT JOIN g{i} USING (node), d{i})""")
    return ",\n".join(steps) + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


def _numbered(s, d):
    """The edges, numbered by their ends, and those between suppliers and the customers of their number."""
    e = v.edges(s, d)
    twin = v.table(s, d, "supplier").select((F.lit(2_000_000) + F.col("s_suppkey")).cast("long").alias("src"), (F.lit(1_000_000) + F.col("s_suppkey")).cast("long").alias("dst"), F.lit("SERVES").alias("type"))
    return e.unionAll(twin).withColumn("seq", F.col("src") * 10_000_000 + F.col("dst"))


def _starts(s):
    return s.createDataFrame([(START,), (END,), (4_000_001,)], "id long")


def _walked(df):
    return df.select("start", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"), F.array_join("types", ",").alias("types"), "hops")


QUERIES = {
    "GA-01_neighbours_3_hops": lambda s, d: g.reach(v.edges(s, d), s.createDataFrame([(START,), (END,)], "id long"), 3),
    "GA-02_edges_around": lambda s, d: g.edges_around(_numbered(s, d), _starts(s), 3),
    "GA-02_edges_of_types": lambda s, d: g.edges_around(_numbered(s, d), _starts(s), 2, ["SERVES", "LOCATED_AT"]),
    "GA-02_paths": lambda s, d: _walked(g.paths(_numbered(s, d), _starts(s), 3)),
    "GA-02_paths_of_types": lambda s, d: _walked(g.paths(_numbered(s, d), _starts(s), 3, ["SERVES", "HEADQUARTERS_AT"])),
    "GA-02_first_paths": lambda s, d: _walked(g.paths(_numbered(s, d), _starts(s), 3, limit=50)),
    "GA-03_shortest_path": lambda s, d: g.shortest_path(v.edges(s, d), START, END).select(F.array_join("path", ",").alias("path"), F.col("length").cast("long").alias("length")),
    "GA-04_pagerank": lambda s, d: g.pagerank(v.edges(s, d), 5).select("node", F.round("rank", 9).alias("rank")),
    "GA-05_degree_centrality": lambda s, d: g.degree_centrality(v.edges(s, d)),
    "GA-06_components": lambda s, d: g.components(v.edges(s, d).filter("type <> 'PART_OF'")),
    "GA-06_label_spreading": lambda s, d: g.label_spreading(v.edges(s, d), 2),
    "GA-07_least_neighbour": lambda s, d: g.least_neighbour(v.edges(s, d)),
    "GA-08_similar": lambda s, d: g.similar(v.edges(s, d), START, 20),
    "GA-09_central_entities": lambda s, d: g.pagerank(v.edges(s, d), 5).orderBy(F.desc("rank"), "node").limit(10).select("node"),
    "GA-10_one_hop": lambda s, d: g.undirected(v.edges(s, d)).filter("a = 3000003 and type = 'HEADQUARTERS_AT'"),
    "GX-04_export": lambda s, d: g.exported(
        v.table(s, d, "nation").select((F.lit(3_000_000) + F.col("n_nationkey")).cast("long").alias("id"), F.lit("LOCATION").alias("label")), v.edges(s, d)
    ),
    "GX-06_expand": lambda s, d: g.expand(v.edges(s, d), 3_000_003, s.range(4_000_000, 4_000_009)),
}
def _walks(where: str = "true", tail: str = "") -> str:
    """All paths of three steps without a repeated edge, as a recursion."""
    return f"""{G.replace("WITH", "WITH RECURSIVE", 1)}, k AS (SELECT src, dst, type, src * 10000000 + dst AS seq FROM
        (SELECT src, dst, type FROM edge UNION ALL SELECT 2000000 + s_suppkey, 1000000 + s_suppkey, 'SERVES' FROM supplier) WHERE {where}),
      t AS (SELECT src AS a, dst AS b, type, seq FROM k UNION ALL SELECT dst, src, type, seq FROM k),
      w AS (SELECT CAST(x AS BIGINT) AS start, [CAST(x AS BIGINT)] AS ns, []::VARCHAR[] AS ts, []::BIGINT[] AS used, 0 AS hops FROM (VALUES ({START}), ({END}), (4000001)) v(x)
        UNION ALL SELECT start, list_append(ns, b), list_append(ts, type), list_append(used, seq), hops + 1 FROM w JOIN t ON a = ns[-1] WHERE hops < 3 AND NOT list_contains(used, seq))
      SELECT start, array_to_string(ns, ',') AS nodes, array_to_string(ts, ',') AS types, hops FROM w WHERE hops > 0 {tail}"""


def _around(hops: int, where: str = "true") -> str:
    """The distinct edges that some path of at most `hops` steps uses."""
    walks = _walks(where)
    return f"""{walks[: walks.index("SELECT start, array_to_string")]} SELECT DISTINCT start, src, dst, type FROM (SELECT start, unnest(used) AS seq FROM w WHERE hops <= {hops}) JOIN k USING (seq)"""


ORACLES = {
    "GA-02_edges_around": _around(3),
    "GA-02_edges_of_types": _around(2, "type IN ('SERVES', 'LOCATED_AT')"),
    "GA-02_paths": _walks(),
    "GA-02_paths_of_types": _walks("type IN ('SERVES', 'HEADQUARTERS_AT')"),
    "GA-02_first_paths": _walks(tail="ORDER BY hops, start, ns, used LIMIT 50"),
    "GA-01_neighbours_3_hops": f"""{U.replace("WITH", "WITH RECURSIVE", 1)}, w AS (SELECT x AS start, x AS node, 0 AS hops FROM (VALUES ({START}), ({END})) t(x)
      UNION SELECT start, b, hops + 1 FROM w JOIN l ON a = node WHERE hops < 3)
      SELECT CAST(start AS BIGINT) AS start, CAST(node AS BIGINT) AS node, min(hops) AS hops FROM w GROUP BY start, node HAVING min(hops) > 0""",
    "GA-03_shortest_path": f"""{U.replace("WITH", "WITH RECURSIVE", 1)}, w AS (SELECT CAST({START} AS BIGINT) AS node, [CAST({START} AS BIGINT)] AS path
      UNION SELECT b, list_append(path, b) FROM w JOIN l ON a = node WHERE len(path) < 5 AND NOT list_contains(path, b)
        AND (b >= 3000000 OR b = {END}))
      SELECT array_to_string(path, ',') AS path, len(path) - 1 AS length FROM w WHERE node = {END} ORDER BY len(path), path LIMIT 1""",
    "GA-04_pagerank": _ranks(5),
    "GA-05_degree_centrality": f"{U}, c AS (SELECT a AS node, count(*) AS n FROM u GROUP BY a) SELECT node, n / (SELECT max(n) FROM c) AS score FROM c",
    "GA-06_components": f"""{U}, c AS (SELECT * FROM u WHERE type <> 'PART_OF')
      SELECT a AS node, min(least(a, b, m)) OVER (PARTITION BY CASE WHEN a >= 3000000 THEN a ELSE b END) AS component
      FROM (SELECT DISTINCT a, CASE WHEN a >= 3000000 THEN a ELSE b END AS b, CASE WHEN a >= 3000000 THEN b ELSE a END AS m FROM c)
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY m) = 1""",
    "GA-06_label_spreading": f"""{U}, r1 AS (SELECT a AS node, min(b) AS c FROM l GROUP BY a), r1v AS (SELECT a, c, count(*) AS n FROM l JOIN r1 ON node = b GROUP BY a, c)
      SELECT a AS node, arg_max(c, (n, -c)) AS community FROM r1v GROUP BY a""",
    "GA-07_least_neighbour": f"{U} SELECT a AS node, min(b) AS community FROM u GROUP BY a",
    "GA-08_similar": f"""{U}, h AS (SELECT a, count(*) AS shared FROM l WHERE b IN (SELECT b FROM l WHERE a = {START}) AND a <> {START} GROUP BY a),
      g AS (SELECT a, count(*) AS degree FROM l GROUP BY a)
      SELECT a AS node, shared, shared / (degree + 1) AS score FROM h JOIN g USING (a) ORDER BY score DESC, node LIMIT 20""",
    "GA-09_central_entities": _ranks(5).replace("SELECT node, round(rank, 9) AS rank", "SELECT node") + " ORDER BY rank DESC, node LIMIT 10",
    "GA-10_one_hop": f"{U} SELECT a, b, type FROM u WHERE a = 3000003 AND type = 'HEADQUARTERS_AT'",
    "GX-04_export": f"""{G} SELECT 'node' AS part, 3000000 + n_nationkey AS id, NULL::BIGINT AS other, 'LOCATION' AS label FROM nation
      UNION ALL SELECT 'relationship', src, dst, type FROM edge""",
    "GX-06_expand": f"{U} SELECT DISTINCT b AS id, type FROM u WHERE a = 3000003 AND NOT b BETWEEN 4000000 AND 4000008",
}
