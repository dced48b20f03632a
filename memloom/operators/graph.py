"""Graph traversal and ranking over an edge table (src, dst, type), level by level.

Iterations cut their lineage by checkpoint() in the shared folder, so that a
lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.sources.shared import cut

MOST_HOPS = 3


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, type) in both directions."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type").unionAll(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "type"))


def reach(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, hops): every node within 1..hops steps of each start (column id), with its least number of steps."""
    links = undirected(edges).select("a", "b").distinct()
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hops")).distinct()
    seen = front
    for n in range(1, max(1, min(hops, MOST_HOPS)) + 1):
        step = front.join(links, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        front = cut(step.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(n)))
        seen = seen.unionAll(front)
    return seen.filter("hops > 0")


def shortest_path(edges: DataFrame, source: int, target: int, most: int = 5) -> DataFrame:
    """(path, length) of one shortest undirected path, or no row: of equally short ones the least by its nodes.

    Each level keeps one path a node, so the frontier never exceeds the nodes.
    """
    spark = edges.sparkSession
    links = undirected(edges).select("a", "b").distinct()
    front = spark.range(1).select(F.lit(source).cast("long").alias("node"), F.array(F.lit(source).cast("long")).alias("path"))
    seen = front.select("node")
    for _ in range(most + 1):
        hit = front.filter(F.col("node") == target)
        if not hit.isEmpty():
            return hit.select("path", (F.size("path") - 1).alias("length"))
        step = front.join(links, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        front = cut(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        seen = seen.unionAll(front.select("node"))
    return front.limit(0).select("path", F.lit(0).alias("length"))


def _of_types(edges: DataFrame, types: list[str] | None) -> DataFrame:
    """The edges of the types whose ends are both known."""
    whole = edges.filter("src is not null and dst is not null")
    return whole if types is None else whole.filter(F.col("type").isin(*types))


def edges_around(edges: DataFrame, starts: DataFrame, hops: int, types: list[str] | None = None) -> DataFrame:
    """(start, src, dst, type): every edge on a path of 1..hops steps from a start (column id) over edges of the given types, whatever its direction.

    No path is walked for it: an edge lies on such a path exactly if one of its ends
    is less than `hops` steps away, so the work grows with nodes and edges and not with paths.
    """
    own = _of_types(edges, types).select("src", "dst", "type").distinct()
    hops = max(1, min(hops, MOST_HOPS))
    near = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    if hops > 1:
        near = cut(near.unionAll(reach(own, starts, hops - 1).select("start", "node")).distinct())
    out = [near.join(own, F.col("node") == F.col(end)).select("start", "src", "dst", "type") for end in ("src", "dst")]
    return out[0].unionAll(out[1]).distinct()


def paths(edges: DataFrame, starts: DataFrame, hops: int, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(start, nodes, types, hops): every path of 1..hops steps that uses no edge twice, in either direction, from each start (column id).

    edges has seq, the number of an edge; equal edges of different numbers are different. With a
    limit the first paths over all starts are returned, by (hops, start, nodes, edge numbers): then no level
    holds more than `limit` paths, as walking ends once there are that many. Without one the result is
    as large as the graph makes it. A start without edges has no path; a null end leads nowhere.
    """
    own = _of_types(edges, types)
    there = own.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("t"), "seq")
    back = own.filter("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("type").alias("t"), "seq")
    links = there.unionAll(back)
    node = F.col("id").cast(dict(links.dtypes)["a"])
    front = starts.select(node.alias("start"), F.array(node).alias("nodes"), F.array().cast("array<string>").alias("types"), F.array().cast("array<long>").alias("used")).distinct()
    levels: list[DataFrame] = []
    found = 0
    for n in range(1, max(1, min(hops, MOST_HOPS)) + 1):
        step = front.join(links, (F.element_at("nodes", -1) == F.col("a")) & ~F.array_contains("used", F.col("seq")))
        grown = [F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("types", F.col("t")).alias("types"), F.array_append("used", F.col("seq")).alias("used")]
        front = step.select("start", *grown)
        if limit is not None:
            front = front.orderBy("start", "nodes", "used").limit(limit - found)
        front = cut(front)
        levels.append(front.select("start", "nodes", "types", F.lit(n).alias("hops")))
        if limit is not None:
            found += front.count()  # at most limit rows
            if found >= limit:
                break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionAll(level)
    return out


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after `rounds` rounds; ranks add up to 1, and nodes without outgoing edges share theirs with all."""
    links = edges.select("src", "dst").distinct()
    out = links.groupBy("src").agg(F.count("*").alias("degree"))
    weighted = cut(links.join(out, "src"))
    nodes = cut(links.select(F.col("src").alias("node")).unionAll(links.select(F.col("dst").alias("node"))).distinct().join(out.withColumnRenamed("src", "node"), "node", "left"))
    n = nodes.count()
    ranks = nodes.select("node", "degree", F.lit(1.0 / max(1, n)).alias("rank"))
    for _ in range(rounds):
        loose = ranks.filter("degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        given = weighted.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)
        ranks = cut(nodes.join(given, "node", "left").crossJoin(F.broadcast(loose)).select("node", "degree", new.alias("rank")))  # loose is one row
    return ranks.select("node", "rank")


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, score): degree over the greatest degree."""
    degree = undirected(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    most = degree.agg(F.max("degree").alias("most"))
    return degree.crossJoin(F.broadcast(most)).select("node", (F.col("degree") / F.col("most")).alias("score"))  # most is one row


def least_neighbour(edges: DataFrame) -> DataFrame:
    """(node, community): the least neighbour's id."""
    return undirected(edges).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("community"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the least node of each connected component, by label spreading with pointer jumps."""
    links = cut(undirected(edges).select("a", "b").distinct())
    labels = cut(links.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    for _ in range(rounds):
        heard = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        spread = labels.join(heard, "node", "left").select("node", F.least("component", F.coalesce("heard", "component")).alias("component"), F.col("component").alias("was"))
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("further"))
        now = cut(spread.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "was"))
        labels = now.select("node", "component")
        if now.filter("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def label_spreading(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, community) after some rounds in which each node takes its neighbours' most frequent label, the least on ties."""
    links = cut(undirected(edges).select("a", "b").distinct())
    labels = links.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.count("*").alias("n"))
        labels = cut(votes.groupBy("node").agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("community")))
    return labels


def similar(edges: DataFrame, node: int, k: int) -> DataFrame:
    """The k nodes that share most with `node`: (node, shared, score), score = shared neighbours over degree plus one."""
    links = undirected(edges).select("a", "b").distinct()
    own = links.filter(F.col("a") == node).select("b")
    shared = links.join(own, "b", "left_semi").filter(F.col("a") != node).groupBy("a").agg(F.count("*").alias("shared"))
    degree = links.join(shared.select("a"), "a", "left_semi").groupBy("a").agg(F.count("*").alias("degree"))
    return shared.join(degree, "a").select(F.col("a").alias("node"), "shared", (F.col("shared") / (F.col("degree") + 1)).alias("score")).orderBy(F.desc("score"), "node").limit(k)


def expand(edges: DataFrame, node: int, loaded: DataFrame) -> DataFrame:
    """Neighbours of a node that are not among the loaded ids: (id, type)."""
    return undirected(edges).filter(F.col("a") == node).select(F.col("b").alias("id"), "type").distinct().join(loaded.select("id"), "id", "left_anti")


def exported(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A graph as one table of (part, id, other, label): its nodes (id, label) and relations."""
    return nodes.select(F.lit("node").alias("part"), "id", F.lit(None).cast("long").alias("other"), "label").unionAll(
        edges.select(F.lit("relationship"), F.col("src"), F.col("dst"), "type")
    )
