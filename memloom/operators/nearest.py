"""Neighbours among all vectors of a type by inverted lists, and resolvers of mentions that rest on them.

Index. Each type has at most CENTRES centres, rows of it by hash (as many as the
root of its rows, if fewer); every row stands in the list of its nearest centre, none
is left out. A query visits the lists of its nearest centres. With `exact` it then visits
every further list that may hold a nearer row: a row at distance r from its centre is
at least (distance of query and centre) - r away, so a list is passed over only if that is more
than the distance of the k-th row found, for the largest r of the list.

Queries and rows are dealt in blocks of FLOATS components. A query carries the lists that it visits as
bits, so its vector moves once for each block of rows and not once for each list; in a block, each list meets the queries that visit it,
in products of bounded size. So a hot type or list is many blocks. Centres are copied once for each piece of ROWS rows.

Defined cases. Rows whose vector is null or has no length take no part, nor do queries like
that; vectors of one type have one length. A query's own id is not among its neighbours. Ties, to DIGITS digits, go to
the smaller id. A type without rows gives its queries nothing; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators import vectors as vec
from memloom.sources.shared import cut

#: Most centres of a type, the share of a type's lists that a query visits, and the rows that meet the centres at once.
CENTRES, SHARE, ROWS = 256, 0.85, 4096
#: Vectors without any structure need that share for nine true neighbours in ten; clustered ones need less.
#: Distances of unit vectors are right to about the root of a double's precision.
SLACK = 1e-6
#: Components in a block, scores that are held at once, and the digits to which scores are told apart: products of equal vectors may differ in the last bits.
FLOATS, SCORES, DIGITS = 1 << 20, 1 << 21, 12


def unit(rows: DataFrame, group: str, id_col: str, v: str = "v") -> DataFrame:
    """(g, id, v) of the rows that have a direction, v at length 1."""
    norm = F.sqrt(vec.dot(F.col(v), F.col(v)))
    # within the inner function the norm itself would be summed anew for each component
    held = F.array(F.struct(norm.alias("norm"), F.col(v).alias("v")))
    scaled = F.transform(held, lambda s: F.when(s["norm"] > 0, F.transform(s["v"], lambda x: x / s["norm"])))
    return rows.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.get(scaled, 0).alias("v")).filter("v is not null")


def centres(rows: DataFrame) -> DataFrame:
    """(g, list, v): of each type (g) at most CENTRES rows, those of least hash in a thin sample; `list` numbers them from 0."""
    hashed = rows.withColumn("h", F.xxhash64("id"))
    lists = F.least(F.lit(CENTRES), F.ceil(F.sqrt(F.count("*"))))
    sizes = hashed.groupBy("g").agg(F.count("*").alias("n"), lists.alias("lists"), F.min("h").alias("first"))
    # about twice as many as are wanted pass, so that no task orders a whole type
    thin = hashed.join(sizes, "g").filter((F.pmod("h", F.ceil(F.col("n") / (2 * F.col("lists")))) == 0) | (F.col("h") == F.col("first")))
    place = F.row_number().over(vec.Window.partitionBy("g").orderBy("h", "id"))
    return thin.withColumn("k", place).filter("k <= lists").select("g", (F.col("k") - 1).alias("list"), "v")


def by_centre(rows: DataFrame, among: DataFrame, keep: str) -> DataFrame:
    """(g, id, v) of each row with centres of its type.

    keep is "nearest" (one centre: list, and its distance away), or bits of the lists that are visited: "share" (the nearest
    SHARE of them) or "bound" (those whose radius, a column of `among`, reaches within the
    row's column kth, without those in its bits).
    """
    counts = rows.groupBy("g").agg(F.ceil(F.count("*") / ROWS).alias("n"))
    dealt = rows.join(counts, "g").withColumn("s", F.pmod(F.xxhash64("id"), "n"))
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    copies = among.join(counts, "g").select(pieces.alias("_s"), *[F.col(c).alias(f"_{c}") for c in among.columns])
    kinds = dict(rows.dtypes)

    def meet(x: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = x[["g", "id", "v"]]
        if not len(x) or not len(c):
            found = found.iloc[:0]
            return found.assign(list=0, away=0.0) if keep == "nearest" else found.assign(bits=None)
        c = c.sort_values("_list", ignore_index=True)
        lists = c["_list"].to_numpy()
        away = np.sqrt(np.maximum(0.0, 2 - 2 * np.array(x["v"].tolist()) @ np.array(c["_v"].tolist()).T))
        if keep == "nearest":
            near = away.argmin(axis=1)
            return found.assign(list=lists[near], away=away[np.arange(len(x)), near])
        visited = np.zeros((len(x), CENTRES), bool)
        if keep == "bound":
            visited[:, lists] = away - c["_radius"].to_numpy()[None, :] <= x["kth"].to_numpy()[:, None] + SLACK
            visited &= ~unpacked(x["bits"])
        else:
            near = np.argsort(away, axis=1, kind="stable")[:, : int(np.ceil(SHARE * len(c)))]
            np.put_along_axis(visited, lists[near], True, axis=1)
        return found.assign(bits=[b.tobytes() for b in np.packbits(visited, axis=1)])

    schema = f"g {kinds['g']}, id long, v array<double>, " + ("list long, away double" if keep == "nearest" else "bits binary")
    return dealt.groupBy("g", "s").cogroup(copies.groupBy("_g", "_s")).applyInPandas(meet, schema)


def unpacked(bits: pd.Series) -> np.ndarray:
    """A row of booleans for each row of bits."""
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(bool)


class _Best:
    """The k best rows (score, other) found for each of n queries; rows that cannot be among them are let go."""

    def __init__(self, n: int, k: int):
        self.k, self.worst, self.worst_id = k, np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
        self.held, self.new = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], 0
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, queries: np.ndarray, others: np.ndarray, scores: np.ndarray) -> None:
        row, col = np.nonzero((scores > -np.inf) & (scores >= self.worst[queries][:, None] - 10.0**-DIGITS * 2))
        query, other, score = queries[row], others[col], scores[row, col]
        told = np.round(score, DIGITS)
        ok = (told > self.worst[query]) | ((told == self.worst[query]) & (other < self.worst_id[query]))
        self.more.append((query[ok], other[ok], score[ok]))
        self.new += int(ok.sum())
        if self.new > max(len(self.worst) * self.k, 1 << 16):
            self.fold()

    def fold(self) -> None:
        query, other, score = (np.concatenate(x) for x in zip(self.held, *self.more, strict=True))
        told = np.round(score, DIGITS)
        order = np.lexsort((other, -told, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = order[place == self.k - 1]
        self.worst[query[place == self.k - 1]], self.worst_id[query[place == self.k - 1]] = told[last], other[last]
        keep = order[place < self.k]
        self.held, self.more, self.new = [query[place < self.k], other[keep], score[keep]], [], 0


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of (id, other, score) for each id, with their rank."""
    rank = F.row_number().over(vec.Window.partitionBy("id").orderBy(F.desc(F.round("score", DIGITS)), "other"))
    return found.select("id", "other", "score", rank.alias("rank")).filter(F.col("rank") <= k)


def among_lists(queries: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(id, other, score, rank): the k best rows (g, id, v, list) for each query (g, id, v, bits) in the lists of its bits."""

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("g").agg(F.ceil(F.sum(F.size("v")) / FLOATS).alias(name))

    counts = blocks(queries, "nl").join(blocks(held, "nr"), "g")
    every, place = (lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))), F.xxhash64("id")
    a = queries.join(counts, "g").select("g", F.pmod(place, "nl").alias("i"), every("nr").alias("j"), "id", "v", "bits")
    b = held.join(counts, "g").select(F.col("g").alias("_g"), every("nl").alias("_i"), F.pmod(place, "nr").alias("_j"), F.col("id").alias("_id"), F.col("v").alias("_v"), "list")

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        own = x["id"].to_numpy(np.int64)
        best = _Best(len(x), k)
        if len(x) and len(y):
            y = y.sort_values(["list", "_id"], ignore_index=True)
            p, q = np.array(x["v"].tolist(), float), np.array(y["_v"].tolist(), float)
            others, visited = y["_id"].to_numpy(np.int64), unpacked(x["bits"])
            lists, starts = np.unique(y["list"].to_numpy(), return_index=True)
            for n, a, z in zip(lists, starts, [*starts[1:], len(y)], strict=True):
                asking = np.flatnonzero(visited[:, n])
                for c in range(a, z, vec.RIGHT_ROWS):
                    rows = slice(c, min(c + vec.RIGHT_ROWS, z))
                    step = SCORES // (rows.stop - c)
                    for r in range(0, len(asking), step):
                        some = asking[r : r + step]
                        s = p[some] @ q[rows].T
                        s[own[some][:, None] == others[rows][None, :]] = -np.inf
                        best.add(some, others[rows], s)
            best.fold()
        query, other, score = best.held
        return pd.DataFrame({"id": own[query], "other": other, "score": score})

    found = a.groupBy("g", "i", "j").cogroup(b.groupBy("_g", "_i", "_j")).applyInPandas(compare, "id long, other long, score double")
    return ranked(found, k)


def neighbours(queries: DataFrame, rows: DataFrame, k: int, group: str = "type", id_col: str = "id", exact: bool = False) -> DataFrame:
    """(id, other, score, rank): each query's k rows of most cosine among all rows of its type; all of them for sure only with `exact`."""
    points = cut(unit(rows, group, id_col))
    heads = cut(centres(points))
    asked = cut(unit(queries, group, id_col))
    held = cut(by_centre(points, heads, "nearest"))
    visits = by_centre(asked, heads, "share")
    visits = cut(visits) if exact else visits
    first = among_lists(visits, held, k)
    if not exact:
        return first
    first = cut(first)
    radius = held.groupBy("g", "list").agg(F.max("away").alias("radius"))
    worst = first.groupBy("id").agg(F.when(F.count("*") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score")))).alias("kth"))
    waiting = visits.join(worst, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
    more = cut(by_centre(waiting, heads.join(radius, ["g", "list"]), "bound").filter(F.col("bits") != F.lit(bytes(-(-CENTRES // 8)))))
    return ranked(first.drop("rank").unionByName(among_lists(more, held, k).drop("rank")), k)


def semantic_matches(mentions: DataFrame, entities: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(mention, entity, score) of mentions (id, type, v) whose nearest entity of their type (id, type, v) is at least `threshold` alike.

    Ids of mentions and entities must differ.
    """
    found = neighbours(mentions, entities, 1, exact=True).filter(F.col("score") >= threshold)
    return found.select(F.col("id").alias("mention"), F.col("other").alias("entity"), "score")


def composite(mentions: DataFrame, entities: DataFrame, *stages: tuple[str, DataFrame]) -> DataFrame:
    """mention, canonical, confidence and match_type by the first stage (its name; mention, entity, score) that gives another name.

    A stage that finds the very same name settles nothing, and a mention that no stage
    renames keeps its own, with confidence 1 and type none. Entities and mentions have id and name.
    """
    out = mentions.select(F.col("id").alias("mention"), "name")
    names = entities.select(F.col("id").alias("entity"), F.col("name").alias("canonical"))
    picks: list[Column] = []
    for i, (kind, found) in enumerate(stages):
        named = found.join(names, "entity").select("mention", F.struct("canonical", F.col("score").alias("confidence"), F.lit(kind).alias("match_type")).alias(f"_s{i}"))
        out = out.join(named, "mention", "left")
        picks.append(F.when(F.col(f"_s{i}.canonical") != F.col("name"), F.col(f"_s{i}")))
    none = F.struct(F.col("name").alias("canonical"), F.lit(1.0).alias("confidence"), F.lit("none").alias("match_type"))
    return out.select("mention", F.coalesce(*picks, none).alias("r")).select("mention", "r.*")
