"""Near-duplicate documents: MinHash bands, verified on whole shingle sets, and components.

Method. Each text's set of word shingles gets BANDS * ROWS minima of universal
hashes; equal minima in a band make two sets candidates. At the threshold of
0.8 a pair shares no band with a chance of (1 - 0.8**4)**24, about 3 in a million.

Texts with equal sets are one class and are represented by their least id, so
groups of exact copies cost one row each. In a bucket of candidates, not all
pairs are compared: every member is held against the bucket's pivot, and
components are formed (alternating large-star and small-star). Members
of one pivot that are then in different components are compared in blocks,
except where their exact distances to the pivot rule a link out (Jaccard
distance is a metric). The pivot is the member whose buckets hold the most
members in all: in a group of near copies that is the text they were made from,
so that the others are linked with it. So every candidate pair is confirmed, ruled out or
already connected; there is no cap on buckets or partners, and a group of near
copies costs one comparison each plus those of its unconnected members.

Both comparisons first look at signatures, all BANDS * ROWS minima in 16 bits
each: a pair whose minima agree less often than seven and a half standard
deviations below the threshold is ruled out (a linked pair is with a chance
below 1e-10). Only the others are confirmed on full sets, which are made for the
texts concerned alone; those are found by a bitmap of their ids, so texts are
read twice and not shuffled. Buckets and pivots of many members are dealt in
slices wherever rows are joined by them.

Defined cases. Null and empty texts have no shingles and are linked with
nothing. A null id is linked with nothing; its component is null and it is kept.
Rows that share an id are one node; if their texts differ, the one whose set has
the least digest stands for all in comparisons. Very long texts are read whole.
Further columns, whatever their names, take no part. With no rows the result is
empty. Sets that are as alike as the threshold are linked. The result does not
depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.components import connected_components
from memloom.llm.shared import cut, cut_narrow, merged
from memloom.llm.skew import IdFilter, fresh, join_hot
from memloom.llm.textbytes import lower, mix, run_hashes, runs, word_bounds

BANDS, ROWS = 24, 4
#: Hash functions are applied to so many shingles at a time, to bound memory.
SHINGLES_AT_ONCE = 4096
#: Signatures are compared for so many pairs at a time.
PAIRS_AT_ONCE = 4096
#: Members are compared with their pivot in blocks of so many, and unconnected ones with one another in blocks of ACROSS.
BLOCK, ACROSS = 64, 256

_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
#: Bytes of a signature: 16 bits of each minimum.
SIGNATURE = 2 * BANDS * ROWS
_PLACE = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Per text: the sorted distinct hashes of its shingles; with fewer words, of the whole sequence."""
    starts, ends, first = word_bounds(data, offsets)
    of_word = run_hashes(data, starts, ends)
    n = len(of_word)
    last = np.repeat(first[1:], np.diff(first))  # of each word: the end of its text
    at = np.arange(n)
    total = np.zeros(n, np.uint64)
    padded = np.concatenate([of_word, np.zeros(words, np.uint64)])
    for k in range(words):
        total += np.where(at + k < last, padded[k : k + n], np.uint64(0)) * _PLACE[k]
    of_shingle = mix(total)
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield np.unique(of_shingle[a : max(b - words + 1, min(a + 1, b))])


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for k in range(0, len(shingles), SHINGLES_AT_ONCE):
        some = shingles[k : k + SHINGLES_AT_ONCE]
        np.minimum(least, (some[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return least


def band_hashes(least: np.ndarray) -> np.ndarray:
    """A hash of each band's minima; bands differ in their hashes even with equal minima."""
    rows = least.reshape(BANDS, ROWS) * _PLACE[:ROWS]
    return mix(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACE[ROWS])


def digest(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that stand for a set."""
    return shingles.sum(dtype=np.uint64), mix(shingles ^ _PLACE[9]).sum(dtype=np.uint64)


def least_matches(percent: int) -> int:
    """Equal minima below which a pair is taken not to be linked."""
    p, n = percent / 100, BANDS * ROWS
    return max(0, int(n * p - 7.5 * (n * p * (1 - p)) ** 0.5))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (shingles), d1 and d2 (a digest of the set), the hashes of its bands, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, offsets in runs(batches):
            n, d, bands, signatures = [], [], [], []
            for s in shingle_sets(lower(data), offsets, words):
                n.append(len(s))
                d.append(digest(s))
                least = minima(s)
                bands.append(band_hashes(least) if len(s) else np.zeros(0, np.uint64))
                signatures.append(mix(least).astype(np.uint16).tobytes() if len(s) else b"")
            both = np.array(d, np.uint64).view(np.int64)
            flat = pa.array(np.concatenate(bands).view(np.int64))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(n, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.ListArray.from_arrays(ends, flat),
                 pa.array(signatures, pa.binary())],
                ["doc_id", "n", "d1", "d2", "bands", "signature"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>, signature binary")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """rep, its set of shingle hashes and the set's digest d1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, offsets in runs(batches):
            sets = list(shingle_sets(lower(data), offsets, words))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
            d1 = np.array([digest(s)[0] for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([keys, lists, pa.array(d1)], ["rep", "shingles", "d1"])

    return docs.mapInArrow(run, "rep long, shingles array<long>, d1 long")


def compare(blocks: DataFrame, percent: int, every: bool) -> DataFrame:
    """(k, a, b, d): Jaccard distances, on full sets, of the rows of side 0 with those of side 1 in each block pair.

    blocks has k, i, j, side, rep, c, d and shingles. In a block pair with itself
    (i = j) its rows are compared with one another. Unless `every`, rows of equal
    c are not compared, nor rows that cannot be linked: Jaccard distance is a
    metric, so d, both rows' distances to k, may differ by the allowed distance
    at most, where they are known; and the smaller set must hold `percent` of the larger. Only links
    are returned then.
    """
    most = 1 - percent / 100 + 1e-9

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(x, np.int64).view(np.uint64) for x in rows["shingles"]]  # sorted as unsigned
        size = np.array([len(x) for x in sets])
        rep, c, d = rows["rep"].to_numpy(), rows["c"].to_numpy(), rows["d"].to_numpy()
        side = rows["side"].to_numpy()
        within = rows["i"].iat[0] == rows["j"].iat[0]
        right = np.arange(len(rows)) if within else np.flatnonzero(side == 1)
        found = []
        for x in range(len(rows)) if within else np.flatnonzero(side == 0):
            ys = right[right > x] if within else right
            if not every:
                ok = (c[ys] != c[x]) & ~(np.abs(d[ys] - d[x]) > most)  # an unknown distance rules nothing out
                ys = ys[ok & (100 * np.minimum(size[ys], size[x]) >= percent * np.maximum(size[ys], size[x]))]
            if not len(ys):
                continue
            own, others = sets[x], np.concatenate([sets[y] for y in ys])
            at = np.minimum(np.searchsorted(own, others), len(own) - 1)
            ends = np.cumsum(size[ys])
            common = np.diff(np.concatenate([[0], np.cumsum(own[at] == others)[ends - 1]]))
            union = size[ys] + size[x] - common
            for y, n, m in zip(ys, common, union, strict=True):
                if every or 100 * n >= percent * m:
                    found.append((rows["k"].iat[0], rep[x], rep[y], 1 - n / m))
        return pd.DataFrame(found, columns=["k", "a", "b", "d"]).astype({"k": "int64", "a": "int64", "b": "int64", "d": "float64"})

    return blocks.groupBy("k", "i", "j").applyInPandas(run, "k long, a long, b long, d double")


def possible(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """pairs (k, rep) with near: whether their signatures agree often enough."""
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.array(b.column(c).to_pylist(), f"S{SIGNATURE}").view(np.uint16).reshape(b.num_rows, BANDS * ROWS) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x == y).sum(1) >= least)], ["k", "rep", "near"])

    both = pairs.join(signatures.select("rep", F.col("signature").alias("own")), "rep")
    counts = pairs.groupBy("k").agg(F.count("*").alias("n"))
    both = join_hot(both, signatures.select(F.col("rep").alias("k"), "signature"), "k", "rep", counts)
    return both.select("k", "rep", "own", "signature").mapInArrow(run, "k long, rep long, near boolean")


def star(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(k, rep, d): the exact distance of each pivot k to each of its members."""
    nothing = [F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("d")]
    counts = pairs.groupBy("k").agg(F.count("*").alias("n"))
    parts = counts.select("k", F.ceil(F.col("n") / BLOCK).alias("parts"))
    dealt = join_hot(pairs, parts, "k", "rep", counts).select("k", F.pmod(F.xxhash64("rep"), "parts").alias("i"), F.lit(1).alias("side"), "rep")
    own = parts.select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), F.lit(0).alias("side"), F.col("k").alias("rep"))
    sent = parts.select(F.col("k").alias("rep"), F.col("parts").alias("n"))  # members have few pivots each
    blocks = join_hot(dealt.unionAll(own), sets, "rep", "i", sent).select("k", "i", F.lit(-1).cast("long").alias("j"), "side", "rep", *nothing, "shingles")
    return compare(blocks, percent, every=True).select("k", F.col("b").alias("rep"), "d")


def in_blocks(near: DataFrame) -> DataFrame:
    """Members (k, rep, c, d, own) of pivots in pairs of blocks (i, j).

    Members of the pivot's own component (own) meet the others only, and the
    others meet one another.
    """
    sizes = near.groupBy("k").agg(
        F.ceil(F.count_if(~F.col("own")) / ACROSS).alias("others"), F.ceil(F.count_if("own") / ACROSS).alias("ours")
    ).filter("others > 0")
    place = F.xxhash64("rep")
    dealt = join_hot(near, sizes, "k", "rep").withColumn(
        "s", F.when(F.col("own"), F.col("others") + F.pmod(place, F.greatest("ours", F.lit(1)))).otherwise(F.pmod(place, "others"))
    )
    last = F.when(F.col("own"), F.col("others") - 1).otherwise(F.col("others") + F.col("ours") - 1)
    return dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "k", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), (F.col("s") > F.col("o")).cast("int").alias("side"), "rep", "c", "d",
    )


def with_possible_partner(blocks: DataFrame, percent: int) -> DataFrame:
    """(k, rep) of the members of blocks whose signatures leave a link with another one possible."""
    least, most = least_matches(percent), 1 - percent / 100 + 1e-9

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(list(rows["signature"]), f"S{SIGNATURE}").view(np.uint16).reshape(len(rows), BANDS * ROWS)
        n, c, d, side = (rows[name].to_numpy() for name in ("n", "c", "d", "side"))
        left, right = (np.flatnonzero(side == k) for k in (0, 1))
        if rows["i"].iat[0] == rows["j"].iat[0]:
            left = right = np.arange(len(rows))
        hit = np.zeros(len(rows), bool)
        # Rows of equal components include each row itself; an unknown distance rules nothing out.
        ok = (c[left][:, None] != c[right]) & ~(np.abs(d[left][:, None] - d[right]) > most)
        ok &= 100 * np.minimum(n[left][:, None], n[right]) >= percent * np.maximum(n[left][:, None], n[right])
        a, b = np.nonzero(ok)
        for k in range(0, len(a), PAIRS_AT_ONCE):
            some = slice(k, k + PAIRS_AT_ONCE)
            close = (x[left[a[some]]] == x[right[b[some]]]).sum(1) >= least
            hit[left[a[some]][close]] = True
            hit[right[b[some]][close]] = True
        return rows.loc[hit, ["k", "rep"]]

    return blocks.groupBy("k", "i", "j").applyInPandas(run, "k long, rep long").distinct()


def across(members: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (k, rep, c, d) of one pivot that are in different components.

    Members of the pivot's own component take part only if near enough. Pairs of
    blocks of ACROSS members are compared, on signatures first and then, for the
    members with a possible partner, on sets; a set is sent once for each block
    and not once for each pair.
    """
    at_pivot = members.filter("rep = k").select("k", F.col("c").alias("kc"))
    counts = members.groupBy("k").agg(F.count("*").alias("n"))
    known = join_hot(members, at_pivot, "k", "rep", counts).withColumn("own", F.col("c") == F.col("kc")).drop("kc")
    # The least distance of the others; where one is unknown, it may be anything.
    other = F.when(~F.col("own"), F.coalesce("d", F.lit(0.0)))
    least = known.groupBy("k").agg(F.min(other).alias("least")).filter("least is not null")
    reach = F.col("least") - (1 - percent / 100) - 1e-9
    near = join_hot(known, least, "k", "rep", counts).filter(~F.col("own") | F.col("d").isNull() | (F.col("d") >= reach))
    near = cut_narrow(near.select("k", "rep", "c", "d", "own"))
    flagged = with_possible_partner(join_hot(cut_narrow(in_blocks(near)), signatures, "rep", "i"), percent)
    blocks = cut_narrow(in_blocks(cut_narrow(near.join(flagged, ["k", "rep"], "left_semi"))))
    return compare(join_hot(blocks, sets, "rep", "i"), percent, every=False).select("a", "b")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least id reachable) and kept (doc_id is component_id)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = merged(cut(sketches(slim, words)))
    named = sketched.filter("n > 0 and doc_id is not null")
    classes = named.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    classes = cut_narrow(classes)
    members = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    shared = cut_narrow(shared.select("bucket", "n"))
    met = cut_narrow(join_hot(IdFilter(shared.select("bucket"), "bucket").maybe(members, "bucket"), shared, "bucket", "rep", shared))
    weight = met.groupBy("rep").agg(F.sum("n").alias("weight"))
    central = met.join(weight, "rep").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("top"))
    pivots = central.select("bucket", (-F.col("top.rep")).alias("k"))
    pairs = cut_narrow(join_hot(met.drop("n"), pivots, "bucket", "rep", shared).filter("rep <> k").select("k", "rep").distinct())
    reps = pairs.select("rep").unionAll(pairs.select("k").distinct()).distinct()
    concerned = IdFilter(reps, "rep")
    least = F.struct("d1", "d2")
    signatures = concerned.maybe(named, "doc_id").groupBy(F.col("doc_id").alias("rep")).agg(
        F.min_by("n", least).alias("n"), F.min_by("signature", least).alias("signature")
    )
    signatures = cut_narrow(signatures)
    judged = cut_narrow(possible(pairs, signatures, percent))
    near = judged.filter("near").select("k", "rep")
    # An id that is concerned may bring a few texts that are not; their sets are joined with nothing.
    sets = cut_narrow(full_sets(concerned.maybe(slim, "doc_id"), words).groupBy("rep").agg(F.min_by("shingles", "d1").alias("shingles")))

    measured = cut_narrow(star(near, sets, percent))
    links = measured.filter(F.col("d") <= 1 - percent / 100 + 1e-12).select(F.col("k").alias("u"), F.col("rep").alias("v"))
    component = cut_narrow(connected_components(links))
    far = judged.filter(~F.col("near")).select("k", "rep", F.lit(None).cast("double").alias("d"))
    whole = measured.unionAll(far).unionAll(judged.select("k").distinct().select("k", F.col("k").alias("rep"), F.lit(0.0)))
    placed = whole.join(component.withColumnRenamed("node", "rep"), "rep", "left")
    placed = cut_narrow(placed.select("k", "rep", "d", F.coalesce("component", "rep").alias("c")))
    more = cut_narrow(across(placed, signatures, sets, percent))
    stars = component.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    component = connected_components(stars.unionAll(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    text = F.struct("d1", "d2", "n").alias("text")
    found = classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").select(text, F.coalesce("component", "rep").alias("component_id"))
    # One text may have very many copies: they are dealt in slices.
    copies = classes.select(text, F.col("rows").alias("n"))
    linked = join_hot(named.select("doc_id", "n", text), found, "text", "doc_id", copies).select("doc_id", "n", "component_id")
    alone = sketched.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of its component, once each; rows with a null id stay.

    Of different rows that share an id, the one whose columns have the least hash
    stays. A bitmap of the ids that go or are repeated lets all other rows pass in
    place; only rows that it marks are shuffled.
    """
    found = cut_narrow(near_duplicates(docs, words, percent, id_col, text_col).filter(F.col(id_col).isNotNull()).select(id_col, "kept"))
    ids = found.groupBy(id_col).agg(F.min("kept").alias("kept"), F.count("*").alias("n")).filter("n > 1 or not kept")
    gone = cut_narrow(ids.select(id_col, "kept"))
    mark, row = fresh(docs.columns, "_marked"), fresh(docs.columns, "_row")
    marked = IdFilter(gone, id_col).marked(docs, id_col, mark)
    sure = marked.filter(F.col(id_col).isNull() | ~F.col(mark)).drop(mark)
    least = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(row)
    once = marked.filter(F.col(id_col).isNotNull() & F.col(mark)).groupBy(id_col).agg(least)
    stays = once.join(gone.filter(~F.col("kept")).select(id_col), id_col, "left_anti").select(f"{row}.*")
    return sure.unionAll(stays.select(*docs.columns))
