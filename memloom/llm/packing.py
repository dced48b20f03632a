"""Packing of documents into sequences of a fixed number of tokens, certified by lower bounds.

Method. The documents are dealt into SHARDS partitions. A partition is packed by
best-fit decreasing, and dual-feasible functions give a lower bound of the number
of sequences that its pieces need. Where the sum over all partitions is above the
bound of all pieces together, partitions whose sequences have gaps exchange their
documents, two by two, and best-fit decreasing runs again on the united
documents; the new packing stays if it needs fewer sequences. This goes on until the bound is met
or all are united. What then is above the bound is packed once more by exact
fill: each sequence opens with the largest piece left and is filled up
by the subset of the others that comes nearest to full; it stays if it is better.

Only the number of pieces of each length decides, so a partition is its histogram
of at most `capacity` lengths, whatever its documents, and each packing is one
task's work on one such histogram. It yields slots: the pieces of a length with
ranks from `first` on lie in sequences from `base` on, `each` to a sequence, from
place `at` on. A piece's rank among those of its length follows from its rank in its
task, taken when it is made, and the numbers of pieces in the tasks before it.

A document longer than the capacity is cut into pieces of exactly that many
tokens, of which the first may be shorter. Full pieces are sequences of their own.

On a cluster. Texts are encoded once; only narrow rows (id, place, length, digest, or
the piece's ids where they are asked for) are kept in the shared folder and joined
once, by task and length, with the prefix sums. The driver sees the numbers of SHARDS
partitions. Slots are sent to all tasks: at most SLOTS_MOST for each packing, by the
argument at _Bins, and no more packings than shards.

Defined cases. A null or empty text is a document of the end token alone. Null ids
and repeated rows are kept as they are, each row packed by itself. A text of any
length is encoded whole. An empty table has no pieces. Further columns, whatever their names,
take no part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.shared import cut
from memloom.llm.tokenlines import line_encoder

#: Partitions of the packing, a power of two.
SHARDS = 16
#: Texts are encoded in runs of about so many bytes.
RUN_BYTES = 6 << 20
#: Vocabulary files over this many bytes are refused: they are broadcast.
VOCABULARY_BYTES = 64 << 20
SLOT = "node int, length int, first long, count long, base long, each int, at int"
PLACED = "sequence_id long, offset long"


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """The least number of bins that count[s] items of each length s need, by dual-feasible functions.

    Three families, each with whole-number values: lengths above capacity - k count as
    full and those below k as nothing; lengths rounded down to multiples of capacity / (k + 1), but for
    exact ones; and lengths counted in steps of k, with large ones counted by what they leave.
    """
    s = np.flatnonzero(count)
    n = count[s].astype(object)
    if not len(s):
        return 0
    best = -(-int((n * s).sum()) // capacity)
    for k in range(1, capacity // 2 + 1):
        kept = np.where(s > capacity - k, capacity, np.where(s < k, 0, s))
        best = max(best, -(-int((n * kept).sum()) // capacity))
        # in units of capacity / (2 * (capacity // k)) the third family is whole
        unit, rest = capacity // k, (capacity - s) // k
        steps = np.where(2 * s > capacity, 2 * (unit - rest), np.where(2 * s == capacity, unit, 2 * (s // k)))
        best = max(best, -(-int((n * steps).sum()) // (2 * unit)))
    for k in range(1, min(capacity, 128)):
        exact = (s * (k + 1)) % capacity == 0
        value = np.where(exact, s * k, ((s * (k + 1)) // capacity) * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


class _Bins:
    """Groups of equal bins: how many, and what they hold as (length, number of that length).

    Each length leaves at most four more groups than there were: it fills whole groups, splits one, and
    opens new ones. So there are at most 4 * capacity groups, and as a bin's different lengths
    add up to at most the capacity, at most 45 slots in each for a capacity of 1024.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[tuple[int, tuple]]] = {capacity: []}
        self.done: list[tuple[int, tuple]] = []

    def put(self, number: int, holds: tuple, room: int) -> None:
        if number:
            (self.open.setdefault(room, []) if room else self.done).append((number, holds))

    def fill(self, number: int, holds: tuple, room: int, length: int, items: int) -> int:
        """Put items into these bins, one bin after the other; returns how many found no place."""
        each = room // length
        full = min(number, items // each)
        self.put(full, (*holds, (length, each)), room - each * length)
        items -= full * each
        if items and full < number:
            self.put(1, (*holds, (length, items)), room - items * length)
            full, items = full + 1, 0
        self.put(number - full, holds, room)
        return items


def best_fit_decreasing(count: np.ndarray, capacity: int) -> list[tuple[int, tuple]]:
    """Groups of equal bins from best-fit decreasing over count[s] items of each length s."""
    bins = _Bins(capacity)
    for length in np.flatnonzero(count)[::-1].tolist():
        items = int(count[length])
        for room in sorted(r for r in bins.open if length <= r < capacity):  # the tightest first
            groups = bins.open.pop(room)
            while groups and items:
                items = bins.fill(*groups.pop(), room, length, items)
            for number, holds in groups:
                bins.put(number, holds, room)
            if not items:
                break
        if items:
            bins.fill(-(-items // (capacity // length)), (), capacity, length, items)
    return bins.done + [g for groups in bins.open.values() for g in groups]


def exact_fill(count: np.ndarray, capacity: int) -> list[tuple[int, tuple]]:
    """Groups of equal bins, each opened by the largest item left and filled to the fullest that the others allow."""
    left, out = count.astype(object).copy(), []
    while (sizes := np.flatnonzero(left)).size:
        top = int(sizes[-1])
        left[top] -= 1
        room = capacity - top
        # reach[i]: the sums (as bits) that the i largest fitting lengths can make
        fitting = [int(s) for s in sizes[::-1] if s <= room and left[s]]
        reach, mask = [1], (1 << (room + 1)) - 1
        for s in fitting:
            bits, number, step = reach[-1], min(int(left[s]), room // s), 1
            while number:  # any number of this length up to the number left, in doubling steps
                some = min(step, number)
                bits |= bits << (some * s) & mask
                number -= some
                step *= 2
            reach.append(bits)
            if bits >> room & 1:
                break
        total, used = reach[-1].bit_length() - 1, Counter({top: 1})
        for i in range(len(reach) - 1, 0, -1):
            s = fitting[i - 1]
            while not reach[i - 1] >> total & 1:
                used[s] += 1
                total -= s
        left[top] += 1
        number = min(int(left[s]) // n for s, n in used.items())
        for s, n in used.items():
            left[s] -= number * n
        out.append((number, tuple(used.items())))
    return out


def packed(count: np.ndarray, capacity: int, last: bool = False) -> tuple[list[tuple[int, tuple]], int]:
    """(groups of equal bins, lower bound); at the last union exact fill is tried where the bound is not met."""
    groups, bound = best_fit_decreasing(count, capacity), lower_bound(count, capacity)
    if last and sum(n for n, _ in groups) > bound:
        groups = min(groups, exact_fill(count, capacity), key=lambda g: sum(n for n, _ in g))
    return groups, bound


def _slots(node: int, groups: list[tuple[int, tuple]]) -> pd.DataFrame:
    """Where the pieces of each length go, by rank."""
    rows, base, ranks = [], 0, Counter()
    for number, holds in groups:
        at = 0
        for length, each in holds:
            rows.append((node, length, ranks[length], number * each, base, each, at))
            ranks[length] += number * each
            at += length * each
        base += number
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SLOT.split(", ")])


def _histogram(rows: pd.DataFrame, capacity: int) -> np.ndarray:
    count = np.zeros(capacity + 1, np.int64)
    np.add.at(count, rows["length"].to_numpy(), rows["n"].to_numpy())
    return count


def pieces(df: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """Each document's pieces: start, length, digest and, if wanted, ids; and the task, and the rank there among its length."""
    text = Path(path).read_text(encoding="utf-8")
    if len(text) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} characters")
    spec, kind = df.sparkSession.sparkContext.broadcast(text), dict(df.dtypes)[id_col]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, task, seen = line_encoder(spec.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy())
            start = 0
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + RUN_BYTES, "right")))
                ids = e.encode_texts(texts.slice(start, stop - start))
                rows, number, begin, length, digest, held = [], [], [], [], [], []
                for k in range(len(ids)):
                    line = ids[k].as_buffer().to_pybytes() + end
                    n = len(line) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for j in range(len(cuts) - 1):
                        part = line[4 * cuts[j] : 4 * cuts[j + 1]]
                        rows.append(start + k)
                        number.append(j)
                        begin.append(cuts[j])
                        length.append(cuts[j + 1] - cuts[j])
                        digest.append(zlib.crc32(part))
                        if with_ids:
                            held.append(part)
                lengths = np.array(length, np.int64)
                order = np.argsort(lengths, kind="stable")  # ranks among equal lengths, in order
                ordered = lengths[order]
                opens = np.concatenate([[True], ordered[1:] != ordered[:-1]])
                within = np.arange(len(ordered)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
                rank = np.empty(len(lengths), np.int64)
                rank[order] = within + seen[ordered]
                seen += np.bincount(lengths, minlength=capacity + 1)
                cols = [b.column(0).take(pa.array(rows)), number, begin, lengths, pa.array(digest, pa.int64()), np.full(len(rows), task), rank]
                names = [id_col, "piece", "start", "length", "ids_crc32", "task", "rank"]
                types = [None, pa.int32(), pa.int64(), pa.int64(), None, pa.int64(), pa.int64()]
                if with_ids:
                    cols, names, types = [*cols, held], [*names, "piece_ids"], [*types, pa.binary()]
                yield pa.RecordBatch.from_arrays([c if t is None else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
                start = stop
            pa.default_memory_pool().release_unused()

    more = ", piece_ids binary" if with_ids else ""
    out = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, task long, rank long{more}"
    return df.select(id_col, text_col).mapInArrow(run, out)


def place(made: DataFrame, capacity: int) -> DataFrame:
    """sequence_id and offset for rows with a length, a task and the rank in it among rows of that length; made should be cut."""
    spark = made.sparkSession
    loose = made.filter(F.col("length") < capacity)
    of_task = cut(loose.groupBy("task", "length").agg(F.count("*").alias("n")).withColumn("shard", F.pmod("task", F.lit(SHARDS)).cast("int")))
    of_shard = cut(of_task.groupBy("shard", "length").agg(F.sum("n").alias("n")))  # at most SHARDS * capacity rows
    number_of = {s: (s, 0) for s in range(SHARDS)}  # shard: (first shard of its packing, level of that packing)

    def packings(level: int, wanted: list[int], slots: bool) -> DataFrame:
        node = F.shiftleft(F.shiftright("shard", level), level).alias("node")
        rows = of_shard.select(node, "length", "n").filter(F.col("node").isin(wanted))
        last = (1 << level) == SHARDS

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            groups, bound = packed(_histogram(rows, capacity), capacity, last)
            if slots:
                return _slots(int(key[0]), groups)
            tokens = int((rows["length"] * rows["n"]).sum())
            return pd.DataFrame({"node": [int(key[0])], "bins": [sum(n for n, _ in groups)], "bound": [bound], "tokens": [tokens]})

        return rows.groupBy("node").applyInPandas(run, SLOT if slots else "node int, bins long, bound long, tokens long")

    def measured(level: int, wanted: list[int]) -> dict[int, tuple[int, int, int]]:
        return {r["node"]: (r["bins"], r["bound"], r["tokens"]) for r in packings(level, wanted, False).collect()}  # at most SHARDS rows

    every = of_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    count = np.zeros(capacity + 1, np.int64)
    for r in every:
        count[r["length"]] = r["n"]
    goal = lower_bound(count, capacity)
    here = measured(0, list(range(SHARDS)))
    best = {n: x[0] for n, x in here.items()}  # sequences of the shards under a node
    for level in range(1, SHARDS.bit_length()):
        if sum(best.values()) <= goal:
            break  # certified: no packing needs fewer
        step = 1 << level
        gaps = {n for n, (bins, _, tokens) in here.items() if bins * capacity > tokens}
        below = {n: [m for m in (n, n + step // 2) if m in best] for n in range(0, SHARDS, step)}
        least = 1 if step == SHARDS else 2  # the last union tries exact fill, be it of one part
        wanted = [n for n, parts in below.items() if len(parts) >= least and any(m in gaps for m in parts)]
        united = measured(level, wanted) if wanted else {}
        now, after = {}, {}
        for n, parts in below.items():
            if not parts:
                continue
            apart = sum(best[m] for m in parts)
            if n in united and united[n][0] < apart:
                now[n], after[n] = united[n][0], united[n]
                number_of.update({s: (n, level) for s in range(n, n + step)})
            else:
                now[n] = apart
                after[n] = (apart, sum(here[m][1] for m in parts), sum(here[m][2] for m in parts))
        best, here = now, after
    chosen = sorted(set(number_of.values()))
    slots = None
    for level in sorted({x[1] for x in chosen}):
        part = packings(level, [n for n, at in chosen if at == level], True)
        slots = part if slots is None else slots.unionAll(part)
    slots = cut(slots)
    sizes = {r["node"]: r["n"] for r in slots.groupBy("node").agg(F.max(F.col("base") + F.ceil(F.col("count") / F.col("each"))).alias("n")).collect()}
    before, bases = 0, {}
    for n, _ in chosen:
        bases[n], before = before, before + sizes.get(n, 0)
    owner = F.element_at(F.create_map(*[F.lit(x) for s, (n, _) in number_of.items() for x in (s, n)]), F.pmod("task", F.lit(SHARDS)).cast("int"))
    shift = F.element_at(F.create_map(*[F.lit(x) for n, b in bases.items() for x in (n, b)]), F.col("node"))
    # the pieces of a length in the tasks before, within a packing: a row for each task and length
    earlier = Window.partitionBy("node", "length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_task.select(owner.alias("node"), "task", "length", "n").withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    ranked = loose.join(offsets, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    ranked = ranked.withColumnRenamed("node", "_node").withColumnRenamed("length", "_length")
    fits = (F.col("_node") == F.col("node")) & (F.col("_length") == F.col("length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count"))
    nth = F.col("rank") - F.col("first")
    rest = [c for c in made.columns if c not in ("length", "task", "rank")]
    found = ranked.join(F.broadcast(slots), fits).select(
        *rest, F.col("_length").alias("length"),
        (shift + F.col("base") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("_length")).cast("long").alias("offset"),
    )
    # full pieces have numbers below zero, apart from all others
    full = made.filter(F.col("length") == capacity).select(
        *rest, "length", (-1 - (F.shiftleft("task", 33) + F.col("rank"))).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return full.unionByName(found)


def pack(
    df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id and offset of every piece, and its ids if they are asked for."""
    made = cut(pieces(df, path, capacity, end_id, id_col, text_col, with_ids))
    return place(made, capacity).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["piece_ids"] if with_ids else []))


def sequences(packed_pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sequence_id, ids (little-endian unsigned 32-bit) and the documents with their places, from pack(..., with_ids=True)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("piece_ids").alias("ids"), F.col(id_col).alias("id"), "piece", "length")))
    return packed_pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.unhex(F.concat_ws("", F.transform("parts", lambda p: p["ids"]))).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["id"].alias(id_col), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("documents"),
    )
