"""Joins that survive hot keys, and filters by many ids that send few bytes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import cut_narrow

#: A key of more rows than this is dealt in slices of about so many.
SLICE = 512
#: Only so many of the heaviest keys are dealt: the list is broadcast. Any other
#: key holds at most max(SLICE, rows / MOST_HEAVY) rows.
MOST_HEAVY = 50_000
#: Bits of a filter: at least BITS_AN_ID for each id, at most MOST_BITS (16 MB) in all.
BITS_AN_ID, MOST_BITS = 16, 1 << 27
#: Fixed value: bits in one of Spark's bitmaps.
BITMAP = 32768


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that is not taken, whatever its letters' case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def fresh_prefix(taken: Iterable[str], prefix: str) -> str:
    """A prefix with which no taken name begins, whatever its letters' case."""
    low = [t.lower() for t in taken]
    while any(t.startswith(prefix.lower()) for t in low):
        prefix += "_"
    return prefix


def join_hot(big: DataFrame, small: DataFrame, key: str, spread: str, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """big joined with small by `key`, where a few keys of big may hold many rows.

    Rows of a heavy key are dealt by a hash of `spread` in slices, and small's
    rows of that key are repeated for each slice. counts (key, n) may be given;
    else big is counted, which is combined before it is shuffled. They are read
    once beforehand: without a heavy key the plan is a plain join. Both should be
    cut or cheap.
    """
    if counts is None:
        counts = big.groupBy(key).agg(F.count("*").alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= SLICE:
        return big.join(small, key, how)
    heavy = counts.filter(F.col("n") > SLICE).orderBy(F.desc("n"), key).limit(MOST_HEAVY)
    heavy = F.broadcast(heavy.select(key, F.ceil(F.col("n") / SLICE).alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = big.join(heavy, key, "left").withColumn("_slice", F.pmod(F.xxhash64(spread), parts)).drop("_parts")
    copied = small.join(heavy, key, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return dealt.join(copied, [key, "_slice"], how).drop("_slice")


class IdFilter:
    """A bitmap of hashed ids, of bounded size: tells which ids are surely not among them."""

    def __init__(self, ids: DataFrame, col: str):
        """ids should be cut or cheap: they are counted, then read once more."""
        n, bits = ids.count(), BITMAP
        while bits < min(MOST_BITS, n * BITS_AN_ID):
            bits *= 2
        self.bits = bits
        place = self._place(F.col(col))
        maps = ids.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
        self.maps = cut_narrow(maps)

    def _place(self, col: Column) -> Column:
        return F.pmod(F.xxhash64(col, F.lit(7)), F.lit(self.bits)) + 1

    def marked(self, df: DataFrame, col: str, name: str) -> DataFrame:
        """df with the boolean column `name`: false where the id is surely not among the ids."""
        taken = [*df.columns, name]
        bucket, bitmap = fresh(taken, "_bucket"), fresh(taken, "_bitmap")
        maps = F.broadcast(self.maps.toDF(bucket, bitmap))
        bit = F.bitmap_bit_position(self._place(F.col(col)))
        byte = F.conv(F.hex(F.substring(F.col(bitmap), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        joined = df.join(maps, F.bitmap_bucket_number(self._place(F.col(col))) == F.col(bucket), "left")
        return joined.withColumn(name, F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))).select(*df.columns, name)

    def maybe(self, df: DataFrame, col: str) -> DataFrame:
        """The rows of df whose id is among the ids, and a few more."""
        name = fresh(df.columns, "_maybe")
        return self.marked(df, col, name).filter(F.col(name)).drop(name)
