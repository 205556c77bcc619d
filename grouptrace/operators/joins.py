"""Joins that stay balanced when one key holds a large share of the rows.

No join here is told to broadcast: Spark does so by itself where the file size, or the size AQE
measured after a shuffle, is under its threshold, and otherwise shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _all_known(columns: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def _distinct_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.filter(_all_known(on)).select(*on).distinct()


def left_join_fanout(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join whose right side may repeat one key very often; every match is kept.

    Spark splits a hot partition on both sides of an inner join and on the left of an anti join, but
    never on the right of an outer join. So: matched rows by inner join, the rest by anti join against
    the distinct keys. Both need the left side: give a stored table where it is dear to compute. Where the
    right keys are nearly unique, a plain left join is the better choice. Rows with a NULL key meet no partner and
    pass by without a shuffle, where they would all fall into one partition.
    """
    on = list(on)
    extra = [c for c in right.columns if c not in on]
    known = _all_known(on)
    keyed = left.filter(known)
    matched = keyed.join(right.filter(known), on, "inner")
    unmatched = keyed.join(_distinct_keys(right, on), on, "left_anti")
    return (
        matched.unionByName(unmatched, allowMissingColumns=True)
        .unionByName(left.filter(~known), allowMissingColumns=True)
        .select(*left.columns, *extra)
    )


def anti_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a partner; the right side is reduced to its distinct keys first."""
    return left.join(_distinct_keys(right, on), list(on), "left_anti")


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(_distinct_keys(right, on), list(on), "left_semi")


#: Bits of a key bitmap, 8 MB in all, and of each of its rows (fixed by Spark's bitmap functions).
BITMAP_BITS = 1 << 26
BITMAP_ROW_BITS = 32_768


def _bit(on: Sequence[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(bits))


def key_bitmap(right: DataFrame, on: Sequence[str], bits: int = BITMAP_BITS) -> DataFrame:
    """(bucket, bitmap): the bits of all keys' hashes, at most bits / BITMAP_ROW_BITS rows of 4 kB whatever the keys."""
    place = right.filter(_all_known(on)).select(_bit(on, bits).alias("_bit"))
    return place.groupBy(F.bitmap_bucket_number("_bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("bitmap"))


def bitmap_anti_join(left: DataFrame, right: DataFrame, on: Sequence[str], bits: int = BITMAP_BITS) -> DataFrame:
    """``anti_join`` for a large left side most of whose rows have no partner: these skip the shuffle.

    A bitmap of the right side's hashed keys, of fixed size, goes to all tasks. A left row whose bit isn't set has no partner
    for sure. Only the others are shuffled and compared key by key, so the result is exact however full the bitmap is: full,
    it only spares nothing. The left side is read twice: give a stored table where it is dear to compute.
    """
    on = list(on)
    bitmaps = key_bitmap(right, on, bits)
    marked = left.withColumn("_bit", F.when(_all_known(on), _bit(on, bits)))
    place = F.bitmap_bit_position("_bit")
    # Bit n of a row is bit n % 8 of its byte n / 8.
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))
    looked = marked.join(
        F.broadcast(bitmaps), F.bitmap_bucket_number("_bit") == F.col("bucket"), "left").withColumn("_may", is_set)
    sure = looked.filter(~F.col("_may")).select(*left.columns)
    return sure.unionByName(anti_join(looked.filter("_may").select(*left.columns), right, on))
