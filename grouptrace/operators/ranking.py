"""Distinct rows, top-k, and row numbers that never put a whole table or a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grouptrace.session import materialize

def distinct_first_seen(df: DataFrame, columns: Sequence[str], seen: str) -> DataFrame:
    """Distinct ``columns`` with the smallest ``seen`` value, so that first-seen order can be kept."""
    return df.groupBy(*columns).agg(F.min(seen).alias(seen))


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that is smallest in ``order`` and then in the remaining columns, NULL last.

    An aggregate, not a window: repeated keys are reduced before the shuffle.
    """
    rest = [c for c in order if c not in keys]
    rest += [c for c in df.columns if c not in keys and c not in rest]
    if not rest:
        return df.select(*keys).distinct()
    # A known value sorts before NULL: false comes before true.
    ranked = F.struct(*[F.struct(F.col(c).isNull().alias("unknown"), F.col(c).alias("value")).alias(c) for c in rest])
    best = df.groupBy(*keys).agg(F.min(ranked).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}.value").alias(c) for c in rest]).select(*df.columns)


def top_k(df: DataFrame, partition_by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per group. Spark keeps only k rows per group and task before the shuffle."""
    window = Window.partitionBy(*partition_by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def dense_row_id(df: DataFrame, source: str, ordinal: str, name: str) -> DataFrame:
    """1-based dense row id over rows ordered by (source, ordinal within the source).

    Sources and rows are cut into ranges of their order, so neither a large source nor many small ones meet in one task.
    """
    order = [F.col(source).asc_nulls_first(), F.asc(ordinal)]
    return spread_row_number(df, order, name).select(name, *df.columns)


def spread_row_number(
    df: DataFrame,
    order: Sequence[Column],
    name: str,
    partition_by: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """``row_number()`` over sorted groups of any size, also over the whole table.

    The rows are range-partitioned by (group, order) into slices, so a large group is cut at order
    values. They are numbered per (slice, group), and a group that runs on from earlier slices gets
    their row count added. Only the first group of a slice can have such rows, so the table of
    offsets has at most one row per slice. ``order`` must be unique within a group.
    """
    group = list(partition_by)
    keys = [F.col(c).asc_nulls_first() for c in group] + list(order)
    # Without a given number AQE merges neighbouring ranges to slices of its advisory size.
    ranged = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    # Written once: the slice of a row must be the same for the numbering and for the counts.
    placed = materialize(ranged.withColumn("_slice", F.spark_partition_id()), "sliced")
    in_slice = Window.partitionBy("_slice", *group).orderBy(*order)
    numbered = placed.withColumn("_inside", F.row_number().over(in_slice))

    sizes = placed.groupBy("_slice", *group).agg(F.count("*").alias("_rows"))
    if group:
        earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        counted = sizes.withColumn("_before", F.sum("_rows").over(earlier))
    else:
        # One number per slice, i.e. per task: summed up here.
        counts = sorted((r["_slice"], r["_rows"]) for r in sizes.collect())
        before = accumulate((n for _, n in counts), initial=0)
        rows = [(number, n) for (number, _), n in zip(counts, before)]
        counted = df.sparkSession.createDataFrame(rows, "_slice int, _before long")
    offsets = (
        counted
        .filter("_before > 0")
        .select("_slice", "_before", *[F.col(c).alias(f"_group_{c}") for c in group])
    )
    same = F.col("n._slice") == F.col("o._slice")
    for c in group:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o._group_{c}"))
    joined = numbered.alias("n").join(F.broadcast(offsets.alias("o")), same, "left")
    number = F.col("n._inside") + F.coalesce(F.col("o._before"), F.lit(0))
    return joined.select(*[F.col(f"n.{c}") for c in df.columns], number.cast("long").alias(name))
