"""Column selection by pattern, renames, unpivot, pivot, transpose, explode."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching_columns(df: DataFrame, pattern: str) -> list[str]:
    """Names in which the regular expression occurs anywhere, in table order."""
    return [c for c in df.columns if re.search(pattern, c)]


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Bulk rename; an unknown source column is an error rather than a silent no-op."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumnsRenamed(dict(names))


def rename_by(df: DataFrame, rule: Callable[[str], str]) -> DataFrame:
    return df.withColumnsRenamed({c: rule(c) for c in df.columns})


def move_first(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, *[c for c in df.columns if c not in columns])


def map_columns(df: DataFrame, columns: Sequence[str], change: Callable[[Column], Column]) -> DataFrame:
    """Replace several columns in place by a function of themselves."""
    return df.withColumns({c: change(F.col(c)) for c in columns})


def unpivot_known(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Columns to rows, leaving out NULL values."""
    return df.unpivot(list(ids), list(columns), name, value).filter(F.col(value).isNotNull())


def pivot_sum(df: DataFrame, rows: Sequence[str], columns: str, values: Sequence, total: str) -> DataFrame:
    """Rows to columns; combinations that do not occur stay NULL. The value list saves a job."""
    return df.groupBy(*rows).pivot(columns, list(values)).agg(F.sum(total))


def cross_with_list(df: DataFrame, values: Sequence, name: str) -> DataFrame:
    """Every row once per literal value."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def transpose_panel(
    df: DataFrame, period: str, periods: Sequence, indicators: Sequence[str], label: str = "indicator"
) -> DataFrame:
    """Indicators as rows, periods as columns; cells must share one type."""
    long = df.unpivot([period], list(indicators), label, "_value")
    return long.groupBy(label).pivot(period, list(periods)).agg(F.max("_value"))
