"""Samples that are the same on every run: chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_hash(col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")))


def sample_ids(df: DataFrame, column: str, fraction: float, seed: int = 1) -> DataFrame:
    """All rows of about ``fraction`` of the ids: a filter, so nothing is shuffled."""
    bound = f"{int(fraction * 16**8):08x}"
    return df.filter(F.substring(id_hash(F.col(column), seed), 1, 8) < bound)


def sample_files(df: DataFrame, fraction: float, seed: int = 1) -> DataFrame:
    """All rows of about ``fraction`` of the files of a scan, chosen by a hash of the file's name.

    The choice is a filter on file metadata, which Spark applies to its listing: other files are never opened. Rows of a file
    are alike, so the error is that of a sample of files; ``sample_ids`` reads all files and has none of that.
    """
    bound = f"{int(fraction * 16**8):08x}"
    return df.filter(F.substring(id_hash(F.col("_metadata.file_name"), seed), 1, 8) < bound)


def sample_rows(df: DataFrame, column: str, rows: int, seed: int = 1) -> DataFrame:
    """A fixed number of rows; each task keeps only that many before they are merged."""
    return df.orderBy(id_hash(F.col(column), seed), column).limit(rows)
