"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grouptrace.session import materialize


ROWS_PER_FILE = 200_000


def _directed(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def files_for(rows: int) -> int:
    """How many files a table of short rows is worth."""
    return 1 + rows // ROWS_PER_FILE


def components(links: DataFrame) -> DataFrame:
    """(vertex, root): for each vertex that has a link the smallest vertex it can reach.

    links: columns a, b. Each round hangs every vertex's larger neighbours, then its smaller ones, below the smallest
    of them; when a round changes nothing, each vertex points at its root. Every round is written to the shared folder.
    """
    now = materialize(_directed(links), "links")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.coalesce(files_for(state[0])), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(lower.coalesce(files_for(state[0])), "links")
        before, state = state, _state(now)
        if before == state:
            roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots)
