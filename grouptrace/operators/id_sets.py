"""Exact distinct counts of a growing table, kept as bitmaps over dense numbers.

Every id gets a number when it is first seen. A batch stores, for each measure, the bits of the ids that count for it, in
rows of 32,768 bits. Sets of several batches are united bit by bit, so a count over all batches reads the bitmaps and no
old rows, and a batch costs what it holds. Each batch writes folders of its own and looks at earlier ones only: one that is
repeated replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grouptrace.operators.joins import anti_join
from grouptrace.operators.ranking import spread_row_number
from grouptrace.session import materialize

_IDS = "id string, number bigint, batch bigint"
_SETS = "measure string, bucket bigint, bits binary, batch bigint"


def _stored(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    return rows if before is None else rows.filter(F.col("batch") < before)


def add_to_sets(members: DataFrame, path: str, batch: int) -> None:
    """Add a batch of (measure, id) to the sets below ``path``; rows without an id count for nothing."""
    spark = members.sparkSession
    members = materialize(members.filter(F.col("id").isNotNull()).select("measure", F.col("id").cast("string").alias("id")).distinct(), "members")
    earlier = _stored(spark, f"{path}/ids", _IDS, batch)
    last = earlier.agg(F.max("number")).first()[0] or 0
    fresh = spread_row_number(anti_join(members.select("id").distinct(), earlier, ["id"]), [F.asc("id")], "number")
    fresh.select("id", (F.col("number") + last).alias("number")).write.mode("overwrite").parquet(f"{path}/ids/batch={batch}")
    numbers = _stored(spark, f"{path}/ids", _IDS, batch + 1).select("id", "number")
    numbered = members.join(numbers, "id").select("measure", "number")
    sets = numbered.groupBy("measure", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    sets.write.mode("overwrite").parquet(f"{path}/sets/batch={batch}")


def set_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(measure, ids): how many distinct ids each measure has over all batches."""
    united = _stored(spark, f"{path}/sets", _SETS).groupBy("measure", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return united.groupBy("measure").agg(F.sum(F.bitmap_count("bits")).alias("ids"))
