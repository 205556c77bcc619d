"""Small documents as they are collected: only those that haven't been seen are read and added to one large table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def start_compacting(
    spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 100_000
) -> StreamingQuery:
    """A stream that appends the folder's new one-document files to a Parquet table, with their file name.

    Which files it has read is the stream's own log in the checkpoint, and the sink's log makes each batch appear once. A file that
    is written again under a name already read counts as read.
    """
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    named = new.select("*", F.col("_metadata.file_name").alias("file_name"))
    writer = named.writeStream.format("parquet").outputMode("append").option("path", target)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_new_documents(
    spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 100_000
) -> DataFrame:
    """Add what is new in the folder and return the whole table; the next run goes on from the checkpoint."""
    start_compacting(spark, folder, schema, target, checkpoint, files_per_batch).awaitTermination()
    return spark.read.schema(f"{schema}, file_name string").parquet(target)
