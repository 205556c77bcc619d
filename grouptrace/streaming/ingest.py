"""Incremental ingest of registry pages.

A page starts at the highest registration number stored so far, so records at the page border arrive
again. They are stored once: a record is identified by all its content, not by request or record id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grouptrace.functions.text import snake_case
from grouptrace.functions.values import zone_iso_text
from grouptrace.operators.joins import anti_join
from grouptrace.operators.ranking import distinct_on
from grouptrace.operators.reshape import rename_by

CONTENT = (
    "registration_number", "registration_index", "corp_name", "profit_type_es", "status_id", "status_es",
)


def parse_page_records(page: DataFrame, request_id: int | Column) -> DataFrame:
    """Records of a search page under the store's column names, with the id of the request."""
    value = request_id if isinstance(request_id, Column) else F.lit(request_id)
    return rename_by(page, snake_case).withColumn("request_id", value.cast("long"))


def request_log(pages: DataFrame, sent_at_utc: str, zone: str, offset: str) -> DataFrame:
    """One row per request with the time it was sent, as ISO text in the registry's zone."""
    stamp = zone_iso_text(F.to_timestamp(F.lit(sent_at_utc)), zone, offset)
    return pages.select("request_id").distinct().withColumn("request_sent_timestamp", stamp)


def high_water_mark(store: DataFrame) -> DataFrame:
    """Where the next page has to start."""
    return store.agg(F.max("registration_number").alias("registration_number"))


def page_report(pages: DataFrame, page_limit: int) -> DataFrame:
    """Per request: rows, first and last number, and the two warnings of a stalled or finished run."""
    report = pages.groupBy("request_id").agg(
        F.count("*").alias("records"),
        F.min("registration_number").alias("first_number"),
        F.max("registration_number").alias("last_number"),
    )
    return report.withColumn("did_not_advance", F.col("first_number") == F.col("last_number")).withColumn(
        "short_page", F.col("records") < page_limit
    )


def new_records(batch: DataFrame, store: DataFrame, content: Sequence[str] = CONTENT) -> DataFrame:
    """Records of a batch that the store lacks, the earliest copy of each.

    Only stored records at or above the batch's first number can be equal, so older ones are skipped
    in the scan.
    """
    lowest = batch.agg(F.min("registration_number")).scalar()
    recent = store.filter(F.col("registration_number") >= lowest)
    return anti_join(distinct_on(batch, content, ["record_id"]), recent, content)


def ingest_batch(store: DataFrame, pages: DataFrame, content: Sequence[str] = CONTENT) -> DataFrame:
    """The store after adding pages, as one batch step."""
    return store.unionByName(new_records(pages, store, content))


#: Registration numbers per folder of the stream's store.
RANGE = 100_000


def _ranges(records: DataFrame) -> DataFrame:
    return records.withColumn("number_range", F.floor(F.col("registration_number") / RANGE).cast("bigint"))


def _stored(spark: SparkSession, store_path: str, schema, ranges: Sequence[int] | None = None) -> DataFrame:
    """The store, or the given number ranges of it; only their folders are listed."""
    paths = [store_path]
    if ranges is not None:
        files = spark._jvm.org.apache.hadoop.fs
        folder = files.Path(store_path).getFileSystem(spark._jsc.hadoopConfiguration())
        named = [f"{store_path}/number_range={r}" for r in ranges]
        paths = [p for p in named if folder.exists(files.Path(p))]
    ddl = f"{schema.toDDL()}, number_range bigint, batch bigint"
    if not paths:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).option("basePath", store_path).parquet(*paths)


def ingest_stream(
    spark: SparkSession,
    pages_path: str,
    store_path: str,
    checkpoint_path: str,
    schema,
    content: Sequence[str] = CONTENT,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Take in all page files that are waiting and return the store.

    The store is cut by number range. A micro-batch reads the ranges that its own numbers touch, and replaces its folders
    ``number_range=<r>/batch=<id>`` there: a batch repeated after a failure compares itself with the earlier ones only,
    so every record lands exactly once, and the work of a batch doesn't grow with the store.
    """
    columns = [f.name for f in schema.fields]

    def add(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch = batch.select(*columns)
        # As many as the batch's numbers span folders; equal records have equal numbers.
        touched = [r["number_range"] for r in _ranges(batch).select("number_range").distinct().collect()]
        earlier = _stored(session, store_path, schema, [r for r in touched if r is not None])
        fresh = new_records(batch, earlier.filter(F.col("batch") < batch_id).select(*columns), content)
        placed = _ranges(fresh).withColumn("batch", F.lit(batch_id).cast("bigint"))
        writer = placed.repartition("number_range").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("number_range", "batch").parquet(store_path)

    spark.createDataFrame([], _ranges(spark.createDataFrame([], schema)).schema).write.mode("ignore").parquet(store_path)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.parquet(pages_path)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _stored(spark, store_path, schema).select(*columns)


def compacted(spark: SparkSession, store_path: str, schema, target: str) -> DataFrame:
    """A copy of the store with one folder of files per number range, for readers and as the next run's start."""
    rows = _stored(spark, store_path, schema).withColumn("batch", F.lit(-1).cast("bigint"))
    rows.repartition("number_range").write.partitionBy("number_range", "batch").parquet(target)
    return _stored(spark, target, schema).select(*[f.name for f in schema.fields])


#: Rows of a task's batch that wait, at least, until copies among them are dropped.
REDUCE_ROWS = 200_000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_stateful_ingest(
    spark: SparkSession,
    pages_path: str,
    store_path: str,
    checkpoint_path: str,
    schema,
    content: Sequence[str] = CONTENT,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """A stream that stores every record once and never reads its store: which contents have come is Spark's keyed state.

    The first batch with a content stores its copy with the smallest record_id. Records are dealt by content, each task passes on
    the smallest copy of each content in the batch, and Spark's own deduplication drops those that came in earlier batches.
    Its state is one key for each content, is cut by the content's hash and lives in RocksDB, on the executors' disks and in
    the checkpoint, so a restarted stream goes on where it was, and so does the file sink, whose log lets readers see each
    batch once and whole. Contents are remembered for ever, as a collection may be run again from any number.
    """
    columns, content = [f.name for f in schema.fields], list(content)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    # Null record ids come last; the other columns only settle which of two copies with one record_id it is.
    order = [(c, "ascending") for c in ("record_id", *(c for c in columns if c not in (*content, "record_id")))]

    def first_copies(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, rows = None, [], 0

        def reduced() -> pa.Table:
            table = pa.concat_tables([*([kept] if kept is not None else []), *waiting]).sort_by(order)
            table = table.append_column("_place", pa.array(np.arange(len(table))))
            places = table.group_by(content).aggregate([("_place", "min")])["_place_min"]
            return table.drop_columns("_place").take(places)

        for page in pages:
            waiting.append(pa.Table.from_batches([page]))
            rows += len(page)
            # Copies of what is kept go before they amount to as much again.
            if rows >= max(REDUCE_ROWS, len(kept) if kept is not None else 0):
                kept, waiting, rows = reduced(), [], 0
        if waiting:
            kept = reduced()
        if kept is not None:
            yield from kept.to_batches(max_chunksize=10_000)

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = reader.parquet(pages_path).select(*columns).repartition(tasks, *content)
    fresh = pages.mapInArrow(first_copies, schema).dropDuplicates(content)
    writer = fresh.writeStream.format("parquet").outputMode("append").option("path", store_path)
    return writer.option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()


def ingest_stateful(
    spark: SparkSession, pages_path: str, store_path: str, checkpoint_path: str, schema, content: Sequence[str] = CONTENT,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Take in all page files that are waiting with keyed state, and return the store."""
    query = start_stateful_ingest(spark, pages_path, store_path, checkpoint_path, schema, content, files_per_batch)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(store_path)
