"""Keyed tables as immutable versions: insert-if-absent, upsert, refresh, incremental append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grouptrace.operators.joins import anti_join
from grouptrace.operators.ranking import distinct_on
from grouptrace.session import materialize


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pass the table on; the job fails when a key occurs twice. Checked inside the plan, no extra job."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(*rest)).alias("_row"))
    error = F.raise_error(F.concat_ws(" ", F.lit("duplicate key:"), *[F.col(k).cast("string") for k in keys]))
    checked = grouped.withColumn("_row", F.when(F.col("_n") == 1, F.col("_row")).otherwise(error))
    return checked.select(*keys, "_row.*").select(*df.columns)


def insert_if_absent(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append rows whose key is not stored yet; the first of equal new keys is taken, missing columns are NULL."""
    fresh = anti_join(distinct_on(new, keys, keys), table, keys)
    return table.unionByName(fresh, allowMissingColumns=True)


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Insert new keys; for stored keys take ``update`` from the new row, also where it is NULL."""
    incoming = assert_unique(new, keys)
    present = [c for c in table.columns if c in new.columns and c not in keys]
    sides = table.withColumn("_new", F.lit(False)).unionByName(
        incoming.withColumn("_new", F.lit(True)), allowMissingColumns=True
    )
    rest = [c for c in table.columns if c not in keys]
    # One shuffle by key; each key has at most one stored and one incoming row.
    both = sides.groupBy(*keys).agg(
        F.max(F.when(~F.col("_new"), F.struct(F.lit(1).alias("_set"), *rest))).alias("_old"),
        F.max(F.when(F.col("_new"), F.struct(F.lit(1).alias("_set"), *rest))).alias("_in"),
    )
    stored, arrived = F.col("_old").isNotNull(), F.col("_in").isNotNull()
    columns = []
    for c in rest:
        if c in update:
            value = F.when(arrived, F.col(f"_in.{c}")).otherwise(F.col(f"_old.{c}"))
        elif c in present:
            value = F.when(stored, F.col(f"_old.{c}")).otherwise(F.col(f"_in.{c}"))
        else:
            value = F.col(f"_old.{c}")
        columns.append(value.alias(c))
    return both.select(*keys, *columns).select(*table.columns)


def refresh_from(table: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """UPDATE ... FROM: overwrite ``update`` where the source has the keys, leave other rows alone.

    No row is ever added: of several source rows with one key the smallest ``update`` values, in their order and with
    NULL last, are taken.
    """
    keys = list(keys)
    values = distinct_on(source.select(*keys, *update), keys, list(update))
    values = values.select(*keys, F.struct(*update).alias("_from"))
    joined = table.join(values, keys, "left")
    hit = F.col("_from").isNotNull()
    return joined.select(
        *[
            F.when(hit, F.col(f"_from.{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c)
            for c in table.columns
        ]
    )


def write_version(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Store the next version of a keyed table in a folder of its own; a repeated key fails the write."""
    number = max(versions(df.sparkSession, path), default=-1) + 1
    assert_unique(df, keys).write.parquet(f"{path}/version={number}")
    return number


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table, in order."""
    files = spark._jvm.org.apache.hadoop.fs
    folder = files.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    paths = [s.getPath() for s in system.listStatus(folder)]
    done = [p for p in paths if system.exists(files.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in done)


def read_version(spark: SparkSession, path: str, schema, number: int | None = None) -> DataFrame:
    """A version of a table, the last one by default."""
    stored = versions(spark, path)
    if not stored:
        raise ValueError(f"no version in {path}")
    return spark.read.schema(schema).parquet(f"{path}/version={stored[-1] if number is None else number}")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def create_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Lay a keyed table out by the hash of its key: one folder ``bucket=<n>`` each. A repeated key fails the write.

    Choose so many buckets that one holds some 100 MB. Rows with a NULL in the key are kept and found like others.
    """
    placed = assert_unique(df, keys).withColumn("bucket", _bucket(keys, buckets))
    placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows")


def read_buckets(spark: SparkSession, path: str, schema: T.StructType, chosen: Sequence[int] | None = None) -> DataFrame:
    """The table, or some of its buckets; only their folders are listed and read."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())]))
    if chosen is None:
        return rows.parquet(f"{path}/rows").drop("bucket")
    folders = [f for f in (f"{path}/rows/bucket={n}" for n in chosen) if _exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], schema)
    return rows.option("basePath", f"{path}/rows").parquet(*folders).drop("bucket")


def upsert_buckets(
    spark: SparkSession, path: str, schema: T.StructType, new: DataFrame, keys: Sequence[str], update: Sequence[str],
    buckets: int, run: int,
) -> list[int]:
    """``upsert`` into a table laid out by ``create_buckets``; gives the buckets that changed.

    Only the buckets of the new keys are read. Of these, only those whose rows differ afterwards are written, by dynamic
    partition overwrite; all other files stay as they are. Each changed row goes to the table's log as it is then, with the
    ``run`` and whether it was added. The log is written before the first bucket, so a run that failed can be repeated: a run
    that is in the log already only brings its buckets to their final state.
    """
    columns = [f.name for f in schema.fields]
    # Equal numbers of different types have different hashes.
    new = new.withColumns({k: F.col(k).cast(schema[k].dataType) for k in keys})
    incoming = materialize(new.withColumn("bucket", _bucket(keys, buckets)), "bucket-input")
    # At most as many as the table has buckets, in any size of input.
    touched = [r["bucket"] for r in incoming.select("bucket").distinct().collect()]
    before = read_buckets(spark, path, schema, touched)
    after = upsert(before, incoming.drop("bucket"), keys, update).withColumn("_new", F.lit(1))
    both = after.unionByName(before.withColumn("_new", F.lit(0)))
    rest = [c for c in columns if c not in keys]
    row = lambda new: F.max(F.when(F.col("_new") == new, F.struct(F.lit(1).alias("_set"), *rest)))
    sides = both.groupBy(*keys).agg(row(0).alias("_old"), row(1).alias("_now"))
    differs = ~F.col("_old").eqNullSafe(F.col("_now"))
    rows = sides.select(
        *[F.col(c) if c in keys else F.col(f"_now.{c}").alias(c) for c in columns],
        F.col("_old").isNull().alias("added"), differs.alias("changed"), _bucket(keys, buckets),
    )
    rows = materialize(rows, "bucket-rows")
    dynamic = {"partitionOverwriteMode": "dynamic"}
    changed = rows.filter("changed").select(*columns, "added", "bucket", F.lit(run).cast("long").alias("run"))
    if not _exists(spark, f"{path}/log/run={run}"):
        changed.write.mode("overwrite").options(**dynamic).partitionBy("run").parquet(f"{path}/log")
    if not _exists(spark, f"{path}/log/run={run}"):
        return []
    changed = bucket_changes(spark, path, schema).filter(F.col("run") == run)
    numbers = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())
    kept = rows.filter(F.col("bucket").isin(numbers)).select(*columns, "bucket")
    kept.repartition("bucket").write.mode("overwrite").options(**dynamic).partitionBy("bucket").parquet(f"{path}/rows")
    return numbers


def bucket_changes(spark: SparkSession, path: str, schema: T.StructType, after_run: int = -1) -> DataFrame:
    """The log's rows of later runs: what a reader of the table as it was after ``after_run`` lacks."""
    extra = [T.StructField("added", T.BooleanType()), T.StructField("bucket", T.IntegerType()), T.StructField("run", T.LongType())]
    logged = T.StructType([*schema.fields, *extra])
    log = spark.read.schema(logged).parquet(f"{path}/log") if _exists(spark, f"{path}/log") else spark.createDataFrame([], logged)
    return log.filter(F.col("run") > after_run)


def append_keys(work: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Add literal keys to a work list; repeated keys and keys already listed are added once."""
    literals = F.array(*[F.lit(k) for k in keys])
    extra = work.sparkSession.range(1).select(F.explode(literals).alias(column))
    return insert_if_absent(work, extra, [column])


def pending(targets: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work still to do: targets without a stored result."""
    return anti_join(targets, done, keys)
