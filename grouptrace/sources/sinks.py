"""Writers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grouptrace.session import work_path


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; array columns have no CSV form and are left out."""
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType)]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_documents(df: DataFrame, path: str, key: str) -> None:
    """Landing of raw documents: large files of one document per line, the id kept as a column."""
    if key not in df.columns:
        raise ValueError(f"documents need their id column {key!r}")
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_records(df: DataFrame, path: str) -> None:
    """Parsed records with their request_id, a folder for each request: a request that comes again replaces its own."""
    writer = df.repartition("request_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("request_id").parquet(path)


def write_bucketed(df: DataFrame, keys: Sequence[str], buckets: int, label: str = "bucketed") -> DataFrame:
    """Store a table once for many joins on ``keys``: cut into buckets by their hash, sorted within, in the shared folder.

    Joins and aggregates on the keys, and joins with tables of as many buckets, read it without a shuffle. The session's
    catalog knows the table under a name of its own.
    """
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.format("parquet").option("path", work_path(df.sparkSession, label)).saveAsTable(name)
    return df.sparkSession.table(name)


def write_named_files(lines: DataFrame, folder: str, name: str, line: str, order: Sequence[str] = (), header: str | None = None) -> int:
    """A text file for each value of ``name``, straight under that name: its lines in the given order, before them its
    ``header``, a column that is the same in all lines of a file. Gives the number of files.

    The tasks write them, each file whole under a hidden name before it gets its own, so a task that is repeated does no harm.
    No folder, commit or driver call is spent on a single file. ``folder`` is a path or a URI that pyarrow knows. Lines
    without a name are left out.
    """
    spark = lines.sparkSession
    # A fixed number: by their bytes alone, which are few, all files would fall to one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = lines.filter(F.col(name).isNotNull()).repartition(tasks, name).sortWithinPartitions(name, *order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        current, out, files, hidden = None, None, 0, f"{root}/_{uuid.uuid4().hex}"

        def close() -> None:
            out.close()
            store.move(hidden, f"{root}/{current}")

        for batch in batches:
            for key, text, above in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if key != current:
                    if out:
                        close()
                    current, out, files = key, store.open_output_stream(hidden), files + 1
                    if header:
                        out.write(f"{above}\n".encode())
                out.write(f"{text or ''}\n".encode())
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    above = F.col(header) if header else F.lit("")
    return named.select(name, line, above.alias("_header")).mapInArrow(write, "files long").agg(F.sum("files")).first()[0] or 0
