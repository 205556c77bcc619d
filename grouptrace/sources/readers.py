"""Readers. Text formats get their schema, so no pass over the data is spent on inference; Parquet has its own."""

from __future__ import annotations

import csv
import io
import os
import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grouptrace.functions.text import file_name_of, regex_struct
from grouptrace.functions.values import NULL_TOKENS, null_if_token
from grouptrace.operators.ranking import distinct_on, spread_row_number
from grouptrace.sources.schemas import batch_header

# A batch file is named e.g. "Export (DATA with ids) 1-1000.csv".
BATCH_NAME_PATTERN = r"\((\w+) with [^)]*\) (\d+)-(\d+)"

# File names, or lines and their bytes, that a task holds at once.
NAMES_AT_ONCE = 10_000
BYTES_AT_ONCE = 8 << 20


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, multi_line: bool = True) -> DataFrame:
    """CSV with a header and quoted fields. Empty unquoted cells are NULL; the text ``NA`` is data.

    The header has to name the schema's columns in their order, else the read fails. Quoted cells may hold line breaks;
    a file is then read by one task. ``multi_line=False`` splits large files that have none.
    """
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return reader.option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path)


def infer_csv_schema(spark: SparkSession, path: str) -> T.StructType:
    """Exploratory helper: the schema Spark would infer, to be written down and given to ``read_csv``."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path).schema


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested documents, one per line; a directory of one-document files works as well."""
    return spark.read.schema(schema).json(path)


def parse_json_documents(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Documents held as text in a column."""
    parsed = df.withColumn("_document", F.from_json(F.col(text), schema))
    return parsed.select(*[c for c in df.columns if c != text], "_document.*")


def _is_hidden(name: str) -> bool:
    """Whether Spark's readers leave a file out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _uri_name(name: str) -> str:
    """A file's name as Spark's ``_metadata.file_name`` gives it, that is, as it stands in a URI."""

    def quoted(found: re.Match) -> str:
        kept = not found[0].isascii() and unicodedata.category(found[0]) not in ("Zs", "Zl", "Zp", "Cc")
        return found[0] if kept else quote(found[0], safe="")

    return re.sub(r"[^\w\-!.~'()*:@&=+$,;]", quoted, name)


def _names_in(folder: str) -> Iterator[str]:
    """The names of the files straight in a folder, from a local one as they are found."""
    store, root = fs.FileSystem.from_uri(folder)
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(root) as entries:
            yield from (x.name for x in entries if x.is_file() and not _is_hidden(x.name))
    else:
        for x in store.get_file_info(fs.FileSelector(root)):
            if x.type == fs.FileType.File and not _is_hidden(x.base_name):
                yield x.base_name


def _lines_of(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    """A file's lines as Spark's JSON reader takes them: those with nothing but spaces are none, one that isn't UTF-8 is no document."""
    if path.endswith((".deflate", ".snappy", ".lz4")):
        # Spark's reader decodes Hadoop's own forms of these; taken as text they would be rows without values.
        raise ValueError(f"{path}: compressed in a way that only Spark's JSON reader knows")
    with io.TextIOWrapper(store.open_input_stream(path), "utf-8-sig", "surrogateescape", newline=None) as text:
        for line in text:
            if line.strip(" \t\n"):
                try:
                    yield line.encode()
                except UnicodeEncodeError:
                    yield b"{"


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, value): the lines of all files straight in a folder, their names as in a URI. ``folder`` is a path or a URI that pyarrow knows.

    One task lists the folder, and all tasks read the files. The driver knows none of them, however many there are.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = _names_in(folder) if batch.num_rows else iter(())
            while some := list(islice(names, NAMES_AT_ONCE)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["file_name"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)

        def rows(names: list[str], lines: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(lines, pa.binary()).cast(pa.string())], names=["file_name", "value"])

        names, lines, held = [], [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                name = _uri_name(file)
                for line in _lines_of(store, f"{root}/{file}"):
                    names.append(name)
                    lines.append(line)
                    held += len(line)
                    if held > BYTES_AT_ONCE or len(lines) == NAMES_AT_ONCE:
                        yield rows(names, lines)
                        names, lines, held = [], [], 0
        if lines:
            yield rows(names, lines)

    # A fixed number: by their bytes alone, which are few, all names would fall to one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = spark.range(0, 1, 1, 1).mapInArrow(listed, "file_name string").repartition(tasks, "file_name")
    return names.mapInArrow(read, "file_name string, value string")


def _is_folder(path: str) -> bool:
    """Whether pyarrow knows a folder of this name."""
    try:
        store, root = fs.FileSystem.from_uri(path)
        return store.get_file_info(root).type == fs.FileType.Directory
    except (pa.ArrowException, OSError, ValueError):
        return False


def compact_json_documents(spark: SparkSession, path: str, schema: str, target: str) -> DataFrame:
    """Read many small documents once and keep them as Parquet with their file name.

    The files are listed and read by tasks; what isn't a folder that pyarrow knows is listed by Spark's driver.
    """
    if _is_folder(path):
        lines = document_lines(spark, path)
        row = T.StructType.fromDDL(schema)
        rows = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", T.ArrayType(row))).otherwise(
            F.array(F.from_json("value", row)))
        # A line that can't be read is a row without values; one that is a list has a row for each of its documents.
        read = lines.select(F.inline(F.coalesce(rows, F.array(F.lit(None).cast(row)))), "file_name")
        documents = read.select(*[F.col(f"`{f.name}`") for f in row.fields], "file_name")
    else:
        documents = read_json_documents(spark, path, schema).select("*", F.col("_metadata.file_name").alias("file_name"))
    documents.write.mode("overwrite").parquet(target)
    return spark.read.schema(documents.schema).parquet(target)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array; fields outside the schema are left out. For small dimensions."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def clean_tokens(
    df: DataFrame, types: Mapping[str, str], tokens: Sequence[str] = NULL_TOKENS
) -> DataFrame:
    """Text columns: missing-value tokens to NULL everywhere, then a tolerant cast of the listed columns."""

    def cleaned(field: T.StructField) -> Column:
        if not isinstance(field.dataType, T.StringType):
            return F.col(field.name)
        value = null_if_token(F.col(field.name), tokens)
        if field.name in types:
            value = value.try_cast(types[field.name])
        return value.alias(field.name)

    return df.select(*[cleaned(f) for f in df.schema.fields])


LOCK_PREFIX = "~$"


def _plain_name(name: Column) -> Column:
    """A file name out of a URI."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(file_path) of the files in a folder. Only the listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(_plain_name(F.col("path")).alias("file_path"))


# The first record of a CSV text: cells without quotes or line breaks, and quoted cells. Possessive, so that no header is too long.
_FIRST_RECORD = r'^((?:[^"\r\n]++|"(?:[^"]++|"")*+")++)(\r\n|\r|\n)?'


def _as_glob(path: str) -> str:
    """A path that stands for itself where a pattern is expected."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def batch_headers(spark: SparkSession, path: str) -> dict[tuple[tuple[str, ...], str], list[str]]:
    """The headers that occur in batch files, with the line end behind them, each with its files; lock files and empty
    files are left out.

    One short row per file comes to the driver, which lists the files for any scan.
    """
    files = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.col("content").cast("string"), "^\uFEFF", "")
    head, end = F.regexp_extract(text, _FIRST_RECORD, 1), F.regexp_extract(text, _FIRST_RECORD, 2)
    named = files.filter(~F.startswith(file_name_of(_plain_name(F.col("path"))), F.lit(LOCK_PREFIX)))
    found: dict[tuple[tuple[str, ...], str], list[str]] = {}
    for row in named.select("path", head.alias("head"), end.alias("end")).filter("head <> ''").collect():
        names = tuple(next(csv.reader(io.StringIO(row["head"], newline=""))))
        found.setdefault((names, row["end"]), []).append(row["path"])
    return found


def read_batches(
    spark: SparkSession, path: str, columns: Sequence[str], header: Callable[[str], str] = batch_header
) -> DataFrame:
    """Batch files as (file_name, row_in_file, *columns), every cell as text; lock files are left out.

    Cells are found by each file's own header, in whatever order it names them, after ``header`` has made its names
    canonical; a file without a column gives NULL there. Files with equal headers are one scan, with a schema as wide as their
    header, of which only the wanted columns are parsed. Cells and headers may hold line breaks. A file is read by one task, so
    its rows are numbered from 1 as they stand in it. Cells beyond the header's are left out.
    """
    scans = []
    for (names, line_end), paths in sorted(batch_headers(spark, path).items()):
        canonical = [header(n) for n in names]
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        if line_end:
            reader = reader.option("lineSep", line_end)
        cells = [
            (F.col(f"c{canonical.index(c)}") if c in canonical else F.lit(None).cast("string")).alias(c) for c in columns
        ]
        scans.append(reader.csv([_as_glob(p) for p in sorted(paths)]).select(
            F.col("_metadata.file_path").alias("_path"), _plain_name(F.col("_metadata.file_name")).alias("file_name"),
            F.monotonically_increasing_id().alias("_line"), *cells))
    if not scans:
        return spark.createDataFrame([], T.StructType([
            T.StructField("file_name", T.StringType()), T.StructField("row_in_file", T.LongType()),
            *[T.StructField(c, T.StringType()) for c in columns]]))
    rows = reduce(DataFrame.unionByName, scans)
    in_file = F.row_number().over(Window.partitionBy("_path").orderBy("_line")).cast("long")
    return rows.select("file_name", in_file.alias("row_in_file"), *columns)


def batch_catalog(files: DataFrame, path: str = "file_path", pattern: str = BATCH_NAME_PATTERN) -> DataFrame:
    """One row per batch file: name, dataset type, first and last query number, range; lock files left out."""
    named = files.select(F.col(path).alias("file_path"), file_name_of(F.col(path)).alias("file_name"))
    parts = regex_struct(F.col("file_name"), pattern, ["dataset_type", "query_num_start", "query_num_end"])
    return (
        named.filter(~F.startswith("file_name", F.lit(LOCK_PREFIX)))
        .withColumn("_parts", parts)
        .select(
            "file_path",
            "file_name",
            F.col("_parts.dataset_type").alias("dataset_type"),
            F.col("_parts.query_num_start").try_cast("int").alias("query_num_start"),
            F.col("_parts.query_num_end").try_cast("int").alias("query_num_end"),
        )
        .withColumn("query_range", F.concat(F.col("query_num_start"), F.lit("-"), F.col("query_num_end")))
        .orderBy("dataset_type", "query_num_start", "file_name")
    )


def query_ranges(catalog: DataFrame) -> DataFrame:
    """The distinct ranges in order of their start: one row per range with its position."""
    ranges = distinct_on(catalog.select("query_range", "query_num_start"), ["query_range"], ["query_num_start"])
    return spread_row_number(ranges, [F.asc("query_num_start"), F.asc("query_range")], "position")


def query_range_list(catalog: DataFrame) -> DataFrame:
    """The distinct ranges as one ordered list, one row (query_ranges). As long as there are batches: a list to be shown."""
    ranges = distinct_on(catalog.select("query_range", "query_num_start"), ["query_range"], ["query_num_start"])
    listed = F.sort_array(F.collect_list(F.struct("query_num_start", "query_range")))
    return ranges.agg(F.transform(listed, lambda r: r.query_range).alias("query_ranges"))


def attach_positional_ids(
    rows: DataFrame, id_lists: DataFrame, source: str, ordinal: str, ids: str, name: str, delimiter: str = ", "
) -> DataFrame:
    """Attach the n-th id of a source's id list to its n-th row (``ordinal`` starts at 1), id first."""
    listed = id_lists.select(source, F.posexplode(F.split(F.col(ids), delimiter)).alias("_pos", name))
    listed = listed.withColumn(ordinal, (F.col("_pos") + 1).cast(rows.schema[ordinal].dataType)).drop("_pos")
    return rows.join(listed, [source, ordinal], "left").select(name, *rows.columns)


def tagged_union(parts: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Several sources of one shape, each row tagged with the name of its source."""
    tagged = [df.withColumn(tag, F.lit(label)) for label, df in parts.items()]
    result = tagged[0]
    for df in tagged[1:]:
        result = result.unionByName(df)
    return result
