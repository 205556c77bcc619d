"""Session settings and the shared folder used for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# forceOptimizeSkewedJoin: split a hot key even when the next operator then needs one more shuffle.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
}

FREED_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "grouptrace", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {"spark.ui.enabled": "false", **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime settings the jobs rely on in a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; a temporary one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="grouptrace-")
    return _LOCAL_DIRS[context.applicationId]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/grouptrace/{label}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a job go as soon as it ends, not when the driver's garbage is collected."""
    before = spark.conf.get(FREED_SHUFFLES)
    spark.conf.set(FREED_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED_SHUFFLES, before)


class Scratch:
    """Tables in the shared folder that are removed, one by one or together, once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame, label: str) -> DataFrame:
        path = work_path(self.spark, label)
        self.paths.append(path)
        # In small row groups: a task that reads row by row holds no more.
        df.write.options(**{"compression": "zstd", "parquet.block.size": 16 << 20}).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, label: str) -> str:
        """Where the last table stored under a label lies."""
        return next(path for path in reversed(self.paths) if _labelled(path, label))

    def drop(self, label: str) -> None:
        """Remove the tables stored under a label, if there are any."""
        self._remove([path for path in self.paths if _labelled(path, label)])

    def clear(self) -> None:
        self._remove(self.paths)

    def _remove(self, paths: list[str]) -> None:
        for path in paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths = [path for path in self.paths if path not in paths]


def _labelled(path: str, label: str) -> bool:
    return path.rsplit("/", 1)[1].rsplit("-", 1)[0] == label


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and lost executors cost nothing."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

