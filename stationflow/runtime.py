"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir`` of the session.

    Only a local master (tests) may run without it; there a private folder is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _LOCAL_DIRS:
        made = _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="stationflow-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return _LOCAL_DIRS[context.applicationId]


def staging_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/stationflow/{app}/{label}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def staging_scope(spark: SparkSession):
    """Tables staged inside are deleted at the end: for jobs that leave only product tables behind."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete_path(spark, path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Spread a small table over all cores before its rows are multiplied.

    A table of stations may sit in one small partition; generating every hour from it there
    would be one task's work. The explicit number keeps AQE from merging the pieces again.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *columns)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where one intermediate result feeds several branches: the lineage is cut, a
    lost executor only costs a re-read, and the file sizes let Catalyst choose join
    strategies from real statistics instead of the size of the raw input.
    """
    spark = df.sparkSession
    path = staging_path(spark, label)
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
