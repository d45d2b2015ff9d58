"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Drops the shuffle files of a query when it ends, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local: list[str] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; where that is unset, under a folder of this process, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="attesto-"))
        root = _local[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends there, and each row is computed once.

    The writer commits by task, so a lost executor costs its running tasks only. The shuffle files of the query that
    writes it go when it ends.
    """
    return stage_parts([df], name, compression)


def stage_parts(parts: Iterable[DataFrame], name: str, compression: str = "snappy") -> DataFrame:
    """The rows of several DataFrames of one schema in one staged table, written one after the other, so that only one part's shuffle files are there at a time."""
    table = None
    for df in parts:
        spark = df.sparkSession
        path = shared_dir(spark, name) if table is None else path
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("append").option("compression", compression).parquet(path)
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        table = df
    table = spark.read.schema(table.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for table in tables:
        if path := _paths.pop(table, None):
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` rows in this session, unless it has a setting of its own: with Spark's 10,000 rows, a worker holds tens of megabytes of text at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name
