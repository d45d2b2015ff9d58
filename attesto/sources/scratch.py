"""Intermediate tables of iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_paths: WeakKeyDictionary[DataFrame, tuple[str, str | None]] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of this process, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="attesto-core-"))
    return _local[0]


#: Drops the shuffle files of a query when it ends, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: str | None = None, parts: int = 0) -> DataFrame:
    """``df`` as a table that is computed once; its lineage ends there, so a lost executor costs its running tasks only.

    With ``by``, it lies in ``parts`` buckets of that column, so that grouping and joining by it shuffle nothing. The shuffle files of the query
    that writes it go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        if by:
            table = f"attesto_{name}_{uuid.uuid4().hex}"
            df.write.option("path", path).option("compression", "zstd").bucketBy(parts, by).saveAsTable(table)
            out = spark.table(table)
            _paths[out] = path, table
            return out
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path, None
    return out


def written_in_turns(turns: Iterable[DataFrame], name: str, by: str, parts: int) -> DataFrame:
    """The rows of several DataFrames of one schema as one table in ``parts`` buckets of ``by``, one after the other, so that only one's shuffle files are there at a time."""
    path, table = None, f"attesto_{name}_{uuid.uuid4().hex}"
    for df in turns:
        spark = df.sparkSession
        path = path or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.repartition(parts, by).write.mode("append").option("path", path).option("compression", "zstd").bucketBy(parts, by).saveAsTable(table)
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.table(table)
    _paths[out] = path, table
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        if found := _paths.pop(df, None):
            path, table = found
            spark = df.sparkSession
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
