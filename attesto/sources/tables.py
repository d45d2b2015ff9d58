"""Readers and writers of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesto.operators.crossfile import replace_verdicts


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table read in ranges of a numeric key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of uploaded files: path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").load(folder)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [x.getPath().getName() for x in files.listStatus(root)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of the verdict table; None before the first."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    """Replaces the verdicts of the files in ``verdicts``; those of all other files, and prompt rules', stay.

    The result is a new version beside the old one, which a reader takes once it is complete, so a failed write loses nothing.
    """
    spark = verdicts.sparkSession
    old = read_verdicts(spark, path)
    number = (_versions(spark, path) or [0])[-1] + 1
    (verdicts if old is None else replace_verdicts(old, verdicts)).write.mode("overwrite").parquet(f"{path}/v={number}")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Files inside ZIP archives: path of the archive, name and content of each file; archives are opened in tasks, one at a time."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for item in archive.infolist():
                        if not item.is_dir():
                            yield pd.DataFrame({"archive": [path], "nom": [item.filename], "contenu": [archive.read(item)]})

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(run, "archive string, nom string, contenu binary")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)
