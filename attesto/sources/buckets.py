"""Tables that are kept in buckets of a key, so that a change of a few files rewrites their buckets only."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesto.sources.scratch import CLEANUP, written


#: Files of a bucket at most: a key that holds many rows is written by as many tasks.
FILES = 4


class Buckets:
    """A Parquet folder with a subfolder for each bucket of ``key``; there is one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, key: str = "dossier_id", buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _filled(self) -> bool:
        path, files = self._path("rows")
        return files.exists(path) and any(x.getPath().getName().startswith("seau=") for x in files.listStatus(path))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def read(self, keys: DataFrame | None = None) -> DataFrame | None:
        """The table, or what the buckets of ``keys`` hold of it; None if it has no rows. Other buckets are not read."""
        if not self._filled():
            return None
        rows = self.spark.read.parquet(f"{self.path}/rows")
        return (rows if keys is None else rows.filter(F.col("seau").isin(*self._of(keys)))).drop("seau")

    def _of(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys; never more than there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    @contextmanager
    def writer(self):
        """Only one writer at a time: a second one is refused. After a crash, ``unlock`` lets the next one in."""
        path, files = self._path("_writing")
        if not files.createNewFile(path):
            raise RuntimeError(f"{self.path} is being written")
        try:
            yield self
        finally:
            files.delete(path, False)

    def unlock(self) -> None:
        path, files = self._path("_writing")
        files.delete(path, False)

    def replace(self, rows: DataFrame, keys: DataFrame) -> None:
        """``rows`` in place of all rows of ``keys``; only buckets of these are rewritten.

        The buckets' new content is written beside the table first, so a failure before the end leaves the old rows, and a repeated
        call with the same rows changes nothing.
        """
        keys = written(keys.select(self.key).distinct(), "keys")
        with self.writer():
            old = self.read(keys)
            new = rows if old is None else old.join(keys, self.key, "left_anti").unionByName(rows, allowMissingColumns=True)
            new = written(new, "buckets").withColumn("seau", self.bucket())
            new.repartition("seau", F.pmod(F.xxhash64(*new.columns), F.lit(FILES))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seau").parquet(f"{self.path}/rows")
            kept = set(new.select("seau").distinct().toPandas()["seau"])
            for gone in set(self._of(keys)) - kept:  # buckets that have become empty
                path, files = self._path(f"rows/seau={gone}")
                files.delete(path, True)

    def _numbers(self, folder: str) -> list[int]:
        """Numbers at the ends of a folder's names."""
        path, files = self._path(folder)
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n.rpartition("=")[2]) for n in names if n.rpartition("=")[2].isdigit())

    def lots(self) -> list[int]:
        """Numbers of the whole lots that ``append`` has added."""
        return self._numbers("lots/_done")

    def append(self, rows: DataFrame, beside: dict[str, DataFrame]) -> None:
        """A lot of rows, in buckets of the key, with small tables of its own ``beside`` them; what is there is not rewritten.

        A lot counts when its mark is set, after all is written, so a failure before the end adds nothing. Rows of lots and those of
        ``replace`` are apart: a table is kept by one of both.
        """
        with self.writer():
            lot = max(self._numbers("lots/rows") + self.lots(), default=0) + 1
            before = self.spark.conf.get(CLEANUP, None)
            self.spark.conf.set(CLEANUP, "true")  # a lot's shuffle files go when it is written
            try:
                dealt = rows.withColumn("seau", self.bucket()).repartition("seau", F.pmod(F.xxhash64(*rows.columns), F.lit(FILES)))
                dealt.write.option("compression", "zstd").partitionBy("seau").parquet(f"{self.path}/lots/rows/lot={lot}")
            finally:
                self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
            for name, df in beside.items():
                df.write.parquet(f"{self.path}/lots/{name}/lot={lot}")
            mark, files = self._path(f"lots/_done/{lot}")
            files.mkdirs(mark.getParent())
            files.createNewFile(mark)

    def read_lots(self, name: str, keys: DataFrame | None = None) -> DataFrame | None:
        """One table of all lots with their numbers as ``lot``; of the rows, what the buckets of ``keys`` hold. None if there is nothing."""
        lots = self.lots()
        if name == "rows":  # a lot may be without any
            path, files = self._path("lots/rows")
            lots = [n for n in lots if any(x.getPath().getName().startswith("seau=") for x in files.listStatus(self._path(f"lots/rows/lot={n}")[0]))]
        if not lots:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/lots/{name}").parquet(*[f"{self.path}/lots/{name}/lot={n}" for n in lots])
        return rows if keys is None else rows.filter(F.col("seau").isin(*self._of(keys))).drop("seau")
