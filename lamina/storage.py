"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes a table's shuffle files when the driver's JVM collects its garbage, which may be much later; after writes of so many seconds it is asked to.
LONG_S = 2
_FALLBACK: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.

    Where the setting is missing, a local master gets a temporary folder; a cluster gets an
    error, as its machines don't see each other's local disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _FALLBACK:
            _FALLBACK.append(tempfile.TemporaryDirectory(prefix="lamina-"))
        root = f"file://{_FALLBACK[0].name}"
    return f"{root.rstrip('/')}/lamina-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder; lineage ends there, so a lost executor costs no more than its running tasks."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


class Scratch:
    """An operator's intermediate tables. keep() writes its result and deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_folder(spark), 0
        self.tables: list[tuple[DataFrame, str]] = []

    def folder(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def written(self, df: DataFrame) -> DataFrame:
        path, began = self.folder(), time.monotonic()
        df.write.option("compression", "zstd").parquet(path)
        if time.monotonic() - began > LONG_S:
            self.spark.sparkContext._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        for table, path in self.tables:
            if table is df:
                delete(self.spark, path)

    def keep(self, df: DataFrame) -> DataFrame:
        out = written(df)
        delete(self.spark, self.root)
        return out
