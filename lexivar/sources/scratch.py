"""Intermediate tables, written to the folder that all machines of a cluster share: they cut lineage and plans, and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="lexivar-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a session on one machine may leave it unset: then a folder is made there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local_dir(spark.sparkContext.applicationId)
    return base.rstrip("/")


def clear(spark: SparkSession, path: str) -> None:
    """Removes a folder, wherever it is stored."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written tables of one operator call: they cut lineage, so a lost executor costs no earlier stage.

    They are removed by drop(), and what is left when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{label}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for x in labels:
            self._fs.delete(self._path(f"{self.root}/{x}"), True)
