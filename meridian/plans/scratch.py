"""Intermediate tables in the folder that every executor shares.

Iterative programs cut their lineage by writing a table and reading it back. The
folder is the cluster's `spark.checkpoint.dir`; only a local session without one (tests)
gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; made up only for a local one, whose tasks all see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meridian-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Writes intermediate tables; `free` removes those that nothing reads any more, the end of the session the rest."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/meridian-{uuid.uuid4().hex}"
        self.n = 0
        self._path().getFileSystem(self._hadoop()).deleteOnExit(self._path())

    def _path(self, under: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root + under)

    def _hadoop(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.option("compression", "zstd").parquet(f"{self.root}/{self.n}")
        out = self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")
        out._scratch = f"/{self.n}"
        return out

    def free(self, *tables: DataFrame) -> None:
        for t in tables:
            self._path().getFileSystem(self._hadoop()).delete(self._path(t._scratch), True)
