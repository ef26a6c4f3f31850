"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one is made only where it is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


class Scratch:
    """Parquet tables that cut lineage and survive the loss of executors; removed when the driver ends, or by drop()."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.names = spark, label, set()
        self.root = f"{shared_dir(spark)}/rillstone-{label}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back under its own schema."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Remove one table that no returned frame reads any more."""
        self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)

    def drop_all_but(self, *names: str) -> None:
        """Remove what no returned frame reads but for these."""
        for name in sorted(self.names - set(names)):
            self.drop(name)
            self.names.discard(name)
