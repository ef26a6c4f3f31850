"""Tables that streams upsert into: small deltas, key buckets, compaction, and a manifest that is committed by a rename.

A table is a folder.  Every batch writes a delta, the newest row of each of its keys, in key buckets.  A manifest lists the base and the
deltas that make up the table after a batch.  It is written beside its name and renamed to it, so that a reader sees all of a
batch or nothing of it.  After a number of deltas the batch also merges base and deltas to a new base, bucket by bucket.  What
neither the newest manifest nor the one before it lists is deleted; a reader of the last but one version isn't cut off.

The number of a batch is the manifest's.  A batch that is run again after its commit changes nothing; one that was cut off before
overwrites its own leftovers.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UpsertTable:
    """Rows by key, the newest by time (of equally new ones that of the later batch)."""

    def __init__(self, spark: SparkSession, path: str, key: str, time: str, buckets: int = 16, most_deltas: int = 8):
        self.spark, self.path, self.key, self.time, self.buckets, self.most_deltas = spark, path.rstrip("/"), key, time, buckets, most_deltas
        self._jvm = spark.sparkContext._jvm
        root = self._path("")
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(root)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self._names() if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))

    def manifest(self, version: int | None = None) -> dict:
        """base (or null), deltas: the folders of a version, by default the newest; schema: of their rows."""
        if version is None:
            found = self.versions()
            if not found:
                return {"base": None, "deltas": []}
            version = found[-1]
        text = self.spark.read.text(f"{self.path}/manifest-{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _newest(self, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in (self.key, self.time, "batch")]
        return df.groupBy(self.key).agg(F.max(F.struct(self.time, "batch", *rest)).alias("__r")).select(self.key, *[F.col(f"__r.{c}").alias(c) for c in (self.time, "batch", *rest)])

    def _write(self, df: DataFrame, name: str) -> None:
        """One file for each bucket that has rows; the merge before it has shuffled by key only where it had to."""
        made = df.withColumn("bucket", self.bucket(F.col(self.key)))
        made.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _folders(self, manifest: dict) -> list[str]:
        return [f"{self.path}/{n}" for n in [manifest["base"], *manifest["deltas"]] if n]

    def _read(self, manifest: dict, schema) -> DataFrame:
        names = [f.name for f in schema]
        frames = [self.spark.read.schema(schema).option("basePath", f).parquet(f).select(*names) for f in self._folders(manifest)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def put(self, rows: DataFrame, number: int) -> None:
        """One batch: its delta, or a new base where the deltas have become many, and then the manifest."""
        found = self.versions()
        if found and found[-1] >= number:
            return
        before = self.manifest(found[-1]) if found else {"base": None, "deltas": []}
        delta = f"delta-{number}"
        new = self._newest(rows.withColumn("batch", F.lit(number).cast("long")))
        self._write(new, delta)
        now = {"base": before["base"], "deltas": [*before["deltas"], delta], "schema": new.schema.json()}
        if len(now["deltas"]) > self.most_deltas:
            base = f"base-{number}"
            self._write(self._newest(self._read(now, new.schema)), base)
            now |= {"base": base, "deltas": []}
        self._commit(now, number)
        self._sweep(found[-1] if found else None, number, before, now)

    def _commit(self, manifest: dict, number: int) -> None:
        beside, name = self._path(f".manifest-{number}.tmp"), self._path(f"manifest-{number}.json")
        out = self._fs.create(beside, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        if not self._fs.rename(beside, name):
            raise OSError(f"manifest {number} of {self.path} wasn't committed")

    def _sweep(self, last: int | None, number: int, before: dict, now: dict) -> None:
        keep = {f"manifest-{number}.json", f"manifest-{last}.json", before["base"], now["base"], *before["deltas"], *now["deltas"]}
        for name in self._names():
            if re.match(r"manifest-|base-|delta-", name) and name not in keep:
                self._fs.delete(self._path(name), True)

    def read(self, schema=None) -> DataFrame:
        """The table's rows, one for each key; ``schema`` (of the rows put in) is needed only while it is empty."""
        manifest = self.manifest()
        if not self._folders(manifest):
            return self.spark.createDataFrame([], schema)
        return self._newest(self._read(manifest, T.StructType.fromJson(json.loads(manifest["schema"])))).drop("batch")


def upsert_each_batch(stream: DataFrame, table: UpsertTable, late: str, checkpoint: str):
    """ST8, IO5.  Rows repeated as they are within the watermark are dropped; of each key the newest row stays."""
    same = stream.withColumn("__same", F.xxhash64(*stream.columns)).withWatermark(table.time, late)
    once = same.dropDuplicatesWithinWatermark([table.key, "__same"])
    return once.writeStream.foreachBatch(lambda batch, number: table.put(batch.drop("__same"), number)).option("checkpointLocation", checkpoint)
