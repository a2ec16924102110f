"""Counts by group that are maintained by signed changes instead of recounted.

The rows that count are the latest revisions of a bucket table. A batch takes back what the rows that it replaces counted and adds what their
successors count: both are read from the buckets that the batch touches, for its keys alone. A revision that no longer counts (withdrawn, merged, without rights) only takes
back. The changes are summed by group and merged with the stored counts, which are a row for each group.

Counts after a batch lie in a folder named by it, made from those after the batch before and from two versions of the table, so a batch that comes back makes the
same counts again, whether the table, the counts or neither had taken it in. Groups whose count becomes 0 go. Null is a group like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.sources.storage import exists, file_system, removed
from emberline.streaming.buckets import BucketTable, Manifest


class MaintainedCounts:
    def __init__(self, table: BucketTable, path: str, by: dict[str, Column], counted: Column):
        self.table, self.path, self.by, self.counted = table, path, by, counted
        self.spark = table.spark
        kinds = table.spark.createDataFrame([], table.schema).select(*(c.alias(n) for n, c in by.items()), F.lit(0).cast("long").alias("n"))
        self._schema = kinds.schema

    def _known(self) -> list[int]:
        if not exists(self.spark, self.path):
            return []
        fs, folder = file_system(self.spark, self.path)
        names = [entry.getPath().getName() for entry in fs.listStatus(folder)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def counts(self, before: int | None = None) -> DataFrame:
        """The counts after the last batch, or after the last one before a given one."""
        known = [b for b in self._known() if before is None or b < before]
        if not known:
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).parquet(f"{self.path}/batch={known[-1]}")

    def _signed(self, manifest: Manifest, keys: DataFrame, buckets: list[int], sign: int) -> DataFrame:
        names = [n for b in buckets for n in manifest.files.get(str(b), []) if n]
        rows = self.table.latest_of(names).join(keys, F.col(self.table.key).eqNullSafe(F.col("_changed")), "left_semi")
        return rows.filter(self.counted).select(*(c.alias(n) for n, c in self.by.items()), F.lit(sign).cast("long").alias("n"))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Take in a batch, in the table and in the counts, once."""
        known = self._known()
        if known and batch_id <= known[-1]:
            self.table.upsert(batch, batch_id)
            return
        keys = batch.select(F.col(self.table.key).alias("_changed")).distinct().persist()
        try:
            touched = [r["b"] for r in keys.select(self.table.bucket_of(F.col("_changed")).alias("b")).distinct().collect()]  # a number for each bucket at most
            self.table.upsert(batch, batch_id)
            versions = {m.batch: m for m in self.table.manifests()}
            earlier = [b for b in versions if b < batch_id]
            old = versions[max(earlier)] if earlier else Manifest()
            changes = self._signed(old, keys, touched, -1).unionByName(self._signed(versions[batch_id], keys, touched, 1))
            merged = self.counts(batch_id).unionByName(changes).groupBy(*self.by).agg(F.sum("n").alias("n")).filter("n <> 0")
            merged.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        finally:
            keys.unpersist()
        for b in known[:-1]:
            removed(self.spark, f"{self.path}/batch={b}")

    def follow(self, rows: DataFrame, checkpoint: str, once: bool = True, every: str = "2 minutes") -> StreamingQuery:
        """Keep table and counts at the state of a stream of revisions."""
        writer = rows.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
