"""A table of the latest revision of each key, kept in key buckets as base and delta files.

A batch writes its own latest rows as a delta, a file for each bucket that it touches, so what is written follows the batch and not the table. A bucket with more than
`most_deltas` deltas is compacted: its base and deltas become a new base. A manifest names each bucket's live files; a version of it is a file of its own,
and the newest complete one counts. It is written last and takes its name by one rename, so a batch is there as a whole or not at all. A batch that was committed
before isn't applied again, and files of a batch that wasn't are overwritten when it comes back: replays are exact. Readers keep the version they began with, since files go
only after `kept` further versions.

Reading takes the latest row of each key by (time, tie) over all live files, in one aggregate; equal (time, tie) of a key keeps one of the rows. Null times are
oldest. A row with a null key is a key like any other. An empty batch commits a version that changes nothing. The manifest has buckets times (most_deltas + 1) names at most,
so the driver's part is bounded.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from emberline.sources.storage import exists, file_system, removed


@dataclass
class Manifest:
    version: int = -1
    batch: int = -1
    #: bucket: its base (or none) first, then its deltas, oldest first. Names are folders below data/.
    files: dict[str, list[str | None]] = field(default_factory=dict)

    def live(self) -> set[str]:
        return {name for names in self.files.values() for name in names if name}


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, time: str, tie: str, buckets: int = 64, most_deltas: int = 4, kept: int = 2):
        self.spark, self.path, self.schema = spark, path, schema
        self.key, self.time, self.tie = key, time, tie
        self.buckets, self.most_deltas, self.kept = buckets, most_deltas, kept

    def _versions(self) -> list[int]:
        fs, folder = file_system(self.spark, f"{self.path}/log")
        if not fs.exists(folder):
            return []
        names = [entry.getPath().getName() for entry in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version."""
        versions = self._versions()
        if not versions:
            return Manifest()
        version = versions[-1] if version is None else version
        text = self.spark.read.text(f"{self.path}/log/{version:012d}.json", wholetext=True).first()["value"]
        return Manifest(**json.loads(text))

    def _commit(self, manifest: Manifest) -> None:
        fs, staged = file_system(self.spark, f"{self.path}/log/_{manifest.version:012d}.json")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        out.close()
        if not fs.rename(staged, file_system(self.spark, f"{self.path}/log/{manifest.version:012d}.json")[1]):
            raise RuntimeError(f"version {manifest.version} was committed by another run")
        old = [v for v in self._versions() if v <= manifest.version - self.kept]
        if old:
            needed = set().union(*(self.manifest(v).live() for v in self._versions() if v not in old))
            gone = set().union(*(self.manifest(v).live() for v in old)) - needed
            for name in gone:
                removed(self.spark, f"{self.path}/data/{name}")
            for v in old:
                removed(self.spark, f"{self.path}/log/{v:012d}.json")

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row for each key: the last by time (null first), then by tie."""
        row = F.struct(*(F.col(f"`{c}`") for c in self.schema.names))
        by = F.struct(F.col(self.time).isNotNull().alias("known"), F.col(self.time).alias("time"), F.col(self.tie).isNotNull().alias("tied"), F.col(self.tie).alias("tie"))
        return rows.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(row, by).alias("_row")).select("_row.*")

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets))

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", self.bucket_of(F.col(self.key)))

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{name}" for name in names))

    def rows(self, version: int | None = None) -> DataFrame:
        """The latest row of each key."""
        return self._latest(self._read(sorted(self.manifest(version).live())))

    def latest_of(self, names: list[str]) -> DataFrame:
        """The latest row of each key in these live files, which must be all of their buckets."""
        return self._latest(self._read(sorted(names)))

    def manifests(self) -> list[Manifest]:
        """All versions that are kept, oldest first."""
        return [self.manifest(v) for v in self._versions()]

    def upsert(self, batch: DataFrame, batch_id: int) -> Manifest:
        """Apply a batch once, whatever how often it is given."""
        before = self.manifest()
        if batch_id <= before.batch:
            return before
        name = f"delta-{batch_id:012d}"
        newest = self._keyed(self._latest(batch.select(*(F.col(f"`{c}`") for c in self.schema.names))))
        # one task for each touched bucket at most, so one file
        newest.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        files = {b: list(names) for b, names in before.files.items()}
        for bucket in self._buckets_of(name):
            files.setdefault(bucket, [None]).append(f"{name}/_bucket={bucket}")
        full = sorted((b for b, names in files.items() if len(names) > self.most_deltas + 1), key=int)
        if full:
            self._compact(files, full, batch_id)
        after = Manifest(before.version + 1, batch_id, files)
        self._commit(after)
        for b in full:  # compacted at once, so no version names it
            removed(self.spark, f"{self.path}/data/{name}/_bucket={b}")
        return after

    def _buckets_of(self, name: str) -> list[str]:
        fs, folder = file_system(self.spark, f"{self.path}/data/{name}")
        names = [entry.getPath().getName() for entry in fs.listStatus(folder)] if exists(self.spark, f"{self.path}/data/{name}") else []
        return [n.removeprefix("_bucket=") for n in names if n.startswith("_bucket=")]

    def _compact(self, files: dict[str, list[str | None]], full: list[str], batch_id: int) -> None:
        name = f"base-{batch_id:012d}"
        rows = self._keyed(self._latest(self._read([n for b in full for n in files[b] if n])))
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        for b in full:
            files[b] = [f"{name}/_bucket={b}"]

    def follow(self, rows: DataFrame, checkpoint: str, once: bool = True, every: str = "2 minutes") -> StreamingQuery:
        """Keep the table at the latest of a stream."""
        writer = rows.writeStream.foreachBatch(lambda batch, batch_id: self.upsert(batch, batch_id) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
