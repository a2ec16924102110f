"""Continuous ingest: revisions arrive as JSON files and are kept as the latest one for each key.

An extension: watermarks and keyed state bound what is remembered, and a checkpoint makes restarts exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from emberline.operators.selection import latest_revision


def arriving(spark: SparkSession, folder: str, schema: StructType, time: str = "retrieved_at", keys: tuple[str, ...] = ("event_id", "retrieved_at"), late: str = "3 days", most_files: int = 100) -> DataFrame:
    """Revisions from new files, each (by keys) once within the watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).json(folder)
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def merged(old: DataFrame | None, new: DataFrame, key: str = "event_id", time: str = "retrieved_at", tie: str = "revision") -> DataFrame:
    rows = new if old is None else old.unionByName(new)
    return latest_revision(rows, key, time, tie)


def keep_latest(rows: DataFrame, table: str, checkpoint: str, key: str = "event_id", time: str = "retrieved_at", tie: str = "revision", once: bool = True, every: str = "2 minutes") -> StreamingQuery:
    """Upsert into versioned folders table/v=<batch>; a repeated batch rewrites its own version alone, so replays are exact.

    A batch needs the version before it, and readers may still hold that one; older versions are removed.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{table}/v={batch_id - 1}") if batch_id else None
        merged(old, batch, key, time, tie).write.mode("overwrite").parquet(f"{table}/v={batch_id}")
        if batch_id > 1:
            old_path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v={batch_id - 2}")
            old_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old_path, True)

    writer = rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def counts_by_window(rows: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "3 days") -> DataFrame:
    return rows.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
