"""Registered queries over streams: tables of the driver cut into files that arrive one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.plans.registry import Tables, query
from emberline.sources.storage import shared_folder
from emberline.streaming.buckets import BucketTable
from emberline.streaming.rollups import MaintainedCounts


def _arriving(t: Tables, rows: DataFrame, folder: str, files: int = 6, each: int = 1) -> DataFrame:
    """rows as a stream of `files` files, `each` to a batch; a key's rows are spread over all of them."""
    rows.repartition(files).write.parquet(f"{folder}/arriving")
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{folder}/arriving")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def stream_upsert(t):
    """The latest event of each user, kept in buckets from six batches with compactions between."""
    folder = shared_folder(t.spark)
    rows = t("events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_type", "value")
    table = BucketTable(t.spark, f"{folder}/table", rows.schema, "user_id", "at", "event_id", buckets=8, most_deltas=2)
    table.follow(_arriving(t, rows, folder), f"{folder}/mark").awaitTermination()
    return table.rows().select("user_id", "event_id", "event_type", "value")


@query("""select event_type, band, count(*) as n from (select event_type, cast(floor(value / 25) as bigint) as band, event_id, row_number() over (partition by user_id, event_id % 7 order by ts desc, event_id desc) as k from events)
where k = 1 and event_id % 5 <> 0 group by 1, 2""")
def maintained_counts(t):
    """Counts of the latest events that count, by type and band, maintained over six batches of inserts, updates and withdrawals."""
    folder = shared_folder(t.spark)
    rows = t("events").select(
        "event_id", F.concat_ws("/", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("key"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_type", "value"
    )
    table = BucketTable(t.spark, f"{folder}/table", rows.schema, "key", "at", "event_id", buckets=8, most_deltas=2)
    by = {"event_type": F.col("event_type"), "band": F.floor(F.col("value") / 25)}
    counts = MaintainedCounts(table, f"{folder}/counts", by, F.col("event_id") % 5 != 0)
    counts.follow(_arriving(t, rows, folder), f"{folder}/mark").awaitTermination()
    return counts.counts()
