"""Pages of an ordered table without sorting what comes before them.

The rows are dealt into ranges of the order once and stored, a folder for each range, with the number of rows of each. A page finds its ranges by these
numbers, reads those alone (one or two while ranges are larger than pages), and sorts no more than them.

The order must tell all rows apart, its last columns being a unique key; nulls stand where the order says. Pages past the end are empty. Empty tables have no ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Pages:
    def __init__(self, spark: SparkSession, folder: str, schema, order: list[Column], sizes: list[tuple[int, int]]):
        self.spark, self.folder, self.schema, self.order = spark, folder, schema, order
        #: (range, number of rows), in order.
        self.sizes = sizes

    @classmethod
    def of(cls, rows: DataFrame, order: list[Column], folder: str, per_range: int = 100_000) -> Pages:
        """Deal rows into ranges of about per_range and store them."""
        total = rows.count()
        dealt = rows.repartitionByRange(max(1, -(-total // per_range)), *order).withColumn("_range", F.spark_partition_id())
        dealt.write.partitionBy("_range").parquet(f"{folder}/ranges")
        kept = rows.sparkSession.read.schema(dealt.schema).parquet(f"{folder}/ranges")
        sizes = sorted((r["_range"], r["count"]) for r in kept.groupBy("_range").count().collect())  # a row for each range
        return cls(rows.sparkSession, folder, rows.schema, order, sizes)

    def ranges_of(self, first: int, size: int) -> tuple[list[int], int]:
        """The ranges that hold rows first to first + size, and how many rows come before the first of them."""
        wanted, before, at = [], 0, 0
        for k, n in self.sizes:
            if at < first + size and at + n > first:
                before = before if wanted else at
                wanted.append(k)
            at += n
        return wanted, before

    def rows(self, first: int, size: int) -> DataFrame:
        """Rows first to first + size of the order, with their place (from 0)."""
        wanted, before = self.ranges_of(first, size)
        if not wanted:
            return self.spark.createDataFrame([], self.schema).withColumn("place", F.lit(0).cast("long"))
        read = self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/ranges/_range={k}" for k in wanted))
        top = read.orderBy(*self.order).limit(first + size - before).offset(first - before)  # of two ranges or a page
        row = F.struct(*(F.col(f"`{c}`") for c in self.schema.names)).alias("_row")
        every = top.select(F.monotonically_increasing_id().alias("_at"), row).agg(F.array_sort(F.collect_list(F.struct("_at", "_row"))).alias("_all"))  # a page
        return every.select(F.posexplode("_all").alias("_k", "_x")).select("_x._row.*", (F.col("_k") + first).cast("long").alias("place"))

    def page(self, number: int, size: int = 150) -> DataFrame:
        """A page by its number, from 0."""
        return self.rows(number * size, size)

    @property
    def total(self) -> int:
        return sum(n for _, n in self.sizes)
