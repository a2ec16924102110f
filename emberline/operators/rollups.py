"""Counts, histograms and bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The bands of the priority score and their least scores.
BANDS = (("urgent_75_100", 75.0), ("high_50_74", 50.0), ("routine_25_49", 25.0), ("low_0_24", 0.0))


def by_provider(tables: dict[str, DataFrame], provider: str = "provider") -> DataFrame:
    """One row for each provider with the number of its rows in each table; null where it has none.

    The tables are tagged, united and counted in one aggregate.
    """
    tagged = [rows.select(F.col(provider).alias("provider"), F.lit(kind).alias("_kind")) for kind, rows in tables.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("provider").pivot("_kind", list(tables)).agg(F.count(F.lit(1)))


def ranked_providers(counted: DataFrame, kinds: list[str]) -> DataFrame:
    total = sum((F.coalesce(F.col(k), F.lit(0)) for k in kinds), F.lit(0))
    return counted.withColumn("total", total).orderBy(F.desc("total"), "provider")


def histogram(rows: DataFrame, value: Column, name: str, fallback: str = "unknown") -> DataFrame:
    """Counts by value; null and blank count as the fallback."""
    return rows.groupBy(F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(fallback)).alias(name)).agg(F.count("*").alias("n")).orderBy(name)


def band(score: Column) -> Column:
    known = F.coalesce(score, F.lit(0.0))
    out = F.when(known >= BANDS[0][1], BANDS[0][0])
    for name, least in BANDS[1:-1]:
        out = out.when(known >= least, name)
    return out.otherwise(BANDS[-1][0])


def bands(rows: DataFrame, score: Column) -> DataFrame:
    """Counts by band; bands without rows stay, with 0."""
    every = rows.sparkSession.createDataFrame([(i, n) for i, (n, _) in enumerate(BANDS)], "_order int, band string")
    counted = rows.groupBy(band(score).alias("band")).agg(F.count("*").alias("n"))
    return every.join(counted, "band", "left").select("_order", "band", F.coalesce("n", F.lit(0)).alias("n")).orderBy("_order").drop("_order")


def surveys(events: DataFrame) -> DataFrame:
    """Counts by survey of rows that aren't simulated, whose status is known and not `merged` (in this very case)."""
    kept = events.filter(F.col("simulation").isNull() | (F.col("simulation") == 0)).filter("status != 'merged' and discovery_survey is not null and trim(discovery_survey) != ''")
    return kept.groupBy(F.col("discovery_survey").alias("survey")).agg(F.count("*").alias("candidate_count")).orderBy(F.desc("candidate_count"), "survey")


def scaled(counted: DataFrame, value: str = "n", name: str = "bar") -> DataFrame:
    """Each count as a percentage of the largest (of 1 if all are 0). counted holds one row for each group."""
    return counted.withColumn(name, 100.0 * F.col(value) / F.coalesce(F.nullif(F.max(value).over(Window.partitionBy()), F.lit(0)), F.lit(1)))


def bars(counted: DataFrame, value: str = "n") -> DataFrame:
    """Scaled counts, the largest first."""
    return scaled(counted, value).orderBy(F.desc(value))
