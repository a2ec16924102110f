"""The sky map: rows of a time window, their places, and the nearest one to a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.scalars import mollweide
from emberline.operators import quadtree


def window(rows: DataFrame, time: Column, as_of: Column, days: int) -> DataFrame:
    """Rows of the last `days` days with a place on the sky."""
    recent = (time >= as_of - F.expr(f"interval {days} days")) & (time <= as_of)
    return rows.filter(recent & (F.col("ra_deg") >= 0) & (F.col("ra_deg") < 360) & F.col("dec_deg").between(-90, 90))


def placed(rows: DataFrame, width: float, height: float) -> DataFrame:
    return rows.withColumn("_at", mollweide(F.col("ra_deg"), F.col("dec_deg"), width, height)).withColumn("x", F.col("_at.x")).withColumn("y", F.col("_at.y")).drop("_at")


def graticule(spark: SparkSession, width: float, height: float) -> DataFrame:
    """Sample points of five parallels (each 4 degrees) and twelve meridians (each 3 degrees)."""
    parallels = spark.sql("select concat('dec ', d) line, cast(ra as double) ra_deg, cast(d as double) dec_deg from (select explode(array(-60, -30, 0, 30, 60)) d) lateral view explode(sequence(0, 360, 4)) r as ra")
    meridians = spark.sql("select concat('ra ', m) line, cast(m as double) ra_deg, cast(d as double) dec_deg from (select explode(sequence(0, 330, 30)) m) lateral view explode(sequence(-89, 89, 3)) s as d")
    return placed(parallels.union(meridians), width, height)


def nearest(points: DataFrame, queries: DataFrame, radius: float = 10.0, query: str = "query_id", point: str = "point_id", crowd: int = 64) -> DataFrame:
    """For each query the nearest point strictly within radius; of equally near ones the least id. (x, y in both.)"""
    return quadtree.nearest(points, queries, radius, query, point, crowd)
