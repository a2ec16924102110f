"""The quadtree and the nearest points against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import quadtree


def brute(points, queries, radius):
    out = {}
    for q, qx, qy in queries:
        d = min(((x - qx) * (x - qx) + (y - qy) * (y - qy), p) for p, x, y in points)
        if d[0] < radius * radius:
            out[q] = (d[1], d[0])
    return out


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, x double, y double").withColumn("level", F.lit("x")).withColumn("i", F.lit(1)).repartition(3)


@pytest.mark.parametrize(("crowd", "depth"), [(4, 12), (1, 3), (1000, 12)])
def test_nearest_matches_brute_force(spark, crowd, depth):
    rng = random.Random(crowd)
    points = [(k, rng.uniform(-50, 50), rng.uniform(-50, 50)) for k in range(300)]
    points += [(1000 + k, rng.gauss(3, 0.05), rng.gauss(-7, 0.05)) for k in range(300)] + [(2000 + k, 3.0, -7.0) for k in range(100)] + [(3000 + k, float(k % 5), float(k // 5)) for k in range(25)]
    queries = [(k, rng.uniform(-60, 60), rng.uniform(-60, 60)) for k in range(150)] + [(500 + k, rng.gauss(3, 0.2), rng.gauss(-7, 0.2)) for k in range(100)] + [(700, 3.0, -7.0), (701, 0.5, 0.5), (702, 9e6, 0.0)]
    got = quadtree.nearest(frame(spark, points, "point_id"), frame(spark, queries, "query_id"), 10.0, crowd=crowd, depth=depth).collect()
    assert {r["query_id"]: (r["point_id"], r["d2"]) for r in got} == brute(points, queries, 10.0)


def test_cells_hold_all_points_and_no_crowd(spark):
    rng = random.Random(2)
    points = spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(0, 0.01)) for _ in range(3000)], "x double, y double")
    cells = quadtree.tree(points, 10.0, crowd=20, depth=12)
    leaves = cells.filter("leaf")
    assert leaves.agg(F.sum("n")).first()[0] == 3000 and leaves.agg(F.max("n")).first()[0] <= 20
    assert cells.filter("not leaf and n <= 20").isEmpty() and cells.filter("level = 0").agg(F.sum("n")).first()[0] == 3000


def test_queries_hold_few_cells_however_dense(spark):
    points = spark.range(20_000).select(F.rand(1).alias("x"), F.rand(2).alias("y"), F.col("id").alias("point_id"))
    cells = quadtree.tree(points, 10.0, crowd=16).filter("leaf")
    asked = spark.createDataFrame([(1, 0.5, 0.5), (2, 3.0, 3.0)], "query_id long, _qx double, _qy double")
    kept = quadtree._kept(asked.crossJoin(cells), "query_id", 10.0, 10.0)  # two queries
    assert cells.count() > 1000 and kept.groupBy("query_id").count().agg(F.max("count")).first()[0] < 40


def test_left_out_and_empty(spark):
    points = [(1, None, 0.0), (2, float("nan"), 0.0), (3, float("inf"), 1.0), (None, 0.0, 0.0), (4, 1.0, 0.0), (5, 10.0, 0.0)]
    queries = [(1, 0.0, 0.0), (2, None, 1.0), (None, 0.0, 0.0), (3, 20.0, 0.0)]
    got = quadtree.nearest(frame(spark, points, "point_id"), frame(spark, queries, "query_id")).collect()
    assert [tuple(r) for r in got] == [(1, 4, 1.0)]  # the fifth is just ten from the third query: not within
    none = frame(spark, points, "point_id").filter("1 = 0")
    assert quadtree.nearest(none, frame(spark, queries, "query_id")).count() == 0
    assert quadtree.nearest(frame(spark, points, "point_id"), frame(spark, queries, "query_id").filter("1 = 0")).count() == 0
