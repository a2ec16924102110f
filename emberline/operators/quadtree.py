"""A quadtree over points in the plane, its cells cut from counts, and the nearest point to each query.

A cell of level l is a square of width `width` / 2^l. The roots are the occupied squares of level 0; a cell with more points than `crowd` is cut into its
occupied quarters, until none is too full or the deepest level is reached. All levels' counts come from one scan and one aggregate, and the tree is stored.

Queries go down the tree together, a level a step. A query starts with the roots that its circle meets. Any cell holds a point, so the least of the cells' farthest
corners bounds its nearest distance; cells that begin beyond the bound are dropped, the others give way to their quarters. On each level only cells about as large as the bound
are left, so a query holds a few of them however dense the points are. Each step joins them with the stored tree, is stored itself, and never
reads points. At the end the leaves that are left meet their points in one equal join.

Cases: points or queries with a null or non-finite coordinate, or a null id, take no part. Points in one place are one, with their least id. Of equal distances the
least id wins. No points or no queries: no rows. The radius is strict. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.sources.storage import shared_folder, stored

#: Cells are compared with this much to spare, since coordinates are divided by widths and rounded.
_SPARE = 1e-9


def _cell(level: Column, width: float) -> tuple[Column, Column]:
    """The cell of (x, y) at a level."""
    size = F.lit(width) / F.pow(F.lit(2.0), level)
    return F.floor(F.col("x") / size).cast("long").alias("i"), F.floor(F.col("y") / size).cast("long").alias("j")


def _usable(rows: DataFrame, name: str) -> DataFrame:
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return rows.select(name, x.alias("x"), y.alias("y")).filter(F.coalesce(finite(x) & finite(y), F.lit(False)) & F.col(name).isNotNull())


def tree(points: DataFrame, width: float, crowd: int = 64, depth: int = 12) -> DataFrame:
    """level, i, j, n, leaf: all cells of the tree over points (x, y)."""
    levels = points.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    counted = levels.select("level", *_cell(F.col("level"), width)).groupBy("level", "i", "j").agg(F.count("*").alias("n"))
    leaf = (F.col("n") <= crowd) | (F.col("level") == depth)
    # a cell too full is cut, so its quarters are in the tree with it: each cell tells them, and the roots are in anyway
    over = counted.filter((F.col("n") > crowd) & (F.col("level") < depth)).select((F.col("level") + 1).alias("level"), F.col("i").alias("_i"), F.col("j").alias("_j"))
    keyed = counted.withColumn("_i", F.shiftright("i", 1)).withColumn("_j", F.shiftright("j", 1))
    quarters = keyed.join(over, ["level", "_i", "_j"], "left_semi").select("level", "i", "j", "n")
    return counted.filter("level = 0").unionByName(quarters).withColumn("leaf", leaf)


def _reach(width: float) -> tuple[Column, Column]:
    """Squared distances from (_qx, _qy) to the nearest and the farthest place of the cell (level, i, j)."""
    size = F.lit(width) / F.pow(F.lit(2.0), F.col("level"))
    sums = [F.lit(0.0), F.lit(0.0)]
    for q, k in (("_qx", "i"), ("_qy", "j")):
        below, above = F.col(k) * size - F.col(q), F.col(q) - (F.col(k) + 1) * size
        near, far = F.greatest(below, above, F.lit(0.0)), F.greatest(F.abs(below), F.abs(above))
        sums = [sums[0] + near * near, sums[1] + far * far]
    return sums[0] * (1 - _SPARE), sums[1] * (1 + _SPARE)


def _kept(cells: DataFrame, query: str, radius: float, width: float) -> DataFrame:
    """The cells of each query that may hold its nearest point."""
    near, far = _reach(width)
    bound = F.min("_far").over(Window.partitionBy(query))  # a query's cells are few
    return cells.withColumn("_near", near).withColumn("_far", far).withColumn("_bound", bound).filter((F.col("_near") <= F.col("_bound")) & (F.col("_near") < radius * radius)).drop("_near", "_far", "_bound")


def nearest(points: DataFrame, queries: DataFrame, radius: float = 10.0, query: str = "query_id", point: str = "point_id", crowd: int = 64, depth: int = 12) -> DataFrame:
    """For each query with any point strictly within radius: the nearest one and d2, the squared distance. (x, y in both; query unique.)

    The points are scanned twice: for the tree, and at the end for the leaves that are left.
    """
    folder = shared_folder(points.sparkSession)
    points, queries = _usable(points, point).groupBy("x", "y").agg(F.min(point).alias(point)), _usable(queries, query)
    cells = stored(tree(points, radius, crowd, depth), f"{folder}/tree")
    asked = queries.select(query, F.col("x").alias("_qx"), F.col("y").alias("_qy"), *_cell(F.lit(0), radius))
    three = F.array(*map(F.lit, (-1, 0, 1)))
    around = asked.withColumn("_di", F.explode(three)).withColumn("_dj", F.explode(three))
    around = around.select(query, "_qx", "_qy", (F.col("i") + F.col("_di")).alias("i"), (F.col("j") + F.col("_dj")).alias("j"))
    front = around.join(cells.filter("level = 0"), ["i", "j"]).select(query, "_qx", "_qy", "level", "i", "j", "leaf")
    front = stored(_kept(front, query, radius, radius), f"{folder}/front-0")
    for level in range(depth):
        if front.filter("not leaf").isEmpty():
            break
        parents = front.filter("not leaf").select(query, "_qx", "_qy", F.col("i").alias("_i"), F.col("j").alias("_j"))
        below = cells.filter(F.col("level") == level + 1).withColumn("_i", F.shiftright("i", 1)).withColumn("_j", F.shiftright("j", 1))
        quarters = parents.join(below, ["_i", "_j"]).select(query, "_qx", "_qy", "level", "i", "j", "leaf")
        front = stored(_kept(front.filter("leaf").unionByName(quarters), query, radius, radius), f"{folder}/front-{level + 1}")
    levels = [r["level"] for r in cells.filter("leaf").select("level").distinct().collect()]  # depth + 1 numbers at most
    own = points.select(point, "x", "y", F.explode(F.array(*map(F.lit, sorted(levels) or [0]))).alias("level"))
    held = own.select(point, "x", "y", "level", *_cell(F.col("level"), radius))
    dx, dy = F.col("x") - F.col("_qx"), F.col("y") - F.col("_qy")
    found = front.join(held, ["level", "i", "j"]).withColumn("d2", dx * dx + dy * dy).filter(F.col("d2") < radius * radius)
    return found.groupBy(query).agg(F.min(F.struct("d2", point)).alias("best")).select(query, F.col(f"best.{point}"), F.col("best.d2"))
