"""Centroid clustering in whole numbers by sort-means.

A vector component x becomes floor(scale x), so distances and means are exact and no result depends on the order of additions.
In each round every centroid's others are ordered by their distance from it. A vector starts at its centroid of the round
before and scans the others in that order; it stops at the first that lies strictly beyond twice its distance to its
start: no centroid from there on can be as near (a distance equal to twice could still tie, and ties go to the smaller number).
Vectors of one start scan together in numpy, those that stop leave.

On Spark: a round is one pass over the stored vectors. Its tasks write each vector with its new cluster, and one row for each
cluster with the sum and number of their vectors; the driver adds up to k means from these rows' aggregate (k times `dims` numbers) and gives
k centroids back to the tasks. Nothing is shuffled but those sums, so a cluster with most of the vectors is no one's burden. The table of a round replaces the
one before, which is then removed, so two are there at once at most.

Cases: vectors that are null, have another number of components or hold a null or non-finite one are left out, and an id may be
null. Repeated rows are vectors of their own (equal ids are told apart by their components when centroids are chosen). Fewer vectors than k give
as many centroids as vectors. An empty table gives no rows. Components beyond 2^27 after scaling raise an error, since their squared
distances may not fit in 64 bits. Only vec_id and embedding are read, so other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import dropped, shared_folder, stored

#: Largest component: 64 squares of differences of two such then fit in 64 bits.
_MOST = 1 << 27


def kept(vectors: DataFrame, dims: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, v (array<int>) of the vectors that can be clustered."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = (F.size("embedding") == dims) & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False)))
    inside = lambda e: F.when(F.abs(e * scale) <= _MOST, F.floor(e * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {_MOST} / {scale}")))
    return vectors.select("vec_id", "embedding").filter(whole).select("vec_id", F.transform(x, inside).alias("v"))


@dataclass(frozen=True)
class Scan:
    """The centroids of a round, and for each of them the order in which the others are scanned."""

    centroids: np.ndarray
    order: np.ndarray
    reach: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Scan:
        apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
        k = len(centroids)
        order = np.array([[j for j in np.argsort(apart[a], kind="stable") if j != a] for a in range(k)], int).reshape(k, max(0, k - 1))
        # D lies strictly beyond twice d, in squares D2 > 4 d2, just if d2 <= (D2 - 1) // 4
        return cls(centroids, order, (np.take_along_axis(apart, order, 1) - 1) // 4)

    def assigned(self, v: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest centroid, squared distance) of each vector; equally near: the smaller number."""
        best, near = start.copy(), np.zeros(len(v), np.int64)
        for a in np.unique(start):
            rows = np.flatnonzero(start == a)
            x = v[rows]
            own = ((x - self.centroids[a]) ** 2).sum(1)
            near[rows] = own
            for j, reach in zip(self.order[a], self.reach[a], strict=True):
                going = own > reach
                if not going.all():
                    rows, x, own = rows[going], x[going], own[going]
                if not len(rows):
                    break
                d = ((x - self.centroids[j]) ** 2).sum(1)
                better = (d < near[rows]) | ((d == near[rows]) & (j < best[rows]))
                near[rows[better]], best[rows[better]] = d[better], j
        return best, near


def _pass(table: DataFrame, scan: Scan, dims: int) -> DataFrame:
    """table (vec_id, v, cluster) with new clusters and distances, and rows of sums: n, sums (of the vectors, and last of their distances)."""
    k = len(scan.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dims + 1), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            held = batch.column(1)
            v = held.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dims).astype(np.int64)
            best, near = scan.assigned(v, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
            for a in np.unique(best):
                of = best == a
                sums[a, :dims] += v[of].sum(0)
                sums[a, dims] += near[of].sum()
                n[a] += of.sum()
            none = pa.nulls(len(batch), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), held, pa.array(best, pa.int32()), pa.array(near), none, pa.nulls(len(batch), pa.list_(pa.int64()))], names)
        full = np.flatnonzero(n)
        m = len(full)
        rows = [pa.nulls(m, ids), pa.nulls(m, pa.list_(pa.int32())), pa.array(full, pa.int32()), pa.nulls(m, pa.int64()), pa.array(n[full]), pa.array(list(sums[full]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(rows, names)

    from pyspark.sql.pandas.types import to_arrow_type

    names, ids = ["vec_id", "v", "cluster", "distance", "n", "sums"], to_arrow_type(table.schema["vec_id"].dataType)
    return table.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id {dict(table.dtypes)['vec_id']}, v array<int>, cluster int, distance long, n long, sums array<long>")


def _totals(done: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each cluster with vectors: (how many, sums), from the rows of sums that the tasks wrote."""
    parts = done.filter("n is not null").select("cluster", "n", F.posexplode("sums").alias("i", "x"))
    added = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # k (dims + 1) rows
    out: dict[int, tuple[int, list[int]]] = {}
    for row in sorted(added, key=lambda r: (r["cluster"], r["i"])):
        out.setdefault(row["cluster"], (int(row["n"]), []))[1].append(int(row["x"]))
    return out


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of all kept vectors, and (cluster, centroid, n, cluster_inertia) of all clusters."""
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    table = stored(kept(vectors, dims, scale).withColumn("cluster", F.lit(0)), folder, "round-0")
    chosen = table.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in chosen], np.int64).reshape(len(chosen), dims)
    for turn in range(1, rounds + 1 if len(chosen) else 1):
        done = stored(_pass(table, Scan.of(centroids), dims), folder, f"round-{turn}")
        for a, (n, sums) in _totals(done).items():
            centroids[a] = [x // n for x in sums[:dims]]
        dropped(spark, f"{folder}/round-{turn - 1}")
        table = done.filter("n is null")
    if not len(chosen):
        return table.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance")), spark.createDataFrame([], "cluster int, centroid array<long>, n long, cluster_inertia long")
    last = stored(_pass(table, Scan.of(centroids), dims).drop("v"), folder, "last")
    totals = _totals(last)
    made = [(a, c.tolist(), *((totals[a][0], totals[a][1][dims]) if a in totals else (0, 0))) for a, c in enumerate(centroids)]
    return last.filter("n is null").select("vec_id", "cluster", "distance"), spark.createDataFrame(made, "cluster int, centroid array<long>, n long, cluster_inertia long")


def report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of all kept vectors. The k clusters are broadcast."""
    assigned, clusters = clustered(vectors, **options)
    rows = [(r["cluster"], r["cluster_inertia"], hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest()) for r in clusters.collect()]
    total = sum(r[1] for r in rows)
    shown = vectors.sparkSession.createDataFrame([(a, i, total, h) for a, i, h in rows], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(shown), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
