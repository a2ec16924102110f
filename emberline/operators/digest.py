"""What changed between two versions of a table, reading only the parts that differ.

A version is stored in `parts` folders by hash of its key, with a digest of each part: the number of rows and sums of four parts of their hashes, whatever their
order. Digests of neighbouring parts add up to those above them, in a tree with `fan` children to a node. A comparison starts at the root and descends only
into nodes whose digests differ; at the leaves it reads those parts of both versions and compares rows by key. Equal versions are told by two roots.

Two versions can be compared only if their trees have one shape (parts, fan, key and columns); others are refused.

Cases: a null key is a key like any other. Keys that repeat are compared by the number and content of all their rows. Columns that are volatile don't count. Empty
versions have digests of nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.validate import Rejected, drift, hash_sums

Node = tuple[int, ...]


@dataclass(frozen=True)
class Version:
    """A stored version: where it is, its shape, and the digests of all levels, leaves first."""

    spark: SparkSession
    path: str
    key: str
    columns: tuple[tuple[str, str], ...]
    fan: int
    levels: tuple[tuple[Node, ...], ...]

    @property
    def shape(self) -> tuple:
        return self.key, self.columns, self.fan, len(self.levels[0])

    def rows(self, parts: list[int]) -> DataFrame:
        """(key, _hash) of these parts: one row for each key, with a hash of all its rows."""
        schema = ", ".join(f"`{c}` {k}" for c, k in self.columns) + ", _part int"
        read = self.spark.read.schema(schema).parquet(f"{self.path}/parts").filter(F.col("_part").isin(parts)).drop("_part")
        each = F.sha2(F.to_json(F.struct(*(c for c, _ in self.columns))).cast("binary"), 256)
        return read.groupBy(self.key).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(each))).cast("binary"), 256).alias("_hash"))


def stored_version(rows: DataFrame, key: str, path: str, volatile: tuple[str, ...] = ("generated_at",), parts: int = 256, fan: int = 16) -> Version:
    """Store rows as a version, each part in a folder, and digest them as they lie there."""
    kept = rows.select(*(c for c in rows.columns if c not in volatile))
    kept.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartition("_part").write.partitionBy("_part").parquet(f"{path}/parts")
    columns = tuple(kept.dtypes)
    read = rows.sparkSession.read.schema(", ".join(f"`{c}` {k}" for c, k in columns) + ", _part int").parquet(f"{path}/parts")
    sums = read.groupBy("_part").agg(*hash_sums(read, ("_part",))).collect()  # a row for each part
    found = {r["_part"]: tuple(int(r[c]) for c in ("n", "w0", "w1", "w2", "w3")) for r in sums}
    levels = [tuple(found.get(p, (0,) * 5) for p in range(parts))]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append(tuple(tuple(map(sum, zip(*below[k : k + fan], strict=True))) for k in range(0, len(below), fan)))
    return Version(rows.sparkSession, path, key, columns, fan, tuple(levels))


def differing(before: Version, after: Version) -> tuple[list[int], int]:
    """The parts that differ, and how many nodes were compared."""
    if before.shape != after.shape:
        raise Rejected(f"versions of different shape: {json.dumps(before.shape)} and {json.dumps(after.shape)}")
    compared, nodes = 0, [0]
    for a, b in zip(reversed(before.levels), reversed(after.levels), strict=True):
        nodes = [k for k in nodes if k < len(a)]
        compared += len(nodes)
        nodes = [k for k in nodes if a[k] != b[k]]
        if a is before.levels[0]:
            return nodes, compared
        nodes = [child for k in nodes for child in range(k * before.fan, (k + 1) * before.fan)]
    return nodes, compared


def changes(before: Version, after: Version) -> DataFrame:
    """(key, change): added, removed and changed keys, from the parts that differ."""
    parts, _ = differing(before, after)
    return drift(before.rows(parts), after.rows(parts), before.key, "_hash")
