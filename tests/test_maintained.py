"""Maintained counts against a recount after every batch, and after failures and replays."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from emberline.streaming.rollups import MaintainedCounts

from .test_buckets import batch, table


def made(spark, path, **options):
    held = table(spark, path / "table", **options)
    return MaintainedCounts(held, str(path / "counts"), {"title": F.col("title"), "odd": F.col("at") % 2}, ~F.coalesce(F.col("title") == "withdrawn", F.lit(False)))


def recount(held):
    return collections.Counter((title, at % 2) for at, _, title in held.values() if title != "withdrawn")


def found(counts):
    return {(r["title"], r["odd"]): r["n"] for r in counts.counts().collect()}


def test_counts_equal_a_recount(spark, tmp_path):
    rng, counts, held = random.Random(6), made(spark, tmp_path, buckets=4, most_deltas=2), {}
    for k in range(6):
        rows = [(rng.choice([None, *"abcdefghijkl"]), rng.randint(1, 9), 100 * k + i, rng.choice(["x", "y", None, "withdrawn"])) for i in range(15 if k != 3 else 0)]
        counts.apply(batch(spark, *rows), k)
        for r in rows:
            if r[0] not in held or (r[1], r[2]) > held[r[0]][:2]:
                held[r[0]] = r[1:]
        assert found(counts) == recount(held)


@pytest.mark.parametrize("fails", ["table", "counts"])
def test_replays_are_exact(spark, tmp_path, fails):
    counts = made(spark, tmp_path)
    counts.apply(batch(spark, ("a", 1, 1, "x"), ("b", 1, 1, "x"), ("c", 1, 1, "y")), 0)
    change = batch(spark, ("a", 2, 1, "y"), ("b", 3, 1, "withdrawn"), ("c", 0, 9, "late"), ("d", 1, 1, None))
    lost = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    part = counts.table if fails == "table" else counts
    name = "_commit" if fails == "table" else "_signed"
    kept = getattr(part, name)
    setattr(part, name, lost)
    with pytest.raises(RuntimeError):
        counts.apply(change, 1)
    setattr(part, name, kept)
    assert found(counts) == {("x", 1): 2, ("y", 1): 1}
    for _ in range(2):
        counts.apply(change, 1)
        assert found(counts) == {("y", 0): 1, ("y", 1): 1, (None, 1): 1}
