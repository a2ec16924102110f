"""Changes by digests against a comparison of everything, and how little is read."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import digest
from emberline.operators.validate import Rejected


def version(spark, rows, path, **options):
    frame = spark.createDataFrame(rows, "k long, v string, generated_at string").repartition(3)
    return digest.stored_version(frame, "k", str(path), **{"parts": 64, "fan": 4, **options})


def test_changes_are_found_in_few_parts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, f"v{rng.randint(0, 9)}", "then") for k in range(3000)] + [(None, "null", "then"), (5, "twice", "then")]
    new = [(k, v, "now") for k, v, _ in rows if k not in (10, 11)]
    new = [(k, "other" if k in (20, None) else v, g) for k, v, g in new] + [(9000, "new", "now"), (5, "thrice", "now")]
    a, b, same = version(spark, rows, tmp_path / "a"), version(spark, new, tmp_path / "b"), version(spark, rows[::-1], tmp_path / "c")
    parts, compared = digest.differing(a, b)
    assert 1 <= len(parts) <= 6 and compared < 64
    found = {r["k"]: r["change"] for r in digest.changes(a, b).collect()}
    assert found == {10: "removed", 11: "removed", 20: "changed", None: "changed", 9000: "added", 5: "changed"}
    assert digest.differing(a, same) == ([], 1) and digest.changes(a, same).count() == 0
    read = b.rows(parts).inputFiles()
    assert len(read) >= 1 and b.rows(parts).count() < 600


def test_shapes_are_guarded(spark, tmp_path):
    a = version(spark, [(1, "x", "t")], tmp_path / "a")
    for name, options in (("p", {"parts": 32}), ("f", {"fan": 8})):
        with pytest.raises(Rejected, match="shape"):
            digest.differing(a, version(spark, [(1, "x", "t")], tmp_path / name, **options))
    other = digest.stored_version(spark.createDataFrame([(1, 2)], "k long, v long"), "k", str(tmp_path / "o"), parts=64, fan=4)
    with pytest.raises(Rejected):
        digest.changes(a, other)


def test_empty_versions(spark, tmp_path):
    none = digest.stored_version(spark.createDataFrame([(1, "x", "t")], "k long, v string, generated_at string").filter(F.lit(False)), "k", str(tmp_path / "n"), parts=64, fan=4)
    some = version(spark, [(1, "x", "t")], tmp_path / "s")
    assert digest.differing(none, none) == ([], 1)
    assert [(r["k"], r["change"]) for r in digest.changes(none, some).collect()] == [(1, "added")]
