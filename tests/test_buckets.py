"""Bucket tables: latest rows, bytes that follow the batch, replays, failures, compaction and old files."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import types as T

from emberline.streaming.buckets import BucketTable

SCHEMA = T.StructType().add("event_id", "string").add("at", "long").add("revision", "long").add("title", "string")


def table(spark, path, **options):
    return BucketTable(spark, str(path), SCHEMA, "event_id", "at", "revision", **{"buckets": 16, **options})


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def read(made, version=None):
    return {r["event_id"]: (r["at"], r["revision"], r["title"]) for r in made.rows(version).collect()}


def files(path):
    return {str(p): p.stat().st_size for p in Path(path, "data").rglob("*.parquet")}


def test_latest_rows_over_many_batches(spark, tmp_path):
    rng, made, held = random.Random(3), table(spark, tmp_path, most_deltas=2, buckets=4), {}
    for k in range(8):
        rows = [(rng.choice([None, *"abcdefghij"]), rng.choice([None, 1, 2, 3, 4]), 100 * k + i, f"{k}/{i}") for i in range(12 if k != 4 else 0)]
        made.upsert(batch(spark, *rows), k)
        for r in rows:
            old = held.get(r[0])
            if old is None or (r[1] is not None, r[1] or 0, r[2]) > (old[0] is not None, old[0] or 0, old[1]):
                held[r[0]] = r[1:]
        assert read(made) == held
    assert max(len(names) for names in made.manifest().files.values()) <= 3


def test_what_is_written_follows_the_batch(spark, tmp_path):
    made = table(spark, tmp_path)
    made.upsert(batch(spark, *((f"k{i}", 1, i, "x" * 50) for i in range(4000))), 0)
    before = files(tmp_path)
    after = made.upsert(batch(spark, ("k1", 2, 0, "new"), ("k2", 0, 0, "late"), ("fresh", 1, 0, "f")), 1)
    new = {p: n for p, n in files(tmp_path).items() if p not in before}
    assert len(new) <= 3 and sum(new.values()) < 0.1 * sum(before.values()) and sum(len(n) > 1 for n in after.files.values()) >= 1
    found = read(made)
    assert (found["k1"], found["k2"], found["fresh"]) == ((2, 0, "new"), (1, 2, "x" * 50), (1, 0, "f")) and len(found) == 4001


def test_replays_and_failures_are_exact(spark, tmp_path):
    made = table(spark, tmp_path)
    made.upsert(batch(spark, ("a", 1, 1, "old")), 0)
    made.upsert(batch(spark, ("a", 2, 1, "new"), ("b", 1, 1, "b")), 1)
    state, stored = made.manifest(), files(tmp_path)
    assert made.upsert(batch(spark, ("a", 9, 9, "again")), 1) == state and made.upsert(batch(spark, ("z", 1, 1, "z")), 0) == state and files(tmp_path) == stored
    commit, made._commit = made._commit, lambda m: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        made.upsert(batch(spark, ("a", 3, 1, "half"), ("c", 1, 1, "c")), 2)
    made._commit = commit
    assert read(made) == {"a": (2, 1, "new"), "b": (1, 1, "b")}
    made.upsert(batch(spark, ("a", 3, 1, "whole")), 2)
    assert read(made) == {"a": (3, 1, "whole"), "b": (1, 1, "b")}


def test_old_files_go_and_readers_keep_their_version(spark, tmp_path):
    made = table(spark, tmp_path, buckets=1, most_deltas=1, kept=2)
    made.upsert(batch(spark, ("a", 0, 0, "0")), 0)
    for k in range(1, 7):
        held = made.rows()  # planned on the version before
        made.upsert(batch(spark, ("a", k, 0, str(k))), k)
        assert [r["title"] for r in held.collect()] == [str(k - 1)]
    assert len(files(tmp_path)) <= 4 and len(list(Path(tmp_path, "log").glob("*.json"))) == 2
    assert read(made) == {"a": (6, 0, "6")}


def test_a_stream_is_followed_across_runs(spark, tmp_path):
    source, made = tmp_path / "in", table(spark, tmp_path / "table")
    for run in range(2):
        batch(spark, *((f"k{i}", run, i, f"run {run}") for i in range(50 - 20 * run))).repartition(3).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        made.follow(stream, str(tmp_path / "mark")).awaitTermination()
    found = read(made)
    assert len(found) == 50 and found["k3"] == (1, 3, "run 1") and found["k45"] == (0, 45, "run 0") and made.manifest().batch >= 3
