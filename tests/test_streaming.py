from __future__ import annotations

import json

from pyspark.sql import types as T

from emberline.streaming.ingest import arriving, keep_latest

SCHEMA = T.StructType().add("event_id", "string").add("retrieved_at", "timestamp").add("revision", "long").add("title", "string")


def test_two_runs_of_one_checkpoint(spark, tmp_path):
    folder, table, mark = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    folder.mkdir()

    def put(name, *rows):
        (folder / name).write_text("\n".join(json.dumps(dict(zip(SCHEMA.names, r, strict=True))) for r in rows))

    put("1.json", ("a", "2024-01-01T00:00:00Z", 1, "old"), ("a", "2024-01-01T00:00:00Z", 1, "old"), ("b", "2024-01-01T00:00:00Z", 1, "b"))
    keep_latest(arriving(spark, str(folder), SCHEMA), table, mark).awaitTermination()
    put("2.json", ("a", "2024-01-02T00:00:00Z", 2, "new"), ("b", "2024-01-01T00:00:00Z", 1, "again"))
    keep_latest(arriving(spark, str(folder), SCHEMA), table, mark).awaitTermination()
    last = max((tmp_path / "table").glob("v=*"), key=lambda p: int(p.name[2:]))
    assert {r["event_id"]: r["title"] for r in spark.read.schema(SCHEMA).parquet(str(last)).collect()} == {"a": "new", "b": "b"}
