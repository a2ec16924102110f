"""Documents of ordered sections: order, empty sections, failures, and the published snapshot and feed."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberline.operators import validate
from emberline.plans import documents as plan
from emberline.plans import snapshot
from emberline.sources import sinks
from emberline.sources.documents import entries, values, write_documents

from .test_snapshot import tables  # noqa: F401  a fixture

SECTIONS = {"a": [("title", False), ("rows", True), ("none", True), ("absent", False)], "b": [("rows", True)]}


def read(path):
    return json.loads(Path(path).read_text(), object_pairs_hook=lambda pairs: dict(pairs) if len(dict(pairs)) == len(pairs) else pairs)


def test_sections_and_entries_keep_their_order(spark, tmp_path):
    rows = spark.range(5000).select((F.lit(5000) - F.col("id")).alias("k"), F.when(F.col("id") % 2 == 0, 'tab\t "quoted"\nline').alias("t")).repartition(9)
    made = values(spark, "a", title="T\t1").unionByName(entries(rows.orderBy("k"), "a", "rows")).unionByName(entries(rows.orderBy(F.desc("k")).limit(7), "b", "rows"))
    write_documents(made.repartition(5), str(tmp_path / "out"), SECTIONS)
    a, b = read(tmp_path / "out" / "a.json"), read(tmp_path / "out" / "b.json")
    assert list(a) == ["title", "rows", "none", "absent"] and (a["title"], a["none"], a["absent"]) == ("T\t1", [], None)
    assert [r["k"] for r in a["rows"]] == list(range(1, 5001)) and a["rows"][0].get("t") is None
    assert sum("t" in r for r in a["rows"]) == 2500 and next(r["t"] for r in a["rows"] if "t" in r) == 'tab\t "quoted"\nline'
    assert [r["k"] for r in b["rows"]] == list(range(5000, 4993, -1))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.json", "b.json"]


def test_no_rows(spark, tmp_path):
    write_documents(values(spark, "a", title=1).filter("1 = 0"), str(tmp_path), SECTIONS)
    assert read(tmp_path / "a.json") == {"title": None, "rows": [], "none": [], "absent": None}


@pytest.mark.parametrize("fault", ["task", "undeclared", "twice"])
def test_a_failure_leaves_no_document(spark, tmp_path, fault):
    rows = values(spark, "a", title=1).unionByName(entries(spark.range(100).repartition(4), "a", "rows"))
    if fault == "task":
        rows = rows.withColumn("body", F.when(F.col("place") % 7 == 6, F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    else:
        rows = rows.unionByName(values(spark, "a", **({"other": 1} if fault == "undeclared" else {"title": 2})))
    with pytest.raises(Exception, match="lost|declared|twice"):
        write_documents(rows, str(tmp_path / "out"), SECTIONS)
    assert not [p for p in tmp_path.rglob("*.json") if fault != "undeclared"] and not list(tmp_path.rglob("_parts*/*"))


def test_snapshot_documents_have_all_sections(spark, tables, tmp_path):  # noqa: F811
    made, folder = snapshot.snapshot(tables, store=str(tmp_path / "store")), str(tmp_path / "out")
    sinks.publish(made, folder, "2024-01-01T00:00:00Z")
    version = sinks.current(spark, folder)
    whole, status = read(f"{version}/candidates.json"), read(f"{version}/status.json")
    assert list(whole) == [s for s, _ in plan.SNAPSHOT_SECTIONS["candidates"]] and list(status) == [s for s, _ in plan.SNAPSHOT_SECTIONS["status"]]
    assert whole["statistics"] == {
        "real_events": 7, "public_candidates": 4, "observations": 4, "spectra": 0, "messenger_signals": 0, "classifications": 0, "publications": 1, "candidates_with_follow_up": 1,
        "messengers": {"optical": 1, "unknown": 3}, "priority_bands": {"urgent_75_100": 1, "high_50_74": 0, "routine_25_49": 1, "low_0_24": 2},
    }
    assert list(whole["statistics"]["priority_bands"]) == ["urgent_75_100", "high_50_74", "routine_25_49", "low_0_24"] and status["statistics"] == whole["statistics"]
    assert whole["provider_statistics"] == [{"provider": "p", "observations": 5}, {"provider": "gcn", "publications": 2}]
    assert [(s["source"], s["record_counts"]) for s in whole["sources"]] == [("p", {"observations": 5}), ("q", {})] == [(s["source"], s["record_counts"]) for s in status["sources"]]
    assert whole["surveys"] == [{"survey": "Y", "candidate_count": 1}, {"survey": "Z", "candidate_count": 1}]
    assert [r["name"] for r in whole["recent_stream"]] == ["N8", "N7", "N5", "N1"] and "place" not in whole["recent_stream"][0]


def states(spark, *rows):
    return spark.createDataFrame(rows, "source string, state string, detail string")


def test_feed_is_published_kept_and_refused(spark, tmp_path):
    folder = str(tmp_path / "feed")
    shown = spark.createDataFrame([("A", 5.0), ("B", 9.0), ("C", None), ("D", 9.0)], "name string, score double")
    down = states(spark, ("s", "timeout", "no response"), ("t", "disabled", None))
    with pytest.raises(validate.Rejected):
        sinks.publish_feed(shown, down, folder, "t0")
    up = states(spark, ("t", "ok", "4 items"), ("s", "unavailable", "x"))
    first = sinks.publish_feed(shown, up, folder, "t1", seconds=1.5)
    version = sinks.current(spark, folder)
    whole, status = read(f"{version}/candidates.json"), read(f"{version}/status.json")
    assert first["status"] == "ok" and [c["name"] for c in whole["candidates"]] == ["B", "D", "A", "C"] and whole["lookback_hours"] == 72.0 and whole["degraded"] is False
    assert [s["source"] for s in status["sources"]] == ["s", "t"] and status["runtime_seconds"] == 1.5 and status["detail"] is None
    sinks.publish_feed(shown.limit(1), down, folder, "t2")
    kept = sinks.current(spark, folder)
    again, told = read(f"{kept}/candidates.json"), read(f"{kept}/status.json")
    assert kept != version and again == whole and (told["pipeline_status"], told["last_successful_update"], told["last_attempt"], told["candidate_count"]) == ("degraded", "t1", "t2", 4)
    assert [s["state"] for s in told["sources"]] == ["timeout", "disabled"] and told["detail"]
    with pytest.raises(validate.Rejected):
        sinks.publish_feed(shown.withColumn("status", F.lit("x")), up, folder, "t3")
    assert sinks.current(spark, folder) == kept
    empty = sinks.publish_feed(shown.limit(0), down, folder, "t4", allow_empty=True)
    assert empty["status"] == "degraded" and read(f"{sinks.current(spark, folder)}/candidates.json")["candidates"] == []
    idle = sinks.publish_feed(shown, states(spark, ("t", "disabled", None)), folder, "t5")
    assert idle["status"] == "idle" and not idle["degraded"]


def test_audit_is_seen_while_storing(spark, tables, tmp_path):  # noqa: F811
    """One pass tells what three would: the number, the hash, and whether anything is wrong."""
    made = snapshot.snapshot(tables, store=str(tmp_path / "store"))
    assert made.audit == validate.audited(made.candidates) and made.audit.n == 4 and made.audit.faulty == 0
    assert made.audit.content_hash == validate.content_hash(made.candidates).first()["content_hash"]
    bad = made.candidates.withColumn("host_name", F.when(F.col("name") == "N5", "see /Users/x")).withColumn("name", F.when(F.col("name") != "N7", F.col("name")))
    assert validate.audited(bad).faulty == 2 and validate.violations(bad).count() == 2
    watched, told = validate.observed(bad)
    watched.write.parquet(str(tmp_path / "bad"))
    assert told() == validate.audited(bad)
    with pytest.raises(validate.Rejected, match="/Users/"):
        sinks.publish(snapshot.Snapshot(bad, *[getattr(made, f) for f in ("statistics", "messengers", "bands", "recent", "sources", "providers", "surveys")]), str(tmp_path / "out"), "x")
