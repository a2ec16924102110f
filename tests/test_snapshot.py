"""The snapshot on hand-made tables: nulls, limits before filters, ties, links, evidence, bands, checks, writing."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberline.operators import rollups, validate
from emberline.operators.links import FEED_PROVIDERS, links
from emberline.plans import snapshot as plan
from emberline.sources.readers import empty_catalogue, fact_sheet, file_counts, settings, stamped
from emberline.sources.schemas import TABLES
from emberline.sources.sinks import current, publish


def rows(spark, table, *dicts):
    names = TABLES[table].names
    return spark.createDataFrame([tuple(d.get(c) for c in names) for d in dicts], TABLES[table])


def event(i, **more):
    return {"id": f"e{i}", "preferred_name": f"N{i}", "updated_at": f"2024-01-{i:02d} 00:00:00.5", **more}


@pytest.fixture(scope="module")
def tables(spark):
    t = empty_catalogue(spark)
    t["events"] = rows(
        spark, "events",
        event(1, simulation=0, priority_score=75.0, primary_messenger=" optical ", discovery_survey="Z", status="new"),
        event(2, simulation=None, priority_score=50.0, status="MERGED"),
        event(3, simulation=1), event(4, preferred_name="  "), event(5, priority_score=25.0, ra_deg=float("nan"), discovery_survey="Z"),
        event(6, updated_at=None, discovery_time="2024-01-06T01:02:03Z", priority_factors='{"recency_points": 3.5, "secret": 1, "status": " ", "coverage_reduction": [1]}', status="merged", discovery_survey="Z"),
        event(7, priority_factors='{"recency_points": 3.5, "secret": 1, "status": " x ", "coverage_reduction": [1]}', discovery_survey="Y", status="new"),
        event(8, priority_factors="{broken"),
    )
    t["aliases"] = rows(
        spark, "aliases", *({"event_id": "e1", "provider": p, "external_id": x} for p, x in (("TNS", "AT2024abc"), ("tns", "AT2024abc"), ("tns", "ZTF1"), ("internal", "q"), ("gcn", " "), ("gcn", "G1"))),
        *({"event_id": "e5", "provider": "gcn", "external_id": f"G{k}"} for k in range(9)),
    )
    seen = lambda i, k, **more: {"id": k, "event_id": i, "provider": "p", "data_rights": "public", **more}
    t["observations"] = rows(
        spark, "observations", seen("e1", 1, observed_at="2024-01-01 00:00:00"), seen("e1", 2), seen("e1", 3, observed_at="2024-01-02 00:00:00", superseded=0),
        seen("e1", 4, observed_at="2024-01-02 00:00:00"), seen("e1", 5, superseded=1), seen("e1", 6, data_rights="PUBLIC"), seen("e1", 7, data_rights=None), seen("e9", 8, data_rights="open"),
    )
    t["publications"] = rows(spark, "publications", {"id": 1, "provider": "gcn", "data_rights": "open"}, {"id": 2, "provider": "gcn", "data_rights": "public"})
    t["publication_revisions"] = rows(
        spark, "publication_revisions", *({"id": i, "publication_id": 1, "retrieved_at": r, "title": f"t{i}"} for i, r in ((1, "2024-01-02"), (2, "2024-01-02"), (3, "2024-01-01")))
    )
    t["publication_event_links"] = rows(spark, "publication_event_links", {"event_id": "e1", "publication_id": 1}, {"event_id": "e1", "publication_id": 2})
    t["sources"] = rows(spark, "sources", {"id": "p", "display_name": "P", "data_types": '["a","b"]', "enabled": 1}, {"id": "q", "display_name": "Q", "data_types": "{bad"})
    return t


def test_candidates(spark, tables):
    found = {r["name"]: r for r in plan.candidates(tables).collect()}
    assert set(found) == {"N1", "N5", "N7", "N8"}
    one = found["N1"]
    assert one["updated_at"] == "2024-01-01T00:00:00Z" and one["primary_messenger"] == "optical" and found["N5"]["ra_deg"] is None
    assert [(x["label"], x["designation"], x["url"]) for x in one["links"]] == [
        ("GCN", "G1", None), ("TNS", "AT2024abc", "https://www.wis-tns.org/object/2024abc"), ("TNS", "ZTF1", None),
    ]
    assert len(found["N5"]["links"]) == 6
    assert [x["observed_at"] for x in one["follow_up"]["observations"]] == ["2024-01-02T00:00:00Z"] * 2 + ["2024-01-01T00:00:00Z", None]
    assert [x["title"] for x in one["follow_up"]["publications"]] == ["t2"]
    assert one["follow_up_total"] == 5 and found["N7"]["follow_up_total"] == 0 and found["N7"]["follow_up"] is None and one["follow_up"]["spectra"] == []
    factors = plan.candidates(tables).filter("name in ('N7', 'N8')").select("name", F.to_json("score_factors").alias("f")).collect()
    assert {r["name"]: json.loads(r["f"]) if r["f"] else None for r in factors} == {"N7": {"recency_points": 3.5, "status": "x"}, "N8": None}


def test_limit_comes_before_filters(tables):
    assert plan.candidates(tables, most=2).count() == 2 and plan.candidates(tables, most=5).count() == 3


def test_sections(spark, tables):
    made = plan.snapshot(tables)
    stats = made.statistics.first()
    assert (stats["real_events"], stats["public_candidates"], stats["observations"], stats["publications"], stats["candidates_with_follow_up"]) == (7, 4, 4, 1, 1)
    assert (stats["published"], stats["skipped"]) == (4, 3)
    assert {r["band"]: r["n"] for r in made.bands.collect()} == {"urgent_75_100": 1, "high_50_74": 0, "routine_25_49": 1, "low_0_24": 2}
    assert {r["messenger"]: r["n"] for r in made.messengers.collect()} == {"optical": 1, "unknown": 3}
    assert {r["provider"]: r["total"] for r in made.providers.collect()} == {"p": 5, "gcn": 2}
    assert {r["survey"]: r["candidate_count"] for r in made.surveys.collect()} == {"Y": 1, "Z": 1}
    shown = {r["source"]: r for r in made.sources.collect()}
    assert shown["p"]["data_types"] == ["a", "b"] and shown["q"]["data_types"] == [] and shown["q"]["state"] == "unknown" and shown["q"]["enabled"] is False
    assert [r["name"] for r in made.recent.collect()] == ["N8", "N7", "N5", "N1"]


def test_empty(spark):
    made = plan.snapshot(empty_catalogue(spark))
    assert made.candidates.count() == 0 and made.statistics.first()["real_events"] == 0 and made.bands.count() == 4


def test_publish(spark, tables, tmp_path):
    made, folder = plan.snapshot(tables), str(tmp_path / "out")
    assert publish(made, folder, "2024-01-01T00:00:00Z", dry_run=True)["written"] is False and not (tmp_path / "out").exists()
    first = publish(plan.snapshot(tables, store=str(tmp_path / "store")), folder, "2024-01-01T00:00:00Z")
    version = current(spark, folder)
    assert first["written"] and spark.read.json(f"{version}/candidates").count() == 4
    whole = json.loads(Path(version, "candidates.json").read_text())
    assert (whole["schema_version"], whole["candidate_count"], whole["degraded"], whole["generated_at"]) == (2, 4, False, "2024-01-01T00:00:00Z")
    assert [c["name"] for c in whole["candidates"]] == ["N8", "N7", "N5", "N1"] and len(whole["candidates"][3]["follow_up"]["observations"]) == 4
    status = json.loads(Path(version, "status.json").read_text())
    assert status["statistics"] == whole["statistics"] and status["content_hash"] == first["content_hash"] and len(status["surveys"]) == 2
    assert publish(made, folder, "2024-01-02T00:00:00Z")["written"] is False
    assert publish(plan.snapshot(tables, 2), folder, "2024-01-03T00:00:00Z", degraded=True)["written"] is False
    assert publish(plan.snapshot(tables, 2), folder, "2024-01-03T00:00:00Z")["written"] and current(spark, folder) != version and Path(version).exists()
    assert publish(made, folder, "2024-01-04T00:00:00Z")["written"] and not Path(version).exists() and len(list(Path(folder).glob("v-*"))) == 2
    with pytest.raises(validate.Rejected):
        publish(plan.Snapshot(made.candidates.withColumn("token", F.lit(1)), *[getattr(made, f) for f in ("statistics", "messengers", "bands", "recent", "sources", "providers", "surveys")]), folder, "x")


def test_properties(tables):
    shown = plan.candidates(tables)
    assert not validate.leaked_keys(shown)
    assert rollups.bands(shown, F.col("score")).agg(F.sum("n")).first()[0] == shown.count()
    assert validate.leaked_keys(shown, validate.BANNED_KEYS_FEED) == ["status"]


def test_feed(spark):
    row = lambda name, score, at, aliases=(), sim=0: (name, score, at, list(aliases), sim)
    base = spark.createDataFrame(
        [row("A", 5.0, "2024-01-10 00:00:00", [("tns", "ZTF1"), ("fink", "f1")]), row("B", 9.0, "2024-01-09 00:00:00"), row("C", None, "2024-01-10 00:00:00"),
         row("D", 9.0, "2024-01-01 00:00:00"), row("", 1.0, "2024-01-10 00:00:00"), row("E", 1.0, "2024-01-10 00:00:00", (), 1)],
        "preferred_name string, priority_score double, updated_at string, aliases array<struct<provider string, external_id string>>, simulation int",
    )
    for source, _ in plan.FEED_PUBLISHED:
        if source not in base.columns:
            kind = "double" if source in ("ra_deg", "dec_deg", "discovery_magnitude", "consensus_probability") else "string"
            base = base.withColumn(source, F.lit(None).cast(kind))
    feed = plan.feed(base.withColumn("priority_factors", F.lit(None).cast("string")), F.lit("2024-01-11 00:00:00").cast("timestamp"))
    got = feed.collect()
    assert [r["name"] for r in got] == ["B", "A", "C"] and "status" not in feed.columns
    assert [x["designation"] for x in got[1]["links"]] == ["f1"]
    assert links(spark.createDataFrame([], TABLES["aliases"]), FEED_PROVIDERS).count() == 0


def test_facts_and_drift(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\ntext *b*\n## Two\n")
    sheet = fact_sheet(spark, str(tmp_path)).collect()
    assert sheet[0]["headings"] == ["One", "Two"] and len(sheet[0]["sha256"]) == 64
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests" / "test_a.py").write_text("x")
    counts = {r["kind"]: r["n"] for r in file_counts(spark, str(tmp_path), {"tests": r"/tests/test_[^/]*\.py$", "docs": r"\.md$", "none": "zzz"}).collect()}
    assert counts == {"tests": 1, "docs": 1, "none": 0}
    made = spark.createDataFrame([('name = "e"\nversion = "1.2"',)], "t string").select(settings(F.col("t"), "version", "missing").alias("s")).first()["s"]
    assert made["version"] == "1.2" and made["missing"] is None
    page = spark.createDataFrame([('x <span data-fact="n">1</span>',)], "t string").select(stamped(F.col("t"), {"n": F.lit(42)}).alias("t")).first()["t"]
    assert page == 'x <span data-fact="n">42</span>'
    a, b = (spark.createDataFrame(r, "k string, v string") for r in ([("x", "1"), ("y", "1")], [("y", "2"), ("z", "1")]))
    assert {r["k"]: r["change"] for r in validate.drift(a, b, "k", "v").collect()} == {"x": "removed", "y": "changed", "z": "added"}
