"""The published documents of a snapshot and of the feed, as rows of their sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.rollups import BANDS
from emberline.plans.snapshot import FEED_VERSION, KINDS, SCHEMA_VERSION, Snapshot
from emberline.sources.documents import entries, values

#: What the documents say about themselves.
ORIGIN, CADENCE = "local-snapshot", "about every 2 minutes"
#: The sections of each document, in order, and which of them are lists.
SNAPSHOT_SECTIONS = {
    "candidates": [
        ("schema_version", False), ("generated_at", False), ("origin", False), ("cadence", False), ("candidate_count", False), ("degraded", False), ("candidates", True),
        ("recent_stream", True), ("statistics", False), ("sources", True), ("provider_statistics", True), ("surveys", True),
    ],
    "status": [
        ("schema_version", False), ("pipeline_status", False), ("origin", False), ("last_successful_update", False), ("candidate_count", False), ("cadence", False),
        ("statistics", False), ("sources", True), ("surveys", True), ("content_hash", False),
    ],
}
FEED_SECTIONS = {
    "candidates": [
        ("schema_version", False), ("generated_at", False), ("cadence", False), ("lookback_hours", False), ("candidate_count", False), ("degraded", False), ("candidates", True),
    ],
    "status": [
        ("schema_version", False), ("pipeline_status", False), ("last_successful_update", False), ("last_attempt", False), ("candidate_count", False), ("cadence", False),
        ("runtime_seconds", False), ("sources", True), ("detail", False), ("content_hash", False),
    ],
}
_STATISTICS = ("real_events", "public_candidates", "observations", "spectra", "messenger_signals", "classifications", "publications", "candidates_with_follow_up")


def statistics_object(made: Snapshot) -> DataFrame:
    """One row: the statistics with messengers (by name) and bands (by rank) inside. Both are few: values of candidates, and four bands."""
    counted = F.map_from_entries(F.array_sort(F.collect_list(F.struct("messenger", "n"))))
    messengers = made.messengers.agg(counted.alias("messengers"))
    bands = made.bands.agg(F.struct(*(F.max(F.when(F.col("band") == name, F.col("n"))).alias(name) for name, _ in BANDS)).alias("priority_bands"))
    return made.statistics.select(*_STATISTICS).crossJoin(messengers).crossJoin(bands)  # one-row frames


def snapshot_rows(made: Snapshot, generated_at: str, count: int, digest: str, degraded: bool = False) -> DataFrame:
    """The rows of candidates.json and status.json."""
    spark = made.candidates.sparkSession
    newest = made.candidates.orderBy(F.coalesce("updated_at", "discovery_time").desc_nulls_last(), "name")
    no_counts = F.struct(*(F.lit(None).cast("long").alias(k) for k in KINDS))
    sources = made.sources.withColumn("record_counts", F.coalesce("record_counts", no_counts)).orderBy("label", "source")
    providers = made.providers.orderBy(F.desc("total"), "provider").select("provider", *KINDS)
    surveys = made.surveys.orderBy(F.desc("candidate_count"), "survey")
    statistics = statistics_object(made)
    recent = made.recent.orderBy("place").drop("place")
    shared = {"schema_version": SCHEMA_VERSION, "origin": ORIGIN, "cadence": CADENCE, "candidate_count": count}
    parts = [
        values(spark, "candidates", **shared, generated_at=generated_at, degraded=degraded),
        values(spark, "status", **shared, pipeline_status="degraded" if degraded else "ok", last_successful_update=generated_at, content_hash=digest),
        entries(newest, "candidates", "candidates"), entries(recent, "candidates", "recent_stream"), entries(providers, "candidates", "provider_statistics"),
        *(entries(rows, d, section) for d in ("candidates", "status") for section, rows in (("statistics", statistics), ("sources", sources), ("surveys", surveys))),
    ]
    return reduce(DataFrame.unionByName, parts)


def feed_rows(shown: DataFrame, states: DataFrame, generated_at: str, last_attempt: str, status: str, count: int, digest: str, hours: float, seconds: float, degraded: bool) -> DataFrame:
    """The rows of the feed's two documents. states has source, state, detail."""
    spark = shown.sparkSession
    ranked = shown.orderBy(F.coalesce("score", F.lit(0.0)).desc(), "name")
    shared = {"schema_version": FEED_VERSION, "cadence": CADENCE, "candidate_count": count}
    parts = [
        values(spark, "candidates", **shared, generated_at=generated_at, lookback_hours=hours, degraded=degraded),
        values(spark, "status", **shared, pipeline_status=status, last_successful_update=generated_at, last_attempt=last_attempt, runtime_seconds=seconds, content_hash=digest),
        entries(ranked, "candidates", "candidates"), entries(states.orderBy("source"), "status", "sources"),
    ]
    return reduce(DataFrame.unionByName, parts)


def retained_rows(spark, states: DataFrame, before: dict, last_attempt: str) -> DataFrame:
    """The feed's status where the documents before are kept: when they were made, how many candidates they have, and what failed."""
    kept = values(
        spark, "status", schema_version=FEED_VERSION, pipeline_status="degraded", last_successful_update=before["last_successful_update"], last_attempt=last_attempt,
        candidate_count=before["candidate_count"], cadence=CADENCE, detail="No source responded on this run; the previous data are kept.", content_hash=before["content_hash"],
    )
    return kept.unionByName(entries(states.orderBy("source"), "status", "sources"))
