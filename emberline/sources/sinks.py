"""Publishing a snapshot or a feed: checked, written as a new version, and made current by one atomic rename if its content changed.

A version holds candidates.json and status.json. A run that fails at any point leaves the version before; so does a task, since documents
appear only when their whole write commits (see `documents`), and readers follow the pointer, which moves last.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.validate import BANNED_KEYS, BANNED_KEYS_FEED, FORBIDDEN_TEXT, FORBIDDEN_TEXT_FEED, Audit, Rejected, audited, check, leaked_keys, run_status
from emberline.plans import documents
from emberline.plans.snapshot import FEED_VERSION, SCHEMA_VERSION, Snapshot
from emberline.sources.documents import write_documents
from emberline.sources.storage import file_system as _fs


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the current version, or None before the first."""
    fs, pointer = _fs(spark, f"{folder}/current")
    return f"{folder}/{spark.read.text(f'{folder}/current').first()['value']}" if fs.exists(pointer) else None


def last_hash(spark: SparkSession, folder: str) -> str | None:
    version = current(spark, folder)
    return None if version is None else _status(spark, version)["content_hash"]


def _single(rows: DataFrame, path: str) -> None:
    """Rows of text as one file named path."""
    spark = rows.sparkSession
    rows.coalesce(1).write.text(f"{path}.parts")
    fs, parts = _fs(spark, f"{path}.parts")
    made = fs.globStatus(_fs(spark, f"{path}.parts/part-*")[1])[0].getPath()
    fs.rename(made, _fs(spark, path)[1])
    fs.delete(parts, True)


def _point(spark: SparkSession, folder: str, version: str) -> None:
    """Replace the pointer by one rename, so readers see the old version or the new one, and never none."""
    _single(spark.createDataFrame([(version,)], "value string"), f"{folder}/{version}-pointer")
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    source, target = hadoop.Path(f"{folder}/{version}-pointer"), hadoop.Path(f"{folder}/current")
    hadoop.FileContext.getFileContext(source.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration()).rename(source, target, overwrite)


def _publish(spark: SparkSession, folder: str, rows: DataFrame, sections: dict, before: str | None, extra=None) -> None:
    """Write a version's documents, point to it, and remove all versions but it and the one before, which may have readers."""
    version = f"v-{uuid.uuid4().hex}"
    if extra is not None:
        extra(f"{folder}/{version}")
    write_documents(rows, f"{folder}/{version}", sections)
    _point(spark, folder, version)
    fs, root = _fs(spark, folder)
    keep = {version, before.rsplit("/", 1)[-1] if before else version}
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if entry.isDirectory() and name.startswith("v-") and name not in keep:
            fs.delete(entry.getPath(), True)


def _sound(rows: DataFrame, version: int, seen: Audit | None, banned: tuple[str, ...] = BANNED_KEYS, forbidden: tuple[str, ...] = FORBIDDEN_TEXT) -> Audit:
    """The audit of rows that may be published; Rejected if they may not. Rows are read again only to say what is wrong with them."""
    if "name" in rows.columns and not leaked_keys(rows, banned):
        seen = seen or audited(rows, forbidden)
        if not seen.faulty:
            return seen
    check(rows, version, version, banned, forbidden)
    raise Rejected(f"{seen.faulty if seen else 'some'} rows with problems")


def publish(snapshot: Snapshot, folder: str, generated_at: str, dry_run: bool = False, degraded: bool = False) -> dict:
    """Check and write a version: candidates.json and status.json with all their sections, and all sections as tables.

    What was current stays if nothing changed, or if the run is degraded. Candidates are best stored once
    (`snapshot(..., store=...)`): checks, hash and count are then taken while they are written, and documents read them back. Fails with Rejected, before anything is written,
    if the candidates fail their checks.
    """
    spark = snapshot.candidates.sparkSession
    seen = _sound(snapshot.candidates, SCHEMA_VERSION, snapshot.audit)
    digest = seen.content_hash
    summary = {"content_hash": digest, "candidate_count": seen.n, "written": False, "degraded": degraded}
    if dry_run:
        return summary
    before = current(spark, folder)
    if before is not None and (degraded or digest == last_hash(spark, folder)):
        return summary

    def tables(version: str) -> None:
        for section in fields(snapshot):
            if isinstance(rows := getattr(snapshot, section.name), DataFrame):
                rows.write.json(f"{version}/{section.name}")

    rows = documents.snapshot_rows(snapshot, generated_at, summary["candidate_count"], digest, degraded)
    _publish(spark, folder, rows, documents.SNAPSHOT_SECTIONS, before, tables)
    return summary | {"written": True}


def _status(spark: SparkSession, version: str) -> dict:
    return json.loads(spark.read.text(f"{version}/status.json", wholetext=True).first()["value"])


def publish_feed(shown: DataFrame, states: DataFrame, folder: str, generated_at: str, hours: float = 72.0, seconds: float = 0.0, failed: bool = False, allow_empty: bool = False) -> dict:
    """Check and write the feed's candidates.json and status.json from its candidates and the states of its sources.

    A run is degraded if it failed, or if sources are enabled and none is ok. A degraded run keeps the candidates before and writes a status that says so; without
    any before, it fails with Rejected, unless an empty feed is allowed.
    """
    spark = shown.sparkSession
    told = run_status(states).first()
    degraded = failed or told["status"] == "degraded"
    before = current(spark, folder)
    if degraded and not allow_empty:
        if before is None:
            raise Rejected("no usable data and no previous data to keep")

        def keep(version: str) -> None:
            fs, source = _fs(spark, f"{before}/candidates.json")
            fs.mkdirs(_fs(spark, version)[1])
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, _fs(spark, f"{version}/candidates.json")[1], False, spark._jsc.hadoopConfiguration())

        rows = documents.retained_rows(spark, states, _status(spark, before), generated_at)
        _publish(spark, folder, rows, {"status": documents.FEED_SECTIONS["status"]}, before, keep)
        return {"written": False, "degraded": True, "status": "degraded"}
    seen = _sound(shown, FEED_VERSION, None, BANNED_KEYS_FEED, FORBIDDEN_TEXT_FEED)
    digest, count = seen.content_hash, seen.n
    status = "degraded" if degraded else told["status"]
    rows = documents.feed_rows(shown, states, generated_at, generated_at, status, count, digest, hours, seconds, degraded)
    _publish(spark, folder, rows, documents.FEED_SECTIONS, before)
    return {"written": True, "degraded": degraded, "status": status, "candidate_count": count, "content_hash": digest}
