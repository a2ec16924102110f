"""Checks before publication, the status of a run, and drift between versions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Keys and text that must never be published.
BANNED_KEYS = ("id", "simulation", "priority_factors", "created_at", "token", "api_key", "secret", "password")
BANNED_KEYS_FEED = ("id", "status", "simulation", "token", "api_key", "secret", "password")
FORBIDDEN_TEXT = ("/Users/", ".codex", "BEGIN PRIVATE KEY")
FORBIDDEN_TEXT_FEED = ("/Users/", ".codex")


def banned_among(keys: Column, banned: tuple[str, ...] = BANNED_KEYS) -> Column:
    """The banned ones of an array of keys."""
    return F.array_intersect(keys, F.array(*(F.lit(k) for k in banned)))


def leaked_keys(candidates: DataFrame, banned: tuple[str, ...] = BANNED_KEYS) -> list[str]:
    """Banned columns; a matter of the schema, so no rows are read."""
    return sorted(set(candidates.columns) & set(banned))


def violations(candidates: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN_TEXT) -> DataFrame:
    """(name, problem) of rows without a name or with forbidden text in any field."""
    return candidates.select("name", F.explode(_problems(candidates, forbidden)).alias("problem"))


def _problems(candidates: DataFrame, forbidden: tuple[str, ...]) -> Column:
    whole = F.to_json(F.struct(*candidates.columns))
    return F.array_compact(
        F.array(F.when(F.coalesce(F.col("name"), F.lit("")) == "", "no name"), *(F.when(whole.contains(bad.replace("/", "\\/")) | whole.contains(bad), f"forbidden content: {bad}") for bad in forbidden))
    )


class Rejected(ValueError):
    """What was to be published failed its checks."""


def check(
    candidates: DataFrame, schema_version: int, expected: int, banned: tuple[str, ...] = BANNED_KEYS, forbidden: tuple[str, ...] = FORBIDDEN_TEXT, shown: int = 20
) -> None:
    """Raise Rejected with at most `shown` problems of rows; the feed has its own banned keys and forbidden text."""
    problems = [] if schema_version == expected else ["schema_version mismatch"]
    problems += [f"leaks {k}" for k in leaked_keys(candidates, banned)]
    if "name" in candidates.columns:
        problems += [f"{r['name']}: {r['problem']}" for r in violations(candidates, forbidden).limit(shown).collect()]
    else:
        problems.append("candidates have no name")
    if problems:
        raise Rejected("; ".join(problems))


def run_status(sources: DataFrame, *by: str) -> DataFrame:
    """One row (for each value of `by`): ok if a source is, degraded if some are enabled and none is ok, else idle."""
    ok, enabled = F.count_if(F.col("state") == "ok"), F.count_if(F.col("state") != "disabled")
    return sources.groupBy(*by).agg(ok.alias("ok"), enabled.alias("enabled")).withColumn("status", F.when(F.col("ok") > 0, "ok").when(F.col("enabled") > 0, "degraded").otherwise("idle"))


def drift(before: DataFrame, after: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """(key, change): keys removed, added and, with a value (a content hash, say), changed. Missing `before` rows are a baseline."""
    a = before.select(F.col(key).alias("_k"), F.lit(True).alias("_a"), *([F.col(value).alias("_va")] if value else [])).alias("a")
    b = after.select(F.col(key).alias("_k"), F.lit(True).alias("_b"), *([F.col(value).alias("_vb")] if value else [])).alias("b")
    both = a.join(b, F.col("a._k").eqNullSafe(F.col("b._k")), "full").withColumn(key, F.coalesce("a._k", "b._k"))
    change = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added")
    if value:
        change = change.when(~F.col("_va").eqNullSafe(F.col("_vb")), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")


def hash_sums(rows: DataFrame, volatile: tuple[str, ...]) -> list[Column]:
    """Aggregates over a digest of each row: their number and sums of four parts, whatever the order of rows."""
    digest = F.sha2(F.to_json(F.struct(*(c for c in rows.columns if c not in volatile))).cast("binary"), 256)
    word = lambda i: F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    return [F.count("*").alias("n"), *(F.coalesce(F.sum(word(i)), F.lit(0)).alias(f"w{i}") for i in range(4))]


def content_hash(rows: DataFrame, volatile: tuple[str, ...] = ("generated_at",)) -> DataFrame:
    """One row: an order-free digest of the rows without volatile columns, from partial sums of row hashes."""
    return rows.agg(*hash_sums(rows, volatile)).select(
        F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("n", "w0", "w1", "w2", "w3"))).cast("binary"), 256).alias("content_hash")
    )


@dataclass(frozen=True)
class Audit:
    """What one pass over candidates tells: how many there are, how many have a problem, and their content's hash."""

    n: int
    faulty: int
    content_hash: str

    @classmethod
    def of(cls, metrics: dict) -> Audit:
        words = ":".join(str(int(metrics[c])) for c in ("n", "w0", "w1", "w2", "w3"))
        return cls(metrics["n"], metrics["faulty"], hashlib.sha256(words.encode()).hexdigest())


def audit_metrics(rows: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN_TEXT, volatile: tuple[str, ...] = ("generated_at",)) -> list[Column]:
    """The aggregates of an audit, to be observed while rows are written or computed by themselves."""
    return [*hash_sums(rows, volatile), F.count_if(F.size(_problems(rows, forbidden)) > 0).alias("faulty")]


def audited(rows: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN_TEXT) -> Audit:
    """The audit of rows, in one pass."""
    return Audit.of(rows.agg(*audit_metrics(rows, forbidden)).first().asDict())


def observed(rows: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN_TEXT) -> tuple[DataFrame, Callable[[], Audit]]:
    """rows to be written once, and a function that gives their audit after that, without another pass."""
    seen = Observation()
    return rows.observe(seen, *audit_metrics(rows, forbidden)), lambda: Audit.of(seen.get)
