"""Readers of the catalogue tables and of published documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.sources.schemas import TABLES


def read_catalogue(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a catalogue, one Parquet folder each, with their explicit schemas."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()}


def empty_catalogue(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def json_object(text: Column) -> Column:
    """JSON text as VARIANT; malformed and missing text is null."""
    return F.try_parse_json(text)


def json_strings(text: Column) -> Column:
    """A JSON array of strings; null and malformed text give an empty array (they don't stop the run)."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Published JSON, one document in a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_status(spark: SparkSession, path: str | None, candidates: DataFrame) -> DataFrame:
    """The status document, or one made from the data where there is none."""
    if path is not None:
        return read_documents(spark, path, "schema_version int, pipeline_status string, last_successful_update string, candidate_count long")
    return candidates.agg(
        F.lit(None).cast("int").alias("schema_version"), F.lit("unknown").alias("pipeline_status"), F.lit(None).cast("string").alias("last_successful_update"),
        F.count("*").alias("candidate_count"),
    )


def fact_sheet(spark: SparkSession, folder: str, suffix: str = ".md") -> DataFrame:
    """Facts about a folder of text files: path, SHA-256 of the content, headings, and the plain text's length."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{suffix}", recursiveFileLookup=True)
    plain = F.trim(F.regexp_replace(F.regexp_replace("value", r"(?m)^#+\s*|[*_`]", ""), r"\s+", " "))
    return files.select(
        F.input_file_name().alias("path"), F.sha2(F.col("value").cast("binary"), 256).alias("sha256"),
        F.regexp_extract_all("value", F.lit(r"(?m)^#{1,6}[ \t]+([^\n]+)"), F.lit(1)).alias("headings"), F.length(plain).alias("n_chars"),
    )


def file_counts(spark: SparkSession, folder: str, kinds: dict[str, str]) -> DataFrame:
    """(kind, n): how many files under folder match each kind's regular expression on their path (tests, modules, documents)."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", r"\A.*?" + re.escape(folder.rstrip("/")), "").alias("path"))
    return names.agg(*(F.count_if(F.col("path").rlike(p)).alias(k) for k, p in kinds.items())).unpivot([], list(kinds), "kind", "n")


def settings(text: Column, *keys: str) -> Column:
    """struct of `key = "value"` lines of a settings file; null for missing keys."""
    return F.struct(*(F.nullif(F.regexp_extract(text, rf'(?m)^{re.escape(k)}\s*=\s*"([^"]+)"', 1), F.lit("")).alias(k) for k in keys))


def stamped(template: Column, facts: dict[str, Column], attribute: str = "data-fact") -> Column:
    """template with the content of each <span {attribute}="KEY"> replaced by its fact."""
    out = template
    for key, value in facts.items():
        out = F.regexp_replace(out, F.lit(rf'(<span {attribute}="{key}">)[^<]*(</span>)'), F.concat(F.lit("$1"), value.cast("string"), F.lit("$2")))
    return out
