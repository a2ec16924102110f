"""What the corpus operators share: reading tables, shared storage, text classes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: anything but a space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only a single-machine session may lack it.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "/tmp/checkpoints"
    folder = f"{root}/emberline-{uuid.uuid4().hex}"
    for made in _gathering:
        made.append(folder)
    return folder


_gathering: list[list[str]] = []


@contextmanager
def gathering() -> Iterator[list[str]]:
    """Gathers the shared folders that are named within, so that they can be removed once nothing reads them."""
    made: list[str] = []
    _gathering.append(made)
    try:
        yield made
    finally:
        _gathering.remove(made)


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and a lost executor costs a reread."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), whatever else the table holds."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def packed_rows(docs: DataFrame, *needed: str) -> DataFrame:
    """`_row`, holding all columns of docs, and those of `needed` that docs has: working columns then can't clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(c for c in needed if c in docs.columns))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a stored table that nothing reads any more, through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
