"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. When a stage begins, the working tables of the one before
are removed, but for any that its docs still read.

Cases: null and empty texts, null ids, repeated rows and extra columns go through all stages as the operators say; the quality classifier and the mix keep all
documents (at rate 1) where no label names one of them. Empty documents give no pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import mixing, ngram_join, packing, pii, quality_classifier
from emberline.llm.common import dropped, gathering, shared_folder, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The folders with working tables of each stage, by its function's name.
_worked: dict[str, list[str]] = {}


def _after(before: str | None) -> Callable[[Stage], Stage]:
    """Marks a stage that follows `before`, whose working tables it removes: its own docs are what that stage made, written and reread."""

    def marked(stage: Stage) -> Stage:
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            read = docs.inputFiles() if _worked.get(before) else []
            for folder in _worked.pop(before, []):
                if not any(folder in file for file in read):
                    dropped(spark, folder)
            with gathering() as made:
                out = stage(spark, docs, sf_dir)
            _worked[stage.__name__] = made
            return out

        return run

    return marked


@_after(None)
def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier doesn't reject.

    Scored rows are stored before they are filtered: a filter above them would be pushed down and repeat the features of each text.
    """
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = stored(quality_classifier.score(docs, model), shared_folder(spark), "scored")
    return scored.filter("quality_kept").select(*docs.columns)


@_after("classified")
def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return ngram_join.one_each(docs)


@_after("deduplicated")
def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced in their texts."""
    return pii.redact(docs, pii.train(spark))


@_after("redacted")
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixing rates say."""
    return mixing.resampled(docs, mixing.train(docs, table(spark, sf_dir, "labels")))


@_after("mixed")
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, each with its place in a sequence."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", classified),
    ("n-gram Jaccard join", deduplicated),
    ("PII", redacted),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: Classifiers, rates and token packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each stage's result stored in the shared folder and read again."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
