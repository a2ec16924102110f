"""The registered queries of the corpus operators, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import bpe, clustering, licenses, mixing, ngram_join, oracles, packing, pii, quality_classifier, quality_rules, resampling, secrets, simhash, toxicity
from emberline.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean(table(spark, sf_dir, "documents"), with_text=False)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "text_score", "page_score", "quality_score", F.col("quality_kept").alias("kept"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), pii.train(spark))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.train(docs, table(spark, sf_dir, "labels")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda text: F.sha2(text, 256)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return bpe.encoded(table(spark, sf_dir, "documents")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(ids).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_best_fit_packing,
        op3_quality_rules,
        op4_license_scans,
        op5_document_fingerprints,
        op6_quality_classifier,
        op7_pii,
        op8_secret_scans,
        op9_toxicity,
        op10_mixing,
        op11_importance_resampling,
        op12_bpe,
        op13_centroid_clustering,
    )
}
ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": oracles.NGRAM_JOIN, "op3_quality_rules": oracles.QUALITY_RULES, "op11_importance_resampling": oracles.RESAMPLING, "op13_centroid_clustering": oracles.CLUSTERING}
