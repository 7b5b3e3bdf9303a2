"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import spark as S
from tessera.llm.op1_quality_classifier import quality_classifier, trusted_documents
from tessera.llm.op2_ngram_jaccard_join import jaccard_join
from tessera.llm.op5_best_fit_packing import best_fit_packing
from tessera.llm.op7_soft_mixing import TARGETS, domains_of, soft_mixing
from tessera.llm.op8_exact_dedup import exact_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    kept = quality_classifier(docs, trusted_documents(spark, sf_dir)).where("keep").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays; of rows that also share the doc_id, one."""
    kept = exact_dedup(docs).where("kept").select("doc_id", F.col("text_sha256").alias("_text"))
    named = docs.withColumn("_text", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    return named.join(kept, ["doc_id", "_text"], "left_semi").dropDuplicates(["doc_id", "_text"]).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    kept = jaccard_join(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: the whole part, and once more with the chance of the rest, drawn by the doc_id's hash."""
    rate = soft_mixing(docs, domains_of(spark, sf_dir), TARGETS).groupBy("doc_id").agg(F.avg("rate").alias("rate"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    times = rate.select("doc_id", F.floor(F.col("rate") + chance).cast("int").alias("_times")).where("_times > 0")
    return docs.join(times, "doc_id").withColumn("_time", F.explode(F.sequence(F.lit(1), "_times"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("soft_mixing", mixed),
    ("best_fit_packing", packed),
]
#: SQL cannot express the trained models and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
