"""The corpus pipeline: each stage reads what its predecessor kept.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last one with the columns
of documents. Rows with a null doc_id pass the stages that decide by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spandrel.llm import decontamination, packing, quality_classifier, secret_scan, simhash
from spandrel.llm.lineage import materialize

#: Words that a benchmark item needs to be looked for: shorter ones are phrases of many clean documents.
LEAST_ITEM_WORDS = 3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws, as many as have a weight of one half or more; the model is fitted on this stage's input."""
    verdict = quality_classifier.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.join(verdict.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), LEAST_ITEM_WORDS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secret_scan.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin and offset of every piece of every document."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]
#: SQL can't express the fingerprints, the entropy windows or the bins; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
