"""A training corpus from raw documents: rules, near-dedup, personal data, mixing, packing.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read as the next one's ``docs``. All but the last return the columns of their input; every stage works on all
that its predecessor kept. The stages keep the operators' defined results for null, empty, repeated and clashing input.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, minhash, mixing, packing, pii, rules

#: One epoch, for a document that near-dedup has made unique should not come back as its own copy.
MIX = replace(mixing.TARGETS, max_epochs=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules or the classifier reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.apply_rules(docs, labels).filter("rules.kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays: the least doc_id."""
    return minhash.deduplicate(docs, width=5, percent=80)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return out


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A prefix of each source by the target weights of domains, languages and sources."""
    return mixing.mix(docs, MIX)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("mixing_weights", mixing_weights),
    ("best_fit_packing", best_fit_packing),
]

#: A fitted classifier and a tokenizer are not expressible in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over ``documents``."""
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
