"""A corpus pipeline: quality, rules, near-duplicates, secrets, packing.

Each stage is ``stage(spark, docs, sf_dir) -> DataFrame`` over all documents its
predecessor kept. The first four return the columns of documents; the last one
returns the pieces of the packed sequences with their token ids.

A document goes if the quality classifier or the rules reject it, or if it is not
the first of its group of near-duplicates. Secrets are masked in the text.

No stage is plain SQL (a trained ranking, estimated rule accuracies, compressed
sizes, a tokenizer), so ``ORACLE_SQL`` is None; tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import minhash, packing, quality, rules, secret_scan
from riskloom.llm.common import prepare, scratch, stored, table, whole_text
from riskloom.llm.queries import tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents the preference ranking puts below its bar."""
    prepare(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model, whole_text()) >= F.lit(quality.CUT))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the weighed rules hold to be bad."""
    prepare(spark)
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    prepare(spark)
    return minhash.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets."""
    prepare(spark)
    return secret_scan.mask_secrets(docs)


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    prepare(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixture_packing", mixture_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again.

    What a stage itself has stored on the way goes when its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", leave=True)
    return STAGES[-1][1](spark, docs, sf_dir)
