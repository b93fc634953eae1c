"""Corpus preparation in five stages over `documents`.

Each stage takes the rows that its predecessor kept, as a table read from Parquet.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import blobs, bpe, minhash, posindex, ppm
from tidewater.llm.common import stored

RANKS = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, whose language no model explains best by far, or that cost more bits than their language allows, go."""
    return ppm.keep_identified(docs, ppm.learn(docs.filter(~ppm.held_out("doc_id"))))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash fingerprints within two bits, or by a five-word Jaccard of 0.8 or more, the document with the smallest doc_id stays."""
    return minhash.one_of_each(docs, words=5, least=0.8, radius=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return posindex.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; the documents stay."""
    ledger = blobs.Ledger(spark)
    ledger.update(docs)
    return blobs.redact(docs, ledger)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their count, and digests of the ids and of the decoded bytes."""
    path = public_tokenizers.path(RANKS)
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, with_decoded=True, with_text=True)
    return bpe.digests(encoded, extra=["ids"])


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("tokenize", tokenize),
]

#: Trained, iterative and tokenising stages; SQL can't express them. tests/llm/test_pipeline.py
#: holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
