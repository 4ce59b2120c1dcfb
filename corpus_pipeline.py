"""From raw documents to token ids, in five stages; each is written as Parquet and read again by the next.

Defined results: a null text has no words and is rejected by the first stage, as is an empty one. Of rows with equal texts that with
the largest id stays, of similar texts that with the smallest; rows without an id rank as the operators' docstrings say.
Columns of any name are carried through to the last stage, which returns the ids of each document. Empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.llm import bpe, exact, mixing, near, quality
from snapdelta.llm.common import documents, tokenizer
from snapdelta.session import settled

# Documents that are left are drawn at most once.
MIX = mixing.Mix(budget_share=0.8, max_epochs=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of ``op3``, whose SQL the tests take for this stage."""
    return quality.accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last of equal texts."""
    return exact.survivors(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: words in fives, a similarity of 0.8 or more."""
    return near.kept_rows(docs, words=5)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights."""
    return mixing.mixed(docs, MIX)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes they decode to."""
    path, pattern = tokenizer()
    coded = bpe.decoded(bpe.encoded(docs, path, pattern), path)
    return coded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("source mixing", source_mixing),
    ("byte-level BPE", byte_bpe),
]

# SQL has neither near-duplicate components nor the encoder; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
