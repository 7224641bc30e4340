"""A training corpus from documents: junk out, copies out, near copies out, sources mixed, sequences packed.

Every stage takes the documents that the stage before it left, as Parquet, and all but the last return documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import exact_dedup, jaccard_join, mixing, packing, quality
from lectern.llm.common import discard, staged
from lectern.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more stay."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), least=0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles, the one with the least doc_id stays."""
    return jaccard_join.one_of_each(docs, n=5, share=80, of=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, twice as often as the largest at most; no document is dropped."""
    return mixing.mixed(docs, budget_share=None, repeats=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, their ids and their places in sequences of 2048."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Neither the classifier nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        following = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
