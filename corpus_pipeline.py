"""The corpus pipeline: what a training run reads, from raw documents, in stages that each work on all their predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm.common import scratch
from tidewheel.llm.exact_dedup import unique_documents
from tidewheel.llm.mixing import mixed_documents
from tidewheel.llm.near_join import distinct_documents
from tidewheel.llm.packing import packed_documents
from tidewheel.llm.toxicity import clean_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, learned from the labels of those that are left in docs, does not call toxic.

    Null and empty texts score the bias and stay unless most labels are toxic; repeated rows fare alike; without usable
    labels the score is one for all and below a half, so that all stay. An empty table stays empty."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the one with the largest doc_id, null ids being below all others; null text is the empty text.

    Rows repeated under one id and text stay once. An empty table stays empty."""
    return unique_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.8 or more lead to, the one with the smallest doc_id; of different
    texts under one id the one with the smaller hash.

    Null, empty and blank texts link to nothing and stay, as do rows without an id; texts of fewer than five words are one
    shingle; rows repeated under one id and text stay together. An empty table stays empty."""
    return distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them, at most three times.

    Null source is a source of its own; texts without words, null ones included, stay once; rows repeated under one id,
    text and source share their copies evenly. An empty table stays empty."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences; (doc_id, copy, piece) tells rows apart.

    Null and empty texts are the end id alone; rows of one id, as the mix repeats them, are copies 1, 2, 3; a null id stays
    null. An empty table packs to nothing."""
    return packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but exact dedup can be said in SQL: a trained model, similarity components, knapsack fits and packings.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
