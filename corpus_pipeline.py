"""The corpus pipeline: raw documents to token shards, each stage written as Parquet and read again by the next.

Toxic documents go, near-duplicates keep one of each group, contaminated documents go, sources are mixed to their target
weights, and what is left is tokenised in training order. Every stage works on all rows of the stage before it.

All stages take null, empty and very long texts, null and repeated doc_ids, equal rows, empty tables and further columns
of any names, and go by the rules that their operators tell: a null or empty text is never toxic nor contaminated, all
such texts are one group of near-duplicates, mixing counts no words in them, and each is one end mark in the shards. Of
rows tied in doc_id the text of the least hash is the one that stands for a group. The columns of ``documents`` stay as
they are up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakescreen.llm import decontam, mixing, simhash, tokenbin, toxicity
from lakescreen.llm.common import remove_at_exit, shared_dir, spread, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a model of this corpus' labels."""
    return toxicity.drop_toxic(spread(docs), toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates_out(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """One document of each group, that of the least doc_id."""
    return simhash.drop_near_duplicates(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which hit words are less than one in twenty."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs)


def token_shards(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Sequences in training order; their ids are in the shards."""
    return tokenbin.sharded(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("decontamination", contaminated_out),
    ("mixing", mixed),
    ("token_binary", token_shards),
]

#: A trained model and a byte-pair encoding are not for SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``. What the stages have written is removed when the driver ends, shards aside."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, base)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
