"""A training-data pipeline of the operators in ``emberlog.llm``.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next stage's
docs.  All but the last return the columns of ``documents``.

1. toxicity: documents that the grammar rejects go; the grammar learns from ``labels`` (doc_id, toxic) in ``sf_dir``.
2. near_dedup: of each SimHash component one row stays, the one with the least doc_id (a row without one only where all are);
   each row is a document of its own, so rows that share a doc_id but differ in text do not replace each other.
3. secrets: documents stay, every secret found in them is replaced by ``[SECRET]``.
4. mixing: each document is repeated as often as the mix takes it, or goes; targets are those of the mixing operator.
5. packing: documents become pieces with their places in sequences.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import mixing, packing, secrets_crf, simhash, toxicity
from emberlog.llm.common import checkpoint_dir, count_words


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; a null text is never toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    return secrets_crf.masked(docs, secrets_crf.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", count_words(F.col("text")).alias("size"))  # so no name can clash
    mixed = mixing.mix(rows).where(F.col("copies") > 0)
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2,048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashes, tokens and trained models have no form in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def delete(spark: SparkSession, path: str) -> None:
    """Delete a stored stage, on whatever file system it lies."""
    stored = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored.getFileSystem(spark._jsc.hadoopConfiguration()).delete(stored, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what a stage returns is stored in the shared checkpoint folder until the next one is."""
    checkpoint_dir(spark)
    folder = posixpath.join(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = posixpath.join(folder, f"{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            delete(spark, posixpath.join(folder, f"{k - 1}-{STAGES[k - 1][0]}"))
    return docs
