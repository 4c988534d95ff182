"""A corpus pipeline of chained stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept and returns the
columns of documents; the last adds what the mix takes.  Between stages the rows are written as Parquet
to the shared scratch folder and read again, so a lost executor costs the running stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlode.llm import decontaminate, mixing, pii, quality_model, simhash
from memlode.session import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the least id."""
    return simhash.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced or removed; every document stays."""
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document with its size, its source's size and target and the words taken; untaken ones go."""
    return mixing.mix(docs).where(F.col("mix_taken") > 0)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("benchmark_free", benchmark_free),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: The classifier and MinHash stages have no SQL form; a test holds run() against plain Python, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch.scope() as last:  # what a stage keeps for itself goes with it, and so does its input
            done = last(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
