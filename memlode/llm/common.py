"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlode.session import table

#: White space that separates words: space and \t to \r, nothing else.
SPACES = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def words(text: Column) -> Column:
    """The words of a text as an array (null text: empty array)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id is in bucket 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)), F.lit(0)).cast("int")
