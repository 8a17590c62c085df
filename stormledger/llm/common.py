"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, shared_dir, spread  # noqa: F401

#: What separates words in every contract of this subpackage (Java and Python regex alike).
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The runs of non-blank characters of a text, in order.

    Splitting at one plain space is several times as fast as splitting at a pattern.
    """
    for blank in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def ascii_lower(text: Column) -> Column:
    """A-Z only. ``lower`` is much faster than ``translate`` and agrees on pure ASCII."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the label folds of the classifiers."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus
