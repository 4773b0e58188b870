"""A corpus pipeline: quality, near duplicates, repeated passages, mixing, encoding.

Null, empty and very long texts, ties, repeated rows, empty tables and clashing columns are handled
as the operators' docstrings say: null and empty texts pass all stages but the mix, which does not
take documents without words. Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet in the
shared folder and read again as the next one's docs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silbenwerk.llm.common import Scratch, read_table
from silbenwerk.llm.jaccard_join import one_of_each
from silbenwerk.llm.mixing import mixed
from silbenwerk.llm.pieces import encode_copies
from silbenwerk.llm.quality import keep_good
from silbenwerk.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that occur elsewhere."""
    return without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every row, with digests and the check that decoding gives the text back.

    Rows that the mix took twice or three times are numbered, and each copy gets a sample of its own.
    """
    return encode_copies(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("pieces", pieces),
]

#: A trained classifier and sampled segmentations have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        scratch = Scratch(spark)
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        before = scratch
    return docs
