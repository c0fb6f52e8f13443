"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, piece encoding. Each stage
is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import op2_pieces, op5_mixing, op7_quality, op9_ngrams, op10_lines
from docquarry.llm.common import read_table, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    return op7_quality.kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the lines that many of them share."""
    return op10_lines.kept_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return op9_ngrams.first_documents(docs, 5, 80, 100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return op5_mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's text."""
    return op2_pieces.encoded(docs, ["doc_id", "lang", "source"])


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near), ("mixing", mixing), ("pieces", pieces)]

#: Perplexity, entropy balancing and merging are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
