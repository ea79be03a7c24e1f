"""Documents from raw to packed: quality rules, line dedup, near-duplicates, mixing, packing.

Each stage works on all that the one before it kept; what a stage returns is written as Parquet in the
shared folder and read again, so that a lost executor costs no more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.common import materialize, table
from sigspark.llm.op01_quality import accepted
from sigspark.llm.op04_lines import dedup_lines
from sigspark.llm.op08_packing import pack
from sigspark.llm.op09_mixing import mixture
from sigspark.llm.op10_simhash import representatives
from sigspark.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated lines; n_chars, where there is one, follows the text."""
    lines = dedup_lines(docs, counts=None)
    if "n_chars" in docs.columns:
        lines = lines.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return lines.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order."""
    return mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in training sequences."""
    return pack(docs, tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Tokens and SimHash are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
