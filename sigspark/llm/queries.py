"""The queries of this subpackage, each over its whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, work_dir
from .op01_quality import quality
from .op02_substrings import passages
from .op03_token_counts import token_counts
from .op04_lines import dedup_lines
from .op05_token_files import read_dataset, write_dataset
from .op06_lm import score
from .op07_topk import top_k
from .op08_packing import pack
from .op09_mixing import schedule
from .op10_simhash import near_duplicates
from .op11_whitening import whiten
from .op12_secrets import find_secrets
from .op13_clusters import cluster
from .oracles import ORACLE_SQL


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "token-files")
    write_dataset(table(spark, sf_dir, "documents"), tokenizer(), out)
    return read_dataset(spark, out)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_live", "n_copied", F.sha2("base", 256).alias("base_sha256"), "spans")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


__all__ = ["ORACLE_SQL", "QUERIES", "tokenizer"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_files": op5_token_files,
    "op6_lm_scores": op6_lm_scores,
    "op7_top_k": op7_top_k,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_secret_scan": op12_secret_scan,
    "op13_centroid_clusters": op13_centroid_clusters,
}
