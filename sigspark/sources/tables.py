"""Scans with stated schemas, and sinks that can be repeated."""

from __future__ import annotations

import gzip
import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_SCHEMA = "message_id string, user_id long, created_at timestamp_ntz, sentiment string, symbol_list string, parent_message_id string, in_reply_to_message_id string"


def read_csv(spark: SparkSession, path: str | list[str], schema: str, columns: Sequence[str] | None = None, rows: int | None = None) -> DataFrame:
    """All CSV files below ``path``; lines that do not fit the schema are skipped. Other columns are not parsed."""
    df = spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").option("multiLine", False).csv(path)
    df = df.select(*columns) if columns else df
    return df.limit(rows) if rows is not None else df


def read_years(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """A table partitioned by year; a selection of years prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("year").isin(list(years))) if years is not None else df


def drop_bad_keys(df: DataFrame, key: str) -> DataFrame:
    """The key as long; rows whose key is no whole number go."""
    return df.withColumn(key, F.col(key).cast("string").try_cast("long")).where(F.col(key).isNotNull())


def write_by_year(df: DataFrame, path: str, date: str = "date", format: str = "parquet", mode: str = "overwrite") -> None:
    """One folder for each year of the date; overwriting replaces the years at hand and no others."""
    out = df.withColumn("year", F.year(date)).write.mode(mode).partitionBy("year")
    (out.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else out).format(format).save(path)


def append_routed(df: DataFrame, path: str, batch: str, date: str = "date") -> bool:
    """Append one source batch by year, once: a batch whose marker exists is not written again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_batches/{batch}")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(marker):
        return False
    # the batch has a folder of its own, so a run that died before its marker is replaced, not doubled
    df.withColumn("year", F.year(date)).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "batch").parquet(path)
    fs.create(marker).close()
    return True


def write_atomic(path: str, data: bytes) -> None:
    """A small local file, whole or not at all."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def write_json(path: str, value: object) -> None:
    write_atomic(path, json.dumps(value, indent=1, sort_keys=True, default=str).encode())


def write_gzip(path: str, data: bytes) -> None:
    """The same bytes give the same file."""
    write_atomic(path, gzip.compress(data, mtime=0))


def read_factors(spark: SparkSession, path: str, names: Sequence[str] = ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "Mom")) -> DataFrame:
    """Daily factor returns from CSV (date as yyyyMMdd, percent) as date and decimals; lines without a date go."""
    raw = spark.read.option("header", True).csv(path)
    day = F.try_to_timestamp(F.trim(raw.columns[0]), F.lit("yyyyMMdd")).cast("date")
    return raw.select(day.alias("date"), *((F.col(f"`{n}`").cast("double") / 100).alias(n) for n in names)).where("date is not null")


def write_bundle(panel: DataFrame, path: str, features: Sequence[str], targets: Sequence[str]) -> None:
    """A prepared panel in date order with one feature array, and a manifest of names and row count beside it."""
    rows = panel.select("code", "date", "permno", F.array(*(F.col(c).cast("float") for c in features)).alias("features"), *targets)
    rows.repartitionByRange("code").sortWithinPartitions("code", "permno").write.mode("overwrite").parquet(f"{path}/rows")
    spark = panel.sparkSession
    n = spark.read.parquet(f"{path}/rows").count()
    spark.createDataFrame([(list(features), list(targets), n)], "features array<string>, targets array<string>, n long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rows and the manifest of a bundle; a different number of rows or of features is an error."""
    manifest = spark.read.schema("features array<string>, targets array<string>, n long").json(f"{path}/manifest").first().asDict()
    rows = spark.read.parquet(f"{path}/rows")
    found = rows.agg(F.count("*").alias("n"), F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high")).first()
    if found["n"] != manifest["n"] or found["n"] and not found["low"] == found["high"] == len(manifest["features"]):
        raise ValueError(f"{path} does not hold what its manifest says: {found.asDict()}")
    return rows, manifest
