"""Scans and sinks, each as a round trip through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import messages as m
from ..sources import leases, records, stand_in, tables
from ..sources.scratch import scratch_path
from .features import tidy
from .prelude import MARKET, MESSAGES, PANEL, query, r6
from .relational import read


def s2_csv_scan(spark, sf_dir):
    """Some columns of CSV files; lines that do not fit the schema are skipped."""
    path = scratch_path(spark, "csv")
    read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").write.option("header", True).csv(path)
    read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal").write.mode("append").option("header", True).csv(path)
    return tables.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey long, c_acctbal double", ["c_custkey", "c_acctbal"]).where("c_custkey is not null")


def s3_s9_years(spark, sf_dir):
    """A sink by year, read back for two of the years."""
    path = scratch_path(spark, "years")
    tables.write_by_year(stand_in.market(spark, sf_dir), path)
    return tidy(tables.read_years(spark, path, [1996, 1999]).groupBy("year").agg(F.count("*").alias("n"), F.sum("vol").alias("vol")))


def s4_records(spark, sf_dir):
    """Multi-line records with quotes, parsed from text files."""
    path = scratch_path(spark, "records")
    quoted = F.concat(F.lit('"'), F.replace(F.trim("text"), F.lit('"'), F.lit('""')), F.lit('"'))
    read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn") + 100000).alias("id"), "text").select(F.concat(F.col("id").cast("string"), F.lit(","), quoted)).write.text(path)
    parsed = records.read_records(spark, path)
    return parsed.select("message_id", F.md5("message_body").alias("body"))


def s10_append_routed(spark, sf_dir):
    """Batches appended by year, each once however often it is offered."""
    path = scratch_path(spark, "routed")
    p = stand_in.panel(spark, sf_dir).select("date", "permno", "y")
    for batch in ("0", "1", "0", "1"):
        tables.append_routed(p.where(F.col("permno") % 2 == int(batch)), path, batch)
    back = spark.read.option("basePath", path).parquet(f"{path}/year=*")
    return tidy(back.groupBy("year").agg(F.count("*").alias("n"), F.sum("y").alias("y")))


def s11_leased_years(spark, sf_dir):
    """Years of the panel written under a lease, with one left half-written by a run that died; a second run goes on from there."""
    path = scratch_path(spark, "leased")
    p = stand_in.panel(spark, sf_dir).select("date", "permno", "y")
    first = leases.Lease(spark, path)
    leases.copy_by_month(p.where(F.year("date") < 1998), path, first, unit="yyyy")
    p.where("year(date) = 1998").limit(5).write.parquet(f"{path}/rows/month=1998/lease={first.number}")
    first.release()
    leases.copy_by_month(p, path, leases.Lease(spark, path), unit="yyyy")
    back = leases.read_months(spark, path, "date date, permno long, y double")
    return tidy(back.groupBy(F.col("month").cast("long").alias("year")).agg(F.count("*").alias("n"), F.sum("y").alias("y")))


def s6_factors(spark, sf_dir):
    """Percent factor returns as decimals."""
    path = scratch_path(spark, "factors")
    days = stand_in.panel(spark, sf_dir).groupBy("date").agg(F.sum("n_items").alias("n"))
    days.select(F.date_format("date", "yyyyMMdd").alias("Date"), (F.col("n") % 7).alias("Mkt-RF"), (F.col("n") % 5).alias("SMB")).unionByName(spark.sql("select 'Copyright' as Date, 0L as `Mkt-RF`, 0L as SMB")).write.option("header", True).csv(path)
    return tidy(tables.read_factors(spark, path, ("Mkt-RF", "SMB")).withColumnRenamed("Mkt-RF", "mkt"))


def s8_bundle(spark, sf_dir):
    """A prepared panel written, checked against its manifest and read."""
    path = scratch_path(spark, "bundle")
    p = stand_in.panel(spark, sf_dir).withColumn("code", F.month("date"))
    tables.write_bundle(p, path, ["signal", "cap"], ["y"])
    rows, manifest = tables.load_bundle(spark, path)
    return tidy(rows.groupBy("code").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(F.element_at("features", 2).cast("double")).alias("cap")))


def registry_sizes(spark, sf_dir):
    from ..plans.registry import sizes

    return sizes(spark)


def p5_cleaned_messages(spark, sf_dir):
    """Duplicates by message id go, the earliest stays."""
    msgs = stand_in.messages(spark, sf_dir)
    return m.deduplicated(msgs.unionByName(msgs.where("sentiment = 'Bearish'"))).select("message_id", "user_id")


QUERIES = {
    "s2_csv_scan": (s2_csv_scan, "SELECT c_custkey, c_acctbal FROM customer"),
    "s3_s9_years": (s3_s9_years, query(MARKET, f"SELECT CAST(year(date) AS BIGINT) AS year, count(*) AS n, {r6('sum(vol)')} AS vol FROM market WHERE year(date) IN (1996, 1999) GROUP BY 1")),
    "s4_records": (s4_records, "SELECT conv_id * 100 + turn + 100000 AS message_id, md5(trim(text)) AS body FROM conversations"),
    "s10_append_routed": (s10_append_routed, query(PANEL, f"SELECT year(date) AS year, count(*) AS n, {r6('sum(y)')} AS y FROM panel GROUP BY 1")),
    "s11_leased_years": (s11_leased_years, query(PANEL, f"SELECT year(date) AS year, count(*) AS n, {r6('sum(y)')} AS y FROM panel GROUP BY 1")),
    "s6_factors": (s6_factors, query(PANEL, f"SELECT date, {r6('sum(n_items) % 7 / 100')} AS mkt, {r6('sum(n_items) % 5 / 100')} AS SMB FROM panel GROUP BY date")),
    "s8_bundle": (s8_bundle, query(PANEL, f"SELECT month(date) AS code, count(*) AS n, {r6('sum(y)')} AS y, {r6('sum(cap)')} AS cap FROM panel GROUP BY 1")),
    "registry_sizes": (registry_sizes, "SELECT * FROM (VALUES ('linear', 96::BIGINT), ('characteristics', 264::BIGINT), ('design', 114::BIGINT), ('interactions', 148::BIGINT)) t(study, n_models)"),
    "p5_cleaned_messages": (p5_cleaned_messages, query(MESSAGES, "SELECT message_id, user_id FROM messages")),
}
