"""Messages, market and forecasts in the shape the plans expect, made from the star tables at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .calendar import calendar_days, sessions, with_closes

FIRST, LAST = "2024-01-01", "2024-02-09"
HOLIDAYS = ("2024-01-01", "2024-01-15")


def _cents(column: str) -> Column:
    """Sum of an amount in hundredths, a whole number: the same in whatever order it is added up."""
    return F.sum(F.round(F.col(column) * 100).cast("long"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_id, user_id, created_at (UTC), sentiment, symbols: purchases and signups are bullish, errors bearish."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    mood = F.when(F.col("event_type").isin("purchase", "signup"), "Bullish").when(F.col("event_type") == "error", "Bearish")
    one, two = F.concat(F.lit("S"), (k % 20).cast("string")), F.concat(F.lit("S"), ((k + 7) % 20).cast("string"))
    symbols = F.when(k % 5 == 0, F.array(one, two)).otherwise(F.array(one))
    return e.select(F.col("event_id").alias("message_id"), "user_id", F.col("ts").cast("timestamp_ntz").alias("created_at"), mood.alias("sentiment"), symbols.alias("symbols"))


def closes(spark: SparkSession) -> DataFrame:
    return with_closes(calendar_days(spark, FIRST, LAST, HOLIDAYS))


def trading_days(spark: SparkSession) -> DataFrame:
    return sessions(calendar_days(spark, FIRST, LAST, HOLIDAYS))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """permno, ticker, date, prc, vol, shrout, ret: suppliers as stocks, their shipped items as trades."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = items.groupBy(F.col("l_suppkey").alias("permno"), F.col("l_shipdate").cast("date").alias("date")).agg((F.floor(_cents("l_extendedprice") / F.sum("l_quantity")) / 100.0).alias("prc"), F.sum("l_quantity").alias("vol"))
    named = day.withColumn("ticker", F.concat(F.lit("S"), (F.col("permno") % 20).cast("string"))).withColumn("shrout", (F.col("permno") % 7 + 1) * 100.0)
    before = F.lag("prc").over(Window.partitionBy("permno").orderBy("date"))
    return named.withColumn("ret", F.col("prc") / before - 1)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, permno, signal (heavily tied), y, cap for evaluation; months of ship dates as cross-sections."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("date"), F.col("l_suppkey").alias("permno")).agg(
        F.max("l_discount").alias("signal"), (F.floor(_cents("l_tax") * 100 / F.count("*")) / 10000.0 - 0.04).alias("y"), F.sum("l_quantity").alias("cap"), F.count("*").alias("n_items"), F.min("l_discount").alias("other")
    )


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, permno, signal, y, cap, n_items, other as in ``panel``, with days of ship dates as sessions; the label of a stock with one item is unknown."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("permno")).agg(
        F.max("l_discount").alias("signal"), F.when(F.max("l_linenumber") > 1, F.floor(_cents("l_tax") * 100 / F.count("*")) / 10000.0 - 0.04).alias("y"), F.sum("l_quantity").alias("cap"), F.max("l_linenumber").alias("n_items"), F.min("l_partkey").alias("other")
    )


#: Whole numbers of a supplier's items of a month (or day); the last is missing where nothing came back.
CHARACTERISTICS = {
    "c01": "count(*)", "c02": "sum(cast(l_quantity as bigint))", "c03": "max(cast(l_quantity as bigint))", "c04": "min(cast(l_quantity as bigint))", "c05": "sum(cast(round(l_extendedprice * 100) as bigint))", "c06": "max(cast(round(l_extendedprice * 100) as bigint))",
    "c07": "min(cast(round(l_extendedprice * 100) as bigint))", "c08": "sum(cast(round(l_discount * 100) as bigint))", "c09": "max(cast(round(l_discount * 100) as bigint))", "c10": "min(cast(round(l_discount * 100) as bigint))", "c11": "sum(l_partkey)", "c12": "max(l_orderkey)",
    "c13": "min(l_orderkey)", "c14": "count(*) filter (where l_returnflag = 'R')", "c15": "count(*) filter (where l_linestatus = 'O')", "c16": "max(l_linenumber)", "c17": "max(l_partkey) filter (where l_returnflag = 'R')",
    "s1": "count(*) filter (where l_returnflag = 'A') - count(*) filter (where l_returnflag = 'N')", "s2": "max(l_partkey)", "tax": "max(cast(round(l_tax * 100) as bigint))",
}


def characteristics(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """date (first of the ``unit``: MONTH or DAY), permno, seventeen controls, two social inputs and tax.

    A stock seldom has two items on a day, so items of days move once, to their date's place in order: sums by stock, and ranks by date
    after them, need no exchange of their own. Items of months are summed before they move.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({"date": F.date_trunc(unit, "l_shipdate").cast("date"), "permno": F.col("l_suppkey")})
    used = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    items = items.select("date", "permno", *used)
    return (items.repartitionByRange("date") if unit == "DAY" else items).groupBy("date", "permno").agg(*(F.expr(e).alias(c) for c, e in CHARACTERISTICS.items()))


def with_vector_ids(day: DataFrame) -> DataFrame:
    """Rows with the ``vec_id`` of the row of ``embeddings`` that is theirs."""
    return day.withColumn("vec_id", (F.col("permno") * 37 + F.datediff("date", F.lit("1990-01-01").cast("date"))) % 500)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v: the rows of ``embeddings`` that may be met. Only ids below 500 are, so these rows may be sent out."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id between -499 and 499").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def with_vectors(day: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the vector ``v`` of one row of ``embeddings``."""
    return with_vector_ids(day).join(F.broadcast(vectors(spark, sf_dir)), "vec_id", "left").drop("vec_id")


def stock_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """permno, ticker, date, prc, cap on the sessions of the messages; tickers S0 to S9 have two stocks."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = items.groupBy((F.col("l_suppkey") % 30).alias("permno"), (F.col("l_partkey") % 28).cast("int").alias("code")).agg((F.floor(_cents("l_extendedprice") / F.count("*")) / 100.0).alias("prc"), F.sum("l_quantity").alias("cap"))
    return days.join(F.broadcast(trading_days(spark)), "code").select("permno", F.concat(F.lit("S"), (F.col("permno") % 20).cast("string")).alias("ticker"), "date", "prc", "cap")


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, permno, model_id, prediction, y, cap: three models on the panel, one tied, one constant in some months."""
    p = panel(spark, sf_dir)
    m2 = F.round(F.col("cap") * 0.01 + F.col("other"), 4)
    m3 = F.when(F.month("date") % 3 == 0, 1.0).otherwise(F.col("signal") - F.col("other"))
    models = F.array(*(F.struct(F.lit(n).alias("model_id"), F.round(v.cast("double"), 6).alias("prediction")) for n, v in (("a", F.col("signal")), ("b", m2), ("c", m3))))
    return p.select("date", "permno", "y", "cap", F.explode(models).alias("m")).select("date", "permno", "m.model_id", "m.prediction", "y", "cap")
