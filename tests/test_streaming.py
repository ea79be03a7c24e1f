"""Streams against the batch plans on the same messages."""

import pytest
from pyspark.sql import functions as F

from sigspark.plans import messages as m
from sigspark.sources import stand_in
from sigspark.streaming.stock_day import daily_sentiment, user_flips

from conftest import TINY


@pytest.fixture()
def source(spark, tmp_path):
    all_ = stand_in.messages(spark, TINY).withColumn("created_at", F.col("created_at").cast("timestamp"))
    days = sorted(r[0] for r in all_.select(F.to_date("created_at")).distinct().collect())
    return all_, days, str(tmp_path / "in")


def feed(spark, source, plan, name):
    all_, days, path = source
    all_.limit(0).write.parquet(path)
    stream = spark.readStream.schema(all_.schema).parquet(path)
    query = plan(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for part in (days[:8], days[8:20], days[20:]):
            all_.where(F.to_date("created_at").isin(part)).coalesce(1).write.mode("append").parquet(path)
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def test_closed_days_equal_the_batch(spark, source):
    rows = feed(spark, source, lambda s: daily_sentiment(s, stand_in.closes(spark)), "daily")
    batch = m.stock_messages(stand_in.messages(spark, TINY), stand_in.closes(spark))
    want = {(r.symbol, r.date, r.day): (r.a, r.b) for r in batch.groupBy("symbol", "date", F.to_date("created_at").alias("day")).agg(F.count_if(F.col("sentiment") == "Bullish").alias("a"), F.count_if(F.col("sentiment") == "Bearish").alias("b")).collect()}
    got = {(r.symbol, r.date, r.day.date()): (r.n_bullish, r.n_bearish) for r in rows}
    assert len(got) == len(rows) > 100 and all(want[k] == v for k, v in got.items())


def test_user_flips_carry_state_across_batches(spark, source):
    plan = lambda s: user_flips(m.per_symbol(m.tagged(s)).select("user_id", "symbol", "created_at", "sentiment"))
    got = sorted((r.user_id, r.symbol, r.created_at, r.direction) for r in feed(spark, source, plan, "flips"))
    rows = m.per_symbol(m.tagged(source[0])).select("user_id", "symbol", "created_at", "sentiment").orderBy("created_at", "sentiment").collect()
    last, want = {}, []
    for r in rows:
        d = 1 if r.sentiment == "Bullish" else -1
        if last.get((r.user_id, r.symbol), d) != d:
            want.append((r.user_id, r.symbol, r.created_at, d))
        last[r.user_id, r.symbol] = d
    assert got == sorted(want) and got
