"""From raw messages to (message, symbol) rows on trading dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import after_close, eastern, half_hour, session_group
from ..operators.guards import first_by


def tagged(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("sentiment").isin("Bullish", "Bearish"))


def with_time_parts(messages: DataFrame) -> DataFrame:
    """Adds local (New York), hour, session (HHMM of the half hour) and is_after_hours."""
    local = messages.withColumn("local", eastern(F.col("created_at")))
    return local.withColumns({"hour": F.hour("local"), "session": half_hour(F.col("local")), "is_after_hours": after_close(F.col("local"))})


def route(timed: DataFrame, closes: DataFrame) -> DataFrame:
    """Assign trading dates: the day's first close, or the second after 16:00 on a business day.

    Messages without a date (outside the calendar) go. The calendar has one row a day and is sent to all tasks.
    """
    cal = F.broadcast(closes.withColumnRenamed("date", "local_date"))
    joined = timed.withColumn("local_date", F.col("local").cast("date")).join(cal, "local_date", "left")
    date = F.when(F.col("business_day") & F.col("is_after_hours"), F.col("second_close")).otherwise(F.col("first_close"))
    weekend = F.weekday("local_date") >= 5
    flags = {"date": date, "is_weekend": weekend, "is_holiday": ~F.col("business_day") & ~weekend}
    return joined.withColumns(flags).where(F.col("date").isNotNull()).drop("first_close", "second_close")


def per_symbol(messages: DataFrame, symbols: str = "symbols") -> DataFrame:
    """One row for each message and symbol, upper-cased; messages without symbols go."""
    return messages.withColumn("symbol", F.explode(symbols)).withColumn("symbol", F.upper("symbol")).drop(symbols)


def stock_messages(messages: DataFrame, closes: DataFrame) -> DataFrame:
    """Tagged, deduplicated messages on trading dates, one row per symbol."""
    return per_symbol(route(with_time_parts(tagged(messages)), closes))


def deduplicated(messages: DataFrame) -> DataFrame:
    return first_by(messages, ["message_id"], ["created_at", "user_id"])


def grouped_sessions(rows: DataFrame) -> Column:
    return session_group(F.col("session"), F.col("business_day"), F.col("is_weekend"), F.col("is_holiday"))


def matched(rows: DataFrame, market: DataFrame) -> DataFrame:
    """(message, symbol) rows with their stock-day; of two stocks of one ticker and day the lesser permno counts."""
    stocks = first_by(market.withColumn("symbol", F.upper("ticker")), ["symbol", "date"], ["permno"])
    return rows.join(stocks, ["symbol", "date"])


def unmatched_symbols(rows: DataFrame, market: DataFrame) -> DataFrame:
    return rows.select("symbol").distinct().join(market.select(F.upper("ticker").alias("symbol")).distinct(), "symbol", "left_anti")


def any_match(messages: DataFrame, universe: DataFrame, symbols: str = "symbols") -> DataFrame:
    """Per message: whether any of its (symbol, date) pairs is in the universe."""
    pairs = messages.select("message_id", "date", F.explode(symbols).alias("symbol"))
    hits = pairs.join(universe.select("symbol", "date").distinct().withColumn("hit", F.lit(True)), ["symbol", "date"], "left")
    return hits.groupBy("message_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("matched"))
