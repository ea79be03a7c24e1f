"""Trading calendars: one row per calendar day with its first and second close."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import back_fill


def calendar_days(spark: SparkSession, first: str, last: str, holidays: Sequence[str] = ()) -> DataFrame:
    """date and business_day for every day from ``first`` to ``last``."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    return days.withColumn("business_day", (F.weekday("date") < 5) & ~F.col("date").cast("string").isin(list(holidays)))


def with_closes(days: DataFrame) -> DataFrame:
    """Adds first_close (the first session at or after the day) and second_close (the session after that)."""
    sessions = days.where("business_day").select(F.col("date").alias("session_date"))
    following = sessions.withColumn("next", F.lead("session_date").over(_by("session_date")))
    joined = days.join(following, days["date"] == following["session_date"], "left")
    return joined.select("date", "business_day", back_fill(F.col("session_date"), "date").alias("first_close"), back_fill(F.col("next"), "date").alias("second_close"))


def _by(order: str):
    from pyspark.sql import Window

    return Window.orderBy(order)


def sessions(days: DataFrame) -> DataFrame:
    """The sessions of a calendar, numbered from 0."""
    from pyspark.sql import Window

    return days.where("business_day").select("date").withColumn("code", F.row_number().over(Window.orderBy("date")) - 1)
