"""As-of joins as windows over a union: one shuffle by key, no nested loop, no Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], exact: bool = True) -> DataFrame:
    """Each left row with the values of the last right row at or before it (before it, unless ``exact``).

    Of right rows with one time, the one with the greatest values counts.
    """
    packed = F.struct(*(F.col(v) for v in values))
    rows = left.select(*(F.col(c) for c in left.columns), F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("__values"), F.lit(1 if exact else -1).alias("__side"))
    facts = right.select(*(F.col(c) if c in (*by, on) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), packed.alias("__values"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*by).orderBy(on, "__side", "__values").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.unionByName(facts).withColumn("__last", F.last("__values", ignorenulls=True).over(w))
    return seen.where("__side != 0").select(*left.columns, *(F.col(f"__last.{v}").alias(v) for v in values))


def count_before(df: DataFrame, by: Sequence[str], day: str, flag: str, name: str) -> DataFrame:
    """Flags of the key on earlier days, today's excluded: a range frame on the day number."""
    w = Window.partitionBy(*by).orderBy(F.datediff(day, F.lit("1970-01-01"))).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(flag).over(w), F.lit(0)))
