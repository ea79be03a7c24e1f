"""Time-series regressions and their tables: Spark takes the sums over rows, the driver solves k equations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

# Stars at these levels.
STARS = ((0.01, "***"), (0.05, "**"), (0.10, "*"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``nth``, their place in the order of ``at`` over all range-sorted parts, from 1; ties go by the other columns."""
    order = ["at", *(c for c in rows.columns if c != "at")]
    parts = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "series")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("inside", inside).join(offsets, "part").withColumn("nth", F.col("before") + F.col("inside"))


def factor_regression(series: DataFrame, ret: str, factors: Sequence[str], lags: int = 5, order: str = "date") -> DataFrame:
    """term, beta, se, t, p and n of a return series on a constant and factors.

    Bartlett standard errors with the n / (n - k) correction. Rows with a missing value are left out first, and
    those beside them become neighbours. A series no longer than its terms has no row.
    """
    terms = ("alpha", *factors)
    xs, ss = ([f"{c}{i}" for i in range(len(terms))] for c in "xs")
    data = [F.col(ret).cast("double").alias("y"), *(F.col(c).cast("double").alias(x) for c, x in zip(factors, xs[1:], strict=True))]
    rows = _numbered(series.select(F.col(order).alias("at"), *data).na.drop()).withColumn(xs[0], F.lit(1.0))
    products = [F.sum(F.col(a) * F.col(b)) for a in xs for b in (*xs, "y")]
    n, *sums = rows.agg(F.count("*"), *products).first()
    if n <= len(terms):
        return series.sparkSession.createDataFrame([], "term string, beta double, se double, t double, p double, n long")
    known = np.array(sums, float).reshape(len(xs), -1)
    inverse = np.linalg.pinv(known[:, :-1])
    beta = inverse @ known[:, -1]
    error = F.col("y") - sum(F.lit(float(b)) * F.col(x) for b, x in zip(beta, xs, strict=True))
    scores = rows.withColumn("e", error).select("nth", *((F.col("e") * F.col(x)).alias(s) for x, s in zip(xs, ss, strict=True)))
    lagged = scores.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).select((F.col("nth") + F.col("lag")).alias("nth"), "lag", *(F.col(s).alias(f"past_{s}") for s in ss))
    share = F.when(F.col("lag") == 0, 0.5).otherwise(1 - F.col("lag") / (lags + 1))  # half, as the transpose is added
    half = scores.join(lagged, "nth").agg(*(F.sum(share * F.col(a) * F.col(f"past_{b}")) for a in ss for b in ss)).first()
    meat = np.array(half, float).reshape(len(ss), -1)
    meat = (meat + meat.T) * n / (n - len(terms))
    se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0.0))
    out = [(name, float(b), float(e), float(b / e) if e else None, math.erfc(abs(b / e) / math.sqrt(2)) if e else None, n) for name, b, e in zip(terms, beta, se, strict=True)]
    return series.sparkSession.createDataFrame(out, "term string, beta double, se double, t double, p double, n long")


def starred(value: Column, p: Column | None = None, digits: int = 3) -> Column:
    """The number with its stars; empty for null."""
    stars = F.lit("")
    for level, s in reversed(STARS) if p is not None else ():
        stars = F.when(p < level, s).otherwise(stars)
    return F.when(value.isNull(), "").otherwise(F.concat(F.format_string(f"%.{digits}f", value), stars))


def latex_rows(rows: DataFrame, label: str, value: str, error: str, p: str) -> DataFrame:
    """line: two for each row, in the order of labels: the estimate with its stars, and its error in brackets below."""
    lines = F.array(
        F.concat(F.col(label), F.lit(" & "), starred(F.col(value), F.col(p)), F.lit(" \\\\")),
        F.concat(F.lit(" & ("), starred(F.col(error)), F.lit(") \\\\")),
    )
    return rows.select(label, F.posexplode(lines).alias("pos", "line")).orderBy(label, "pos").select("line")
