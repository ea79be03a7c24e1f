"""Checks of keys, and deduplication with a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bad_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are null or occur more than once, with their number of rows."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) | missing)


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df`` itself if its keys are unique and non-null; an action, meant for the edges of a plan."""
    if not bad_keys(df, keys).isEmpty():
        raise ValueError(f"{what} keys must be non-null and unique: {', '.join(keys)}")
    return df


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key, the first in an explicit order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def head_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each key; the filter on row_number limits groups before they are sorted whole."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__nth")


def align(panel: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("date", "permno"), check: bool = True) -> DataFrame:
    """``panel`` with a prediction column, null where there is none; keys must be unique on both sides."""
    if check:
        require_unique(panel, keys, "panel")
        require_unique(predictions, keys, "prediction")
    return panel.join(predictions.select(*keys, "prediction"), list(keys), "left")


def one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    if check:
        require_unique(a, keys, "left")
        require_unique(b, keys, "right")
    return a.join(b, list(keys))


def merge_families(*families: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Full outer chain; of columns that several families have, the first family's stays."""
    out = families[0]
    for f in families[1:]:
        new = [c for c in f.columns if c in keys or c not in out.columns]
        out = out.join(f.select(*new), list(keys), "full_outer")
    return out


def common_sample(long: DataFrame, n_models: int, keys: Sequence[str] = ("date", "permno"), value: str = "prediction") -> DataFrame:
    """Rows of keys for which every model has a value: one aggregation and a semi-join."""
    whole = long.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count_distinct("model_id").alias("__n")).where(F.col("__n") == n_models)
    return long.join(whole.select(*keys), list(keys), "left_semi")
