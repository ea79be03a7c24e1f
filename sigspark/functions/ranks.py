"""Ranks and bins within a cross-section. A missing value has no rank; it is null before and after."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _present(by: Sequence[str], value: str) -> list[Column]:
    # missing values form a partition of their own, so they neither take ranks nor count
    return [*(F.col(c) for c in by), F.col(value).isNull()]


def tie_interval(by: Sequence[str], value: str) -> tuple[Column, Column, Column]:
    """(left, right, n): tied values occupy (left, right] of the n ranks of their cross-section."""
    part = Window.partitionBy(*_present(by, value))
    left = F.rank().over(part.orderBy(value)) - 1
    ties = F.count("*").over(part.orderBy(value).rangeBetween(0, 0))  # the row's peers: the same sort serves, and no exchange by value
    n = F.count("*").over(part)
    return left, left + ties, n


def with_tie_interval(df: DataFrame, by: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    left, right, n = tie_interval(by, value)
    return df.withColumns({f"{prefix}left": left, f"{prefix}right": right, f"{prefix}n": n})


def average_rank(by: Sequence[str], value: str) -> Column:
    """Rank from 1; ties share the mean of theirs."""
    left, right, _ = tie_interval(by, value)
    return F.when(F.col(value).isNotNull(), (left + right + 1) / 2)


def centered_rank(by: Sequence[str], value: str, scale: float = 1.0) -> Column:
    """((rank - .5) / n - .5) * scale, null where missing."""
    left, right, n = tie_interval(by, value)
    return F.when(F.col(value).isNotNull(), ((left + right) / 2 / n - 0.5) * scale)


def centered_feature(by: Sequence[str], value: str) -> Column:
    """Centered rank from -1 to 1; missing is neutral."""
    return F.coalesce(centered_rank(by, value, 2.0), F.lit(0.0))


def centered_target(by: Sequence[str], value: str, least: int = 10) -> Column:
    """Centered rank of a target; null on dates of fewer than ``least`` values or of a single one."""
    part = Window.partitionBy(*_present(by, value))
    varied = (F.count(value).over(part) >= least) & (F.min(value).over(part) < F.max(value).over(part))
    return F.when(varied, centered_rank(by, value))


def percent_target(by: Sequence[str], value: str) -> Column:
    left, right, n = tie_interval(by, value)
    return F.when(F.col(value).isNotNull(), (left + right + 1) / 2 / n - 0.5)


def daily_rank(by: Sequence[str], value: str) -> Column:
    """2 (rank - 1) / (n - 1) - 1; 0 for a lone value, null stays null."""
    left, right, n = tie_interval(by, value)
    return F.when(F.col(value).isNotNull(), F.when(n > 1, (left + right - 1) / (n - 1) - 1).otherwise(0.0))


def demeaned(by: Sequence[str], value: str) -> Column:
    return F.col(value) - F.avg(value).over(Window.partitionBy(*by))


def terciles(by: Sequence[str], value: str) -> Column:
    """0, 1 or 2 by mid-rank, ties together; -1 where missing."""
    left, right, n = tie_interval(by, value)
    return F.when(F.col(value).isNull(), -1).otherwise(F.least(F.lit(2), F.floor((left + right) / 2 * 3 / n))).cast("int")


def _first_rank(by: Sequence[str], value: str, tie: Sequence[str]) -> tuple[Column, Column]:
    part = _present(by, value)
    return F.row_number().over(Window.partitionBy(*part).orderBy(value, *tie)), F.count("*").over(Window.partitionBy(*part))


def quantile_cut_of_ranks(by: Sequence[str], value: str, tie: Sequence[str], bins: int = 10) -> Column:
    """Equal-count cut of first-come ranks 1..n at linear quantiles of the ranks."""
    r, n = _first_rank(by, value, tie)
    place = F.round((r - 1) * bins / (n - 1), 9)
    return F.when(F.col(value).isNotNull(), F.when(n > 1, F.greatest(F.lit(1), F.ceil(place))).otherwise(1)).cast("int")


def ceiling_bins(by: Sequence[str], value: str, tie: Sequence[str], bins: int = 10) -> Column:
    """ceil(bins * rank / n) of first-come ranks."""
    r, n = _first_rank(by, value, tie)
    return F.when(F.col(value).isNotNull(), F.ceil(F.round(bins * r / n, 9))).cast("int")


def quantile_cut_of_values(df: DataFrame, by: Sequence[str], value: str, bins: int = 10, name: str = "bin") -> DataFrame:
    """Cut of raw values at their exact linear quantiles; equal edges are dropped, as are their bins."""
    edges = df.groupBy(*by).agg(F.percentile(value, F.array(*(F.lit(k / bins) for k in range(bins + 1)))).alias("edges"))
    joined = df.join(edges.withColumn("edges", F.array_distinct("edges")), list(by))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    number = F.size(F.filter(inner, lambda e: e < F.col(value))) + 1
    return joined.withColumn(name, F.when(F.col(value).isNotNull() & (F.size("edges") > 1), number).cast("int")).drop("edges")


def block_ranks(x: np.ndarray, absent: np.ndarray, scale: float, missing: float, least: int = 1, varied: bool = False) -> np.ndarray:
    """((rank - .5) / n - .5) * scale of one cross-section: ties share, NaN is one greatest value, absent ones are ``missing``;
    so are all where fewer than ``least`` are there, or (``varied``) all are the same."""
    out, at = np.full(len(x), missing), np.flatnonzero(~absent)
    n = len(at)
    if n < max(least, 1):
        return out
    order = np.argsort(x[at], kind="stable")
    ordered = x[at][order]
    new = np.append(True, (ordered[1:] != ordered[:-1]) & ~(np.isnan(ordered[1:]) & np.isnan(ordered[:-1])))
    begins = np.append(np.flatnonzero(new), n)
    if varied and len(begins) == 2:
        return out
    both = np.repeat(begins[:-1] + begins[1:], np.diff(begins))  # left + right of each tied block
    out[at[order]] = (both / 2 / n - 0.5) * scale
    return out


def with_ranks(df: DataFrame, by: str, features: Mapping[str, str], targets: Mapping[str, str] | None = None, least: int = 10) -> DataFrame:
    """Adds centered_feature of each column of ``features`` and centered_target of each of ``targets``, given as name -> column.

    Rows meet once, by ``by``, and each cross-section is ranked by all columns in its task. A window each would exchange, sort
    and spill whole rows as many times as there are columns.
    """
    menu = [(name, c, False) for name, c in features.items()] + [(name, c, True) for name, c in (targets or {}).items()]

    def rank(group: pa.Table) -> pa.Table:
        out = {c: group[c] for c in group.column_names}
        for name, c, target in menu:
            absent = group[c].is_null().to_numpy()
            x = group[c].fill_null(0).to_numpy()
            found = block_ranks(x, absent, 1.0, np.nan, least, True) if target else block_ranks(x, absent, 2.0, 0.0)
            out[name] = pa.array(found, mask=np.isnan(found))
        return pa.table(out)

    kinds = {c: kind for c, kind in df.dtypes} | {name: "double" for name, _, _ in menu}
    return df.groupBy(by).applyInArrow(rank, ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()))


def exact_quantiles(df: DataFrame, by: str, value: str, shares: Mapping[str, float], width: float = 1.0) -> DataFrame:
    """``by`` and a column for each of ``shares`` (name -> share): linear quantiles, exact; null where a group has no value.

    F.percentile keeps every distinct value of a group in one task. Here counts by bins of ``width`` tell which bin holds a wanted
    place, and values are counted in these bins alone, at most two a share; what moves grows with bins and groups, not with rows.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull()).select(F.col(by).alias("g"), x.alias("x"), F.when(F.isnan(x), x).otherwise(F.floor(x / width).cast("double")).alias("bin"))
    bins = rows.groupBy("g", "bin").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("bin"))
    placed = bins.select("g", "bin", (upto - F.col("n")).alias("before"), F.col("n"), F.sum("n").over(Window.partitionBy("g")).alias("all"))
    at = lambda q: F.lit(q) * (F.col("all") - 1)
    wanted = F.array_distinct(F.array(*(end(at(q)).cast("long") for q in shares.values() for end in (F.floor, F.ceil))))
    inside = lambda a: F.exists(wanted, lambda p: (p >= F.col(a)) & (p < F.col(a) + F.col("n")))
    few = placed.where(inside("before")).select(F.col("g").alias("h"), F.col("bin").alias("b"), "before", "all")  # at most two a share and group
    near = rows.join(F.broadcast(few), F.col("g").eqNullSafe(F.col("h")) & (F.col("bin") == F.col("b")))
    counted = near.groupBy("g", "bin", "x", "before", "all").agg(F.count("*").alias("n"))
    start = F.col("before") + F.sum("n").over(Window.partitionBy("g", "bin").orderBy("x")) - F.col("n")
    found = counted.withColumn("start", start)
    holds = lambda place: (place >= F.col("start")) & (place < F.col("start") + F.col("n"))
    ends = [F.max(F.when(holds(end(at(q))), F.col("x"))).alias(f"{side}_{name}") for name, q in shares.items() for side, end in (("low", F.floor), ("high", F.ceil))]
    least = found.groupBy("g").agg(F.max("all").alias("all"), *ends)
    between = {name: F.when(F.col(f"low_{name}") == F.col(f"high_{name}"), F.col(f"low_{name}")).otherwise(F.col(f"low_{name}") + (at(q) - F.floor(at(q))) * (F.col(f"high_{name}") - F.col(f"low_{name}"))) for name, q in shares.items()}
    every = df.select(F.col(by).alias("o")).distinct()
    return every.join(least, F.col("o").eqNullSafe(F.col("g")), "left").select(F.col("o").alias(by), *(v.alias(name) for name, v in between.items()))
