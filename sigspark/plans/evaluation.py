"""Evaluation of forecasts: rank correlation, portfolios, and inference that knows the calendar.

Predictions are long, (date, permno, model_id, prediction), so all models and dates are scored by one
shuffle on (model_id, date).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normal import Z95, two_sided_p
from ..functions.ranks import tie_interval, with_tie_interval
from ..functions.scalar import finite
from ..operators.grid import complete
from ..sources.scratch import stored


def _complete_rows(df: DataFrame, *columns: str) -> DataFrame:
    out = df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    for c in columns:
        out = out.where(F.col(c).isNotNull())
    return out


def rank_ic(df: DataFrame, prediction: str, target: str, by: Sequence[str] = ("date",), least: int = 10, constant_as_zero: bool = True, target_rank: str | None = None) -> DataFrame:
    """by..., rank_ic, n: Spearman correlation of each cross-section.

    Null with fewer than ``least`` rows or a constant target; a constant prediction is 0, or null in the
    older convention (``constant_as_zero=False``). ``target_rank`` names a column that already holds the
    target's rank (see ranked_target), where many predictions share one target.
    """
    d = _complete_rows(df, prediction, target).repartition(*by)  # one exchange: ranks and sums below need no other
    for c, name in ((prediction, "x"), (target, "y")):
        left, right, _ = tie_interval(by, c)
        d = d.withColumn(name, F.col(target_rank) if name == "y" and target_rank else left + right + 1)  # twice the average rank
    s = d.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(F.col(a).cast("double") * F.col(b)).alias(a + b) for a, b in ("xx", "yy", "xy")), F.sum("x").cast("double").alias("sx"), F.sum("y").cast("double").alias("sy"))
    vx, vy = F.col("xx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")
    ic = F.when(vx > 0, cov / F.sqrt(vx * vy)).otherwise(F.lit(0.0) if constant_as_zero else F.lit(None).cast("double"))
    return s.select(*by, F.when((F.col("n") >= least) & (vy > 0), ic).alias("rank_ic"), "n")


def ranked_target(df: DataFrame, target: str, by: Sequence[str] = ("date",), name: str = "target_rank") -> DataFrame:
    """Rows with a target, and twice its average rank, to be shared by all predictions of these rows."""
    d = _complete_rows(df, target)
    left, right, _ = tie_interval(by, target)
    return d.withColumn(name, left + right + 1)


def fractional_bins(df: DataFrame, prediction: str, target: str, by: Sequence[str] = ("date",), bins: int = 10, weight: str | None = None, least: float = 1.0) -> DataFrame:
    """by..., bin, ret, n_members: bin returns where tied values share the bins that their ranks span.

    A member of a tied block (left, right] has in each bin the share of the block that falls into it.
    Weights apply after that, to positive ones only. A date where any bin has fewer than ``least`` members
    has null returns; a constant signal there holds cash, zero.
    """
    needed = [prediction, target, *([weight] if weight else [])]
    d = _complete_rows(df, *needed)
    d = d.where(F.col(weight) > 0) if weight else d
    d = with_tie_interval(d, by, prediction)
    # only bins that the block overlaps: at most two for a value without ties
    low = F.floor(F.col("left") * bins / F.col("n")) + 1
    high = F.least(F.lit(bins), F.ceil(F.col("right") * bins / F.col("n")))
    spread = d.withColumn("bin", F.explode(F.sequence(low, high)))
    share = F.greatest(F.lit(0.0), F.least(F.col("right").cast("double"), F.col("bin") * F.col("n") / bins) - F.greatest(F.col("left").cast("double"), (F.col("bin") - 1) * F.col("n") / bins)) / (F.col("right") - F.col("left"))
    mass = share * (F.col(weight) if weight else 1.0)
    sums = spread.groupBy(*by, "bin").agg(F.sum(share).alias("n_members"), F.sum(mass).alias("mass"), F.sum(mass * F.col(target)).alias("total"), F.min(prediction).alias("low"), F.max(prediction).alias("high"))
    all_ = Window.partitionBy(*by)
    enough = (F.min("n_members").over(all_) >= least - 1e-9) & (F.count("*").over(all_) == bins)
    constant = F.min("low").over(all_) == F.max("high").over(all_)
    ret = F.when(enough, F.when(constant, 0.0).otherwise(F.when(F.col("mass") > 0, F.col("total") / F.col("mass"))))
    return sums.select(*by, "bin", ret.alias("ret"), "n_members")


def score(long: DataFrame, target: str, cap: str, by: Sequence[str] = ("date", "model_id"), bins: int = 10, least_ic: int = 10, least_per_bin: int = 10) -> DataFrame:
    """One row for each date and model: rank_ic, D10 - D1 in basis points by equal and cap weight, the legs, counts.

    Cap portfolios rank anew among stocks with a positive cap. Demeaned legs are less the mean return of
    their universe; a constant forecast holds cash in both. Rows meet once, by date and model: ranks among all and among
    stocks with a cap come from sorts of each cross-section, and one aggregation takes correlation and legs. A bin of shares
    always has n / bins members, so only the first and the last bin are summed.
    """
    d = _complete_rows(long, "prediction", target).withColumn("__cap", finite(F.col(cap).cast("double")))
    d = d.select(*by, "prediction", F.col(target).alias("__y"), F.coalesce(F.col("__cap") > 0, F.lit(False)).alias("__has"), F.col("__cap")).repartition(*by)
    left, right, n = tie_interval(by, "prediction")
    y_left, y_right, _ = tie_interval(by, "__y")
    c_left, c_right, c_n = tie_interval([*by, "__has"], "prediction")
    d = d.withColumns({"left": left, "right": right, "n": n, "c_left": c_left, "c_right": c_right, "c_n": c_n, "b": y_left + y_right + 1}).withColumn("a", F.col("left") + F.col("right") + 1)
    product = lambda x, y: F.sum(F.col(x).cast("double") * F.col(y))
    aggs = [F.count("*").alias("n_stocks"), F.count_if("__has").alias("n_cap_stocks"), (F.min("prediction") == F.max("prediction")).alias("constant_prediction"), *(product(x, y).alias(x + y) for x, y in (("a", "a"), ("b", "b"), ("a", "b"))), *(F.sum(x).cast("double").alias(f"s{x}") for x in "ab")]
    for name, prefix, inside, weight in (("ew", "", F.lit(True), F.lit(1.0)), ("cap", "c_", F.col("__has"), F.col("__cap"))):
        lo, hi, size = (F.col(prefix + c).cast("double") for c in ("left", "right", "n"))
        aggs += [F.avg(F.when(inside, F.col("__y"))).alias(f"{name}_market"), (F.min(F.when(inside, F.col("prediction"))) == F.max(F.when(inside, F.col("prediction")))).alias(f"{name}_cash")]
        for leg, k in (("d1", 1), ("d10", bins)):
            share = F.greatest(F.lit(0.0), F.least(hi, k * size / bins) - F.greatest(lo, (k - 1) * size / bins)) / (hi - lo)
            aggs += [F.sum(F.when(inside, share * weight)).alias(f"{name}_{leg}_mass"), F.sum(F.when(inside, share * weight * F.col("__y"))).alias(f"{name}_{leg}_total")]
    s = d.groupBy(*by).agg(*aggs)
    va, vb = F.col("aa") - F.col("sa") * F.col("sa") / F.col("n_stocks"), F.col("bb") - F.col("sb") * F.col("sb") / F.col("n_stocks")
    cov = F.col("ab") - F.col("sa") * F.col("sb") / F.col("n_stocks")
    ic = F.when((F.col("n_stocks") >= least_ic) & (vb > 0), F.when(va > 0, cov / F.sqrt(va * vb)).otherwise(0.0))
    columns = [ic.alias("rank_ic"), "n_stocks", "n_cap_stocks", "constant_prediction"]
    for name, size in (("ew", "n_stocks"), ("cap", "n_cap_stocks")):
        enough, cash = F.col(size) / bins >= least_per_bin - 1e-9, F.col(f"{name}_cash")
        ret = {leg: F.when(enough, F.when(cash, 0.0).otherwise(F.when(F.col(f"{name}_{leg}_mass") > 0, F.col(f"{name}_{leg}_total") / F.col(f"{name}_{leg}_mass")))) for leg in ("d1", "d10")}
        columns.append(((ret["d10"] - ret["d1"]) * 1e4).alias(f"{name}_spread_bp"))
        columns += [(v * 1e4).alias(f"{name}_{leg}_raw_bp") for leg, v in ret.items()] + [(F.when(cash, v).otherwise(v - F.col(f"{name}_market")) * 1e4).alias(f"{name}_{leg}_demeaned_bp") for leg, v in ret.items()]
    return s.select(*by, *columns)


def on_calendar(daily: DataFrame, calendar: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Every model on every session; sessions without a score are rows of nulls."""
    return complete(daily.select(*by).distinct(), calendar.select("date")).join(daily, [*by, "date"], "left")


def _summary(sums: DataFrame, by: Sequence[str], se: Column, exact: bool, lags: int) -> DataFrame:
    t = F.when(F.col("se") > 0, F.col("mean") / F.col("se")).when((F.col("se") == 0) & (F.col("mean") == 0), 0.0)
    out = sums.withColumn("se", se).withColumns({"t": t, "ci_low": F.col("mean") - Z95 * F.col("se"), "ci_high": F.col("mean") + Z95 * F.col("se"), "hac_lags": F.lit(lags)})
    return out.withColumn("p", two_sided_p(F.col("t"))) if exact else out


def calendar_hac(daily: DataFrame, value: str, lags: int, by: Sequence[str] = ("model_id",), with_p: bool = True) -> DataFrame:
    """Mean with a Bartlett standard error on a complete calendar.

    A missing session adds nothing but keeps its place, so that days apart stay apart.
    se = sqrt(meat / (n (n - 1))), normal tails. ``daily`` has a row for every session (see on_calendar).
    """
    x = finite(F.col(value).cast("double"))
    group = Window.partitionBy(*by)
    d = daily.withColumn("x", x).withColumns({"mean": F.avg("x").over(group), "n": F.count("x").over(group), "days": F.count("*").over(group)})
    d = d.withColumn("u", F.coalesce(F.col("x") - F.col("mean"), F.lit(0.0)))
    ordered = Window.partitionBy(*by).orderBy("date")
    meat = F.col("u") * F.col("u")
    for k in range(1, lags + 1):
        meat = meat + F.lit(2.0 * (1.0 - k / (lags + 1.0))) * F.col("u") * F.coalesce(F.lag("u", k).over(ordered), F.lit(0.0))
    sums = d.withColumn("m", meat).groupBy(*by).agg(F.max("mean").alias("mean"), F.max("n").alias("n"), F.max("days").alias("calendar_days"), F.sum("m").alias("meat"))
    se = F.when(F.col("n") >= 2, F.sqrt(F.greatest(F.col("meat"), F.lit(0.0)) / (F.col("n") * (F.col("n") - 1))))
    return _summary(sums, by, se, with_p, lags).withColumn("missing_days", F.col("calendar_days") - F.col("n")).drop("meat")


def hac(daily: DataFrame, value: str, lags: int, by: Sequence[str] = ("model_id",), with_p: bool = True) -> DataFrame:
    """The same with observed dates taken as adjacent: missing ones are dropped first, lags at most n - 1."""
    return calendar_hac(daily.where(finite(F.col(value).cast("double")).isNotNull()), value, lags, by, with_p)


def contrasts(daily: DataFrame, specs: DataFrame, value: str, lags: Sequence[int], family: int | None = None, with_p: bool = True) -> DataFrame:
    """Mean differences a - b of declared pairs of models, with p adjusted for the declared family size.

    ``specs``: contrast, a, b, and family_size unless ``family`` is given for all. The family counts every
    declared pair, scored or not.
    """
    size = F.lit(family) if family is not None else F.col("family_size")
    side = lambda s: daily.select("date", F.col("model_id").alias(s), F.col(value).alias(f"v_{s}"))
    paired = specs.join(side("a"), "a").join(side("b"), ["b", "date"]).withColumn("difference", F.col("v_a") - F.col("v_b"))
    out = None
    for k in lags:
        one = calendar_hac(paired, "difference", k, ["contrast"], with_p)
        out = one if out is None else out.unionByName(one)
    if not with_p:
        return out
    sized = out.join(specs.select("contrast", size.alias("family_size")), "contrast")
    return sized.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p") * F.col("family_size")))


def first_within_tie(df: DataFrame, by: Sequence[str], score_: str, order: Sequence[str | Column], tie: float = 1e-12) -> DataFrame:
    """Of each group the row within ``tie`` of the best score that comes first in ``order``; rows without a score lose."""
    group = Window.partitionBy(*by)
    near = df.withColumn("__best", F.max(score_).over(group)).where(F.col(score_) >= F.col("__best") - tie).drop("__best")
    return near.withColumn("__place", F.row_number().over(group.orderBy(*order))).where("__place = 1").drop("__place")


def period_summary(daily: DataFrame, value: str, periods: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Mean, deviation and days of a daily series by model and declared period of years."""
    named = F.array(*(F.when(F.year("date").between(a, b), F.lit(name)) for name, a, b in periods))
    rows = daily.withColumn("period", F.explode(F.array_compact(named)))
    return rows.groupBy("model_id", "period").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n_days"))


def out_of_sample_r2(df: DataFrame, prediction: str, target: str, by: Sequence[str]) -> DataFrame:
    """MSE and 1 - SSE / SST about the group's mean."""
    d = _complete_rows(df, prediction, target)
    e = F.col(target) - F.col(prediction)
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"), (F.var_pop(target) * F.count("*")).alias("sst"))
    return s.select(*by, "n", (F.col("sse") / F.col("n")).alias("mse"), F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2"))


def clustered_slope(df: DataFrame, x: str, y: str, first: str, second: str) -> DataFrame:
    """Pooled slope without a constant, variance clustered both ways: V = V1 + V2 - V12.

    A cluster's sum of scores is sum(xy) - beta sum(xx), so one pass by grouping sets holds all clusterings, and
    the squares of those sums follow from three sums over the clusters.
    """
    d = _complete_rows(df, x, y).select(first, second, F.col(x).alias("x"), F.col(y).alias("y"))
    sets = d.groupingSets([[F.col(first)], [F.col(second)], [F.col(first), F.col(second)]], first, second)
    clusters = sets.agg(F.grouping_id().alias("level"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.count("*").alias("n"))
    at = lambda level, c: F.sum(F.when(F.col("level") == level, c))
    levels = {"v1": 1, "v2": 2, "v12": 0}  # a set bit: the column is summed out
    sums = clusters.agg(
        at(1, F.col("xx")).alias("sxx"), at(1, F.col("xy")).alias("sxy"), at(1, F.col("n")).alias("n"),
        *(at(k, a * b).alias(f"{v}_{name}") for v, k in levels.items() for name, a, b in (("yy", F.col("xy"), F.col("xy")), ("xy", F.col("xy"), F.col("xx")), ("xx", F.col("xx"), F.col("xx")))),
        *(F.count_if(F.col("level") == levels[v]).alias(f"{v}_clusters") for v in ("v1", "v2")),
    ).where("n is not null").withColumn("beta", F.col("sxy") / F.col("sxx"))
    square = lambda v: F.col(f"{v}_yy") - 2 * F.col("beta") * F.col(f"{v}_xy") + F.col("beta") * F.col("beta") * F.col(f"{v}_xx")
    se = F.sqrt(F.greatest(square("v1") + square("v2") - square("v12"), F.lit(0.0))) / F.col("sxx")
    return sums.select("beta", "n", se.alias("se"), (F.col("beta") / se).alias("t"), F.col("v1_clusters").alias("n_first"), F.col("v2_clusters").alias("n_second"))


def clustered_ols(df: DataFrame, x: str, y: str, cluster: Sequence[str], by: Sequence[str] = (), least: int = 10) -> DataFrame:
    """y on a constant and x by group, with one-way clustered errors; null with fewer than ``least`` rows."""
    d = _complete_rows(df, x, y).select(*by, *(c for c in cluster if c not in by), F.col(x).alias("x"), F.col(y).alias("y"))
    g = Window.partitionBy(*by)
    mx, my = F.avg("x").over(g), F.avg("y").over(g)
    d = d.withColumns({"dx": F.col("x") - mx, "dy": F.col("y") - my, "mx": mx})
    sxx = F.sum(F.col("dx") * F.col("dx")).over(g)
    d = d.withColumn("sxx", sxx).withColumn("beta", F.sum(F.col("dx") * F.col("dy")).over(g) / F.col("sxx")).withColumn("n", F.count("*").over(g))
    d = d.withColumn("e", F.col("dy") - F.col("beta") * F.col("dx"))
    sums = d.groupBy(*by, *cluster).agg(F.sum(F.col("dx") * F.col("e")).alias("s"), F.first("sxx").alias("sxx"), F.first("beta").alias("beta"), F.first("n").alias("n"), F.first("mx").alias("mx"))
    out = sums.groupBy(*by).agg(F.first("beta").alias("beta"), F.first("n").alias("n"), F.count("*").alias("n_clusters"), (F.sqrt(F.sum(F.col("s") * F.col("s"))) / F.first("sxx")).alias("se0"))
    adjust = F.sqrt(F.col("n_clusters") / (F.col("n_clusters") - 1) * (F.col("n") - 1) / (F.col("n") - 2))
    enough = F.col("n") >= least
    return out.select(*by, F.when(enough, F.col("beta")).alias("beta"), F.when(enough, F.col("se0") * adjust).alias("se"), "n", "n_clusters")


def clustered_family(df: DataFrame, x: str, y: str, specs: dict[str, Column], clusterings: dict[str, Sequence[Column]], least: int = 10) -> DataFrame:
    """spec, clustering, beta, se, n, n_clusters: y on a constant and x over the rows of every specification, under every clustering.

    One pass adds up counts and products by (specification, clustering, cluster); slopes are sums of these, and a
    cluster's score follows from its sums and the slope. Null with fewer than ``least`` rows, or where x does not vary; the error is
    null for a single cluster.
    """
    d = _complete_rows(df, x, y)
    held = F.array_compact(F.array(*(F.when(on, F.lit(name)) for name, on in specs.items())))
    each = F.array(*(F.struct(F.lit(name).alias("clustering"), F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)).alias("cluster")) for name, columns in clusterings.items()))
    rows = d.select(F.col(x).alias("x"), F.col(y).alias("y"), F.explode(held).alias("spec"), each.alias("c")).select("x", "y", "spec", F.explode("c").alias("c"))
    products = {"n": F.count("*"), "x": F.sum("x"), "y": F.sum("y"), "xx": F.sum(F.col("x") * F.col("x")), "xy": F.sum(F.col("x") * F.col("y"))}
    clusters = stored(rows.groupBy("spec", "c.clustering", "c.cluster").agg(*(v.alias(k) for k, v in products.items())), "cluster-sums")
    total = clusters.groupBy("spec", "clustering").agg(F.count("*").alias("n_clusters"), *(F.sum(k).alias(f"t_{k}") for k in products))
    sxx, sxy = F.col("t_xx") - F.col("t_x") * F.col("t_x") / F.col("t_n"), F.col("t_xy") - F.col("t_x") * F.col("t_y") / F.col("t_n")
    total = total.withColumns({"mx": F.col("t_x") / F.col("t_n"), "my": F.col("t_y") / F.col("t_n"), "sxx": sxx}).withColumn("beta", F.when((F.col("t_n") >= least) & (F.col("sxx") > 1e-14 * F.col("t_xx")), sxy / F.col("sxx")))
    centred = lambda xy, a, b, ma, mb: F.col(xy) - F.col(ma) * F.col(b) - F.col(mb) * F.col(a) + F.col("n") * F.col(ma) * F.col(mb)
    score_ = centred("xy", "x", "y", "mx", "my") - F.col("beta") * centred("xx", "x", "x", "mx", "mx")
    scored = clusters.join(F.broadcast(total), ["spec", "clustering"]).groupBy("spec", "clustering").agg(F.sum(score_ * score_).alias("meat"), *(F.first(c).alias(c) for c in ("beta", "sxx", "n_clusters", "t_n")))  # declared specifications
    adjust = F.sqrt(F.try_divide(F.col("n_clusters"), F.col("n_clusters") - 1) * F.try_divide(F.col("t_n") - 1, F.col("t_n") - 2))
    return scored.select("spec", "clustering", "beta", F.when(F.col("beta").isNotNull(), F.sqrt("meat") / F.col("sxx") * adjust).alias("se"), F.col("t_n").alias("n"), "n_clusters")


def leg_spread(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None, bins: int, least: float) -> float | None:
    """Last bin's return less the first one's, in basis points, of one cross-section sorted by ``p`` (as in ``score``)."""
    n = len(p)
    if not n or n / bins < least - 1e-9:
        return None
    if p[0] == p[-1]:
        return 0.0
    edges = np.append(np.flatnonzero(np.append(True, p[1:] != p[:-1])), n)
    left, right = (np.repeat(e, np.diff(edges)).astype(float) for e in (edges[:-1], edges[1:]))
    ret = []
    for k in (1, bins):
        mass = np.maximum(0.0, np.minimum(right, k * float(n) / bins) - np.maximum(left, (k - 1) * float(n) / bins)) / (right - left)
        mass = mass if weight is None else mass * weight
        ret.append(float((mass * y).sum() / mass.sum()) if mass.sum() > 0 else None)
    return None if None in ret else (ret[1] - ret[0]) * 1e4


def spreads_by_group(long: DataFrame, target: str, cap: str, groups: Column, bins: Sequence[int], least_per_bin: int) -> DataFrame:
    """bins, model_id, group, year (null: all), ew, cap, n_dates: mean spreads of equal and cap weight in every group of
    ``groups`` (an array of names for each row), by year and over all.

    Rows meet once, by date and model, and are not repeated for groups or numbers of bins: a cross-section is sorted by its
    forecasts in its task, and each group's rows are taken from it in that order.
    """
    keys = ["bins", "model_id", "group"]
    d = _complete_rows(long.withColumn("__groups", groups), "prediction", target).withColumn("__cap", finite(F.col(cap).cast("double")))
    d = d.select("date", "model_id", "prediction", F.col(target).alias("__y"), "__cap", "__groups")

    def judge(rows: pa.Table) -> pa.Table:
        p, y, w = (rows[c].to_numpy() for c in ("prediction", "__y", "__cap"))
        lists = rows["__groups"].combine_chunks()
        names = lists.flatten().dictionary_encode(null_encoding="encode")
        code, of = names.indices.to_numpy(), np.repeat(np.arange(len(p)), lists.value_lengths().fill_null(0).to_numpy())
        by = np.argsort(p[of], kind="stable")
        out = []
        for g, name in enumerate(names.dictionary.to_pylist()):
            at = of[by[code[by] == g]]
            has = at[w[at] > 0]  # not so for a missing cap
            out += [(b, name, leg_spread(p[at], y[at], None, b, least_per_bin), leg_spread(p[has], y[has], w[has], b, least_per_bin)) for b in bins]
        first = rows.slice(0, 1)
        same = [pa.array(first[c].to_pylist() * len(out), first[c].type) for c in ("date", "model_id")]
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64())
        found = [pa.array(c, kind) for c, kind in zip(list(zip(*out, strict=True)) or [()] * 4, kinds, strict=True)]
        return pa.table([*same, *found], names=["date", "model_id", "bins", "group", "ew", "cap"])

    fields = [T.StructField(c, d.schema[c].dataType) for c in ("date", "model_id")]
    schema = T.StructType([*fields, T.StructField("bins", T.LongType()), T.StructField("group", T.StringType()), T.StructField("ew", T.DoubleType()), T.StructField("cap", T.DoubleType())])
    yearly = d.groupBy("date", "model_id").applyInArrow(judge, schema).withColumn("year", F.year("date").cast("long"))
    c = lambda *names: [F.col(n) for n in names]
    sets = yearly.groupingSets([c(*keys), c(*keys, "year")], *keys, "year")
    return sets.agg(F.avg("ew").alias("ew"), F.avg("cap").alias("cap"), F.count("ew").alias("n_dates"))


def signal_weighted(df: DataFrame, signals: Sequence[str], ret: str, by: Sequence[str] = ("date",)) -> DataFrame:
    """Long and short returns weighted by the size of the signals' product."""
    product = F.lit(1.0)
    for s in signals:
        product = product * F.col(s)
    d = _complete_rows(df.withColumn("__s", product), "__s", ret)
    leg = lambda side: F.sum(F.when(side, F.col(ret) * F.abs("__s"))) / F.sum(F.when(side, F.abs("__s")))
    legs = d.groupBy(*by).agg(leg(F.col("__s") > 0).alias("long_ret"), leg(F.col("__s") < 0).alias("short_ret"), F.count_if(F.col("__s") > 0).alias("n_long"), F.count_if(F.col("__s") < 0).alias("n_short"))
    return legs.withColumn("spread", F.coalesce("long_ret", F.lit(0.0)) - F.coalesce("short_ret", F.lit(0.0)))


def least_stocks(series: DataFrame, n: str, value: str, least: int) -> DataFrame:
    """Dates of fewer than ``least`` stocks earn nothing."""
    return series.withColumn(value, F.when(F.col(n) < least, 0.0).otherwise(F.col(value)))


def sharpe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    x = finite(F.col(value).cast("double"))
    ratio = F.avg(x) / F.stddev_samp(x) * F.sqrt(F.lit(252.0))
    return df.groupBy(*by).agg(F.when((F.count(x) > 1) & (F.stddev_samp(x) > 0), ratio).alias("sharpe"), F.count(x).alias("n_days"))


def cumulative(series: DataFrame, value: str, by: Sequence[str] = (), order: str = "date") -> DataFrame:
    """Cumulative log and compound return."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    logs = F.sum(F.log1p(value)).over(w)
    return series.withColumns({"cum_log": logs, "cum_ret": F.expm1(logs)})


def top_share(df: DataFrame, value: str, by: Sequence[str], fraction: float) -> DataFrame:
    """Share of the total that the greatest ``fraction`` of the rows hold."""
    w = Window.partitionBy(*by)
    ranked = df.withColumns({"__r": F.row_number().over(w.orderBy(F.desc(value))), "__n": F.count("*").over(w)})
    return ranked.groupBy(*by).agg((F.sum(F.when(F.col("__r") <= F.ceil(F.col("__n") * fraction), F.col(value))) / F.sum(value)).alias("top_share"))
