"""Every month's model in a few passes over the panel, however many months there are.

The bounds of all windows cut the calendar into blocks. One pass sums products of features and target by block;
running sums over the blocks, subtracted at a window's two ends, are the window's sums, so a row is read once whatever
the number of windows that hold it. Windows are fitted in parallel, each from its own triangle of sums; validation and
test rows are scored for all candidates of their windows at once, a date's cross-section at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..sources.scratch import stored
from . import models as md
from .splits import Task, as_frame
from .splits import blocks as blocks_of

# The menus of the choice by past months, on standardised columns. Ridge: penalty a row. Lasso: share of
# the least penalty that zeroes all. Elastic net: the ridge part of the Gram, then the share.
PAST_RIDGE = (0.0, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
PAST_LASSO = (1.0, 0.3, 0.1, 0.03, 0.01, 0.003, 0.001)
PAST_ENET = tuple((l2, l1) for l2 in (1.0, 10.0) for l1 in (0.3, 0.1, 0.03, 0.01, 0.003))
PAST_DEFAULT = {"ols": (0.0, 0.0), "ridge": (1.0, 0.0), "lasso": (0.0, 0.1), "enet": (1.0, 0.1)}
PAST_MONTHS = 12
COEFFICIENT_BYTES = 64 << 20  # sent to the executors at a time
WIDE_ROWS = 2048  # rows that are made wide at a time
CACHED = 1 << 16  # numbers that are multiplied out at a time, so that they stay in the cache

Span = tuple[str, int, int]  # key, first and last session
Fit = Callable[[md.Moments], Sequence[md.Candidate]]
Wide = Callable[[np.ndarray], np.ndarray]  # rows of the columns that are moved -> rows of those that are fitted
_FOUND = "key string, k int, estimator string, penalty double, mix double, beta array<double>, intercept double, mean array<double>, scale array<double>, n long"

_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "long": pa.int64(), "array<double>": pa.list_(pa.float64())}
# The menus of cross-validation. 100 ridge penalties from 1e-6 to 1e6, eight mixing ratios, 100 steps down to a thousandth.
CV_RIDGE = tuple(10.0 ** (-6 + 12 * i / 99) for i in range(100))
CV_MIXES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
CV_STEPS, CV_LEAST = 100, 1e-3
EXPANDED_MIXES = (0.01, 0.03, 0.1, 0.5, 0.9)


def as_they_are(x: np.ndarray) -> np.ndarray:
    return x


def _floats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def block_bounds(spans: Sequence[Span]) -> list[int]:
    """First sessions of the blocks: between two of them no window begins or ends."""
    return sorted({c for _, low, high in spans for c in (low, high + 1)})


def _block(bounds: Sequence[int]):
    """Number of the block of a session (0: before all), by halving an array of constants."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("code")))


def _sessions(panel: DataFrame, bounds: Sequence[int]) -> DataFrame:
    """code, block: one row a session, so that the block is found once for each."""
    return panel.select("code").distinct().withColumn("block", _block(bounds)).where((F.col("block") > 0) & (F.col("block") < len(bounds)))


def _block_sums(ready: DataFrame, wide: Wide) -> DataFrame:
    """block, cell, v of rows (block, features, y, w, w_all) without missing values, in one pass: the triangle of (1, values, target) and the count over
    labelled rows, and mass, sums and sums of squares over all. Columns made by ``wide`` live for ``WIDE_ROWS`` rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            block, x = batch["block"].to_numpy(), _floats(batch["features"])
            y, w, w_all = (batch[c].to_numpy(zero_copy_only=False) for c in ("y", "w", "w_all"))
            order = np.argsort(block, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(block[order], prepend=-1)), len(order))
            for low, high in ((i, min(i + WIDE_ROWS, b)) for a, b in zip(ends, ends[1:], strict=False) for i in range(a, b, WIDE_ROWS)):
                at = order[low:high]
                z = np.column_stack((np.ones(len(at)), wide(x[at]), y[at]))
                on = np.isfinite(y[at])
                mine = z[on]
                triangle = (mine * w[at][on, None]).T @ mine
                plain = z[:, 1:-1]
                own = held.setdefault(int(block[at[0]]), [0.0, 0, 0.0, 0.0, 0.0])
                for k, v in enumerate((triangle, len(mine), w_all[at].sum(), w_all[at] @ plain, np.einsum("i,ij,ij->j", w_all[at], plain, plain))):
                    own[k] = own[k] + v
        for block, (triangle, n, mass, first, second) in held.items():
            side = len(triangle)
            upper = np.flatnonzero(np.triu(np.ones((side, side), bool)))
            scaler = np.column_stack((np.full(side - 2, mass), first, second)).ravel()
            cells = np.concatenate((upper, [side * side], -1 - np.arange(len(scaler)))) if n else -1 - np.arange(len(scaler))
            v = np.concatenate((triangle.ravel()[upper], [n], scaler)) if n else scaler
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), block), pa.int32()), pa.array(cells, pa.int64()), pa.array(v)], names=["block", "cell", "v"])

    return ready.mapInArrow(run, "block int, cell long, v double").groupBy("block", "cell").agg(F.sum("v").alias("v"))


def window_cells(panel: DataFrame, spans: Sequence[Span], columns: Sequence[str], target: str, by_date: bool, complete: bool = False, wide: Wide = as_they_are) -> DataFrame:
    """key, cell, v: sums over each window. Cells from 0 up are those of ``models.cell_sums`` of (1, values, whether
    there, target) over labelled rows; -1 - 3c - j are the mass, sum and sum of squares (j = 0, 1, 2) of column c over all rows.

    ``by_date``: a row weighs 1 / (rows of its date) among its like, else 1. ``complete``: no column is ever missing, so that
    whether it is there is left out, and the triangle is a quarter as large; only then may ``wide`` make more columns of these.
    """
    bounds = block_bounds(spans)
    label = finite(F.col(target).cast("double"))
    of_date = panel.groupBy("code").agg(F.count("*").alias("__all"), F.count(label).alias("__labelled"))
    blocked = panel.join(F.broadcast(_sessions(panel, bounds).join(of_date, "code")), "code")  # a row a session
    clean = [finite(F.col(c).cast("double")) for c in columns]
    mass = lambda n: F.try_divide(F.lit(1.0), F.col(n)) if by_date else F.lit(1.0)
    values = F.array(*(F.coalesce(x, F.lit(0.0)) for x in clean), *(x.isNotNull().cast("double") for x in ([] if complete else clean)))
    ready = blocked.select("block", values.alias("features"), label.alias("y"), mass("__all").alias("w_all"), mass("__labelled").alias("w"), *([] if complete else (x.alias(f"x{i}") for i, x in enumerate(clean))))
    if complete:  # rows may be wide: they are made where they are summed and never written
        sums = _block_sums(ready, wide)
    else:
        ready = stored(ready, "walk-forward")
        labelled = md.cell_sums(ready.where("y is not null"), ["block"], target="y", weight="w")
        powers = [f for i in range(len(columns)) for x in [F.col(f"x{i}")] for w in [F.when(x.isNotNull(), F.col("w_all"))] for f in (F.sum(w), F.sum(w * x), F.sum(w * x * x))]
        scaler = ready.groupBy("block").agg(F.array(*(F.coalesce(s, F.lit(0.0)) for s in powers)).alias("s"))
        scaler = scaler.select("block", F.posexplode("s").alias("i", "v")).select("block", (-1 - F.col("i")).cast("long").alias("cell"), "v")
        sums = labelled.select("block", "cell", "v").unionByName(scaler)
    cells = stored(sums, "walk-forward-blocks")
    running = cells.withColumn("v", F.sum("v").over(Window.partitionBy("cell").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    present = {k: sorted(r["block"] for r in cells.where(f"cell {k}").select("block").distinct().collect()) for k in (">= 0", "< 0")}  # at most two a window
    ends = []
    for key, low, high in spans:
        for at, sign in ((bounds.index(high + 1), 1.0), (bounds.index(low), -1.0)):
            for own, blocks in present.items():
                if before := [b for b in blocks if b <= at]:
                    ends.append((key, before[-1], sign, own == ">= 0"))
    ends = panel.sparkSession.createDataFrame(ends, "key string, block int, sign double, labelled boolean")
    both = (running["block"] == ends["block"]) & ((running["cell"] >= 0) == ends["labelled"])
    return running.join(F.broadcast(ends), both).groupBy("key", "cell").agg(F.sum(F.col("sign") * F.col("v")).alias("v"))  # four rows a window


def _scaled_sums(cells: np.ndarray, v: np.ndarray, mean: np.ndarray, scale: np.ndarray, complete: bool = False) -> np.ndarray:
    """Sums of products of (1, scaled columns, target) from those of (1, values, whether there, target)."""
    p = len(mean)
    side = (1 if complete else 2) * p + 2
    flat = np.zeros(side * side + 1)
    flat[cells[cells >= 0]] = v[cells >= 0]
    half = flat[:-1].reshape(side, side)
    half += np.triu(half, 1).T
    to = np.zeros((p + 2, side))
    to[0, 0] = to[-1, -1] = 1.0
    at = np.arange(p)
    to[1 + at, 1 + at] = 1.0 / scale
    to[1 + at, 0 if complete else 1 + p + at] = -mean / scale
    return to @ half @ to.T


def _window_moments(cells: np.ndarray, v: np.ndarray, p: int, complete: bool) -> tuple[md.Moments, np.ndarray, np.ndarray]:
    """Moments of the scaled columns, with the means and scales: of all rows' finite values; a missing value is the mean."""
    m = np.zeros(3 * p)
    scaler = cells < 0
    m[-1 - cells[scaler]] = v[scaler]
    mass, total, square = m.reshape(p, 3).T
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(mass > 0, total / mass, 0.0)
        variance = np.where(mass > 0, square / mass - mean * mean, 0.0)
    scale = np.where(variance > np.maximum(1e-20, 1e-13 * mean * mean), np.sqrt(np.maximum(variance, 0)), 1.0)
    count = v[cells == ((1 if complete else 2) * p + 2) ** 2].sum()
    return md.centred(np.append(_scaled_sums(cells, v, mean, scale, complete).ravel(), count)), mean, scale


def fit_windows(panel: DataFrame, spans: Sequence[Span], columns: Sequence[str], target: str, fit: Fit, by_date: bool = True, complete: bool = False, wide: Wide = as_they_are) -> DataFrame:
    """A row for each window and candidate of ``fit``: its coefficients on scaled columns, and the scaler. Windows without a label have none."""

    def run(rows: pa.Table) -> pa.Table:
        cells, v = rows["cell"].to_numpy(), rows["v"].to_numpy()
        p = int((cells < 0).sum()) // 3
        out: dict[str, list] = {c.split()[0]: [] for c in _FOUND.split(", ")}
        if (cells >= 0).any():
            m, mean, scale = _window_moments(cells, v, p, complete)
            for k, c in enumerate(fit(m) if m.n else ()):
                for name, value in (("key", rows["key"][0].as_py()), ("k", k), ("estimator", c.estimator), ("penalty", c.penalty), ("mix", c.mix), ("beta", c.beta.tolist()), ("intercept", c.intercept), ("mean", mean.tolist()), ("scale", scale.tolist()), ("n", m.n)):
                    out[name].append(value)
        return pa.table({c.split()[0]: pa.array(out[c.split()[0]], _KINDS[c.split()[1]]) for c in _FOUND.split(", ")})

    return stored(window_cells(panel, spans, columns, target, by_date, complete, wide).groupBy("key").applyInArrow(run, _FOUND), "walk-forward-fits")


def rows_of(panel: DataFrame, spans: Sequence[Span]) -> DataFrame:
    """Panel rows with the key of every span that holds them: an equality join on the session with a row for each span's session."""
    listed = panel.sparkSession.createDataFrame([*spans], "key string, low int, high int").select("key", F.explode(F.sequence("low", "high")).alias("code"))
    return panel.join(F.broadcast(listed), "code")  # sessions of the calendar, times the spans that share them


def scaled_blocks(panel: DataFrame, found: Sequence[Task], columns: Sequence[str], target: str = "q") -> DataFrame:
    """month, block, code, date, permno, features and ``target`` of every block of every task (panel: code, date, permno, columns, target).

    Columns are scaled by the mean and deviation of the task's labelled fit rows, dates weighing the same; a missing
    value is the mean. A date's sums are made once, whatever the number of windows that hold it.
    """
    frame = as_frame(panel.sparkSession, found)
    clean = [finite(F.col(c).cast("double")) for c in columns]
    n = F.count("*")
    sums = [f / n for x in clean for f in (F.count(x), F.coalesce(F.sum(x), F.lit(0.0)), F.coalesce(F.sum(x * x), F.lit(0.0)))]
    daily = panel.where(F.col(target).isNotNull()).groupBy("code").agg(*(f.alias(f"s{i}") for i, f in enumerate(sums)))
    sessions = frame.select("month", F.explode(F.sequence("fit_first", "fit_last")).alias("code"))
    total = daily.join(F.broadcast(sessions), "code").groupBy("month").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(sums))))
    scaler = []
    for i in range(len(columns)):
        mass, first, second = (F.col(f"s{3 * i + j}") for j in range(3))
        mean = F.coalesce(F.try_divide(first, mass), F.lit(0.0))
        variance = F.coalesce(F.try_divide(second, mass), F.lit(0.0)) - mean * mean
        scaler += [mean.alias(f"mean{i}"), F.when(variance > 1e-20, F.sqrt(variance)).otherwise(1.0).alias(f"scale{i}")]
    scaled = F.array(*(F.coalesce((x - F.col(f"mean{i}")) / F.col(f"scale{i}"), F.lit(0.0)) for i, x in enumerate(clean)))
    rows = blocks_of(panel, frame).join(F.broadcast(total.select("month", *scaler)), "month")  # a row a month
    return rows.select("month", "block", "code", "date", "permno", scaled.alias("features"), target)


LONG = 1000  # of longer cross-sections each row is ranked by itself: it stays in the cache


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks along the rows of a matrix, ties averaged. Sorts need not be stable, as equal values share a rank."""
    if x.shape[1] > LONG and len(x) > 1:
        return np.concatenate([average_ranks(row[None]) for row in x])
    order = np.argsort(x, axis=1)
    ordered = np.take_along_axis(x, order, axis=1)
    begins = np.ones_like(ordered, dtype=bool)
    np.not_equal(ordered[:, 1:], ordered[:, :-1], out=begins[:, 1:])
    at = np.flatnonzero(begins)
    n = np.diff(at, append=begins.size)
    out = np.empty(x.shape)
    np.put_along_axis(out, order, np.repeat(at % max(1, x.shape[1]) + (n + 1) / 2, n).reshape(x.shape), axis=1)
    return out


def products(z: np.ndarray, beta: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """Forecasts, candidates by rows. Not a matrix product: equal rows must get equal forecasts, to the last digit."""
    if not 0 < z.shape[1] < 8:  # numpy sums longer rows in another order
        ends = [int(np.flatnonzero(b).max(initial=-1)) + 1 for b in beta]  # what lies behind is zero
        out, step = np.empty((len(beta), len(z))), max(1, CACHED // max(1, z.shape[1]))
        for i in range(0, len(z), step):
            part = z[i : i + step]
            for k, (b, c, end) in enumerate(zip(beta, intercept, ends, strict=True)):
                out[k, i : i + step] = (part[:, :end] * b[:end]).sum(axis=1) + c
        return out
    out = np.multiply.outer(beta[:, 0], z[:, 0])
    for j in range(1, z.shape[1]):
        out += np.multiply.outer(beta[:, j], z[:, j])
    return out + intercept[:, None]


def _forecasts(x: np.ndarray, wide: Wide, mean: np.ndarray, scale: np.ndarray, beta: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """Forecasts, candidates by rows, with ``WIDE_ROWS`` rows made wide at a time."""
    parts = [products(np.nan_to_num((wide(x[i : i + WIDE_ROWS]) - mean) / scale, nan=0.0), beta, intercept) for i in range(0, max(1, len(x)), WIDE_ROWS)]
    return np.concatenate(parts, axis=1)


def correlations(forecasts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rank correlation of each row of forecasts with the target; NaN where one of them is constant."""
    a, b = average_ranks(forecasts), average_ranks(target[None])[0]
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        return a @ b / np.sqrt((a * a).sum(axis=1) * (b @ b))


def _cross_sections(rows: DataFrame, fits: DataFrame, columns: Sequence[str], target: str, measure: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], names: Sequence[str], wide: Wide = as_they_are) -> DataFrame:
    """key, date, k and ``names``: what ``measure`` makes of each date's forecasts (candidates by rows) and targets.

    Coefficients are a declared menu for each window; they go to the executors ``COEFFICIENT_BYTES`` at a time, in one
    pass over the rows while they fit, else in a pass for each such part.
    """
    spark = rows.sparkSession
    keys = {r["key"]: r["n"] * (r["p"] + 2) * 8 for r in fits.groupBy("key").agg(F.count("*").alias("n"), F.max(F.size("beta")).alias("p")).collect()}  # a row a window
    parts: list[list[str]] = [[]]
    filled = 0
    for key in sorted(keys):
        if parts[-1] and filled + keys[key] > COEFFICIENT_BYTES:
            parts.append([])
            filled = 0
        parts[-1].append(key)
        filled += keys[key]
    features = F.array(*(finite(F.col(c).cast("double")) for c in columns))
    ready = rows.select("key", "date", features.alias("x"), finite(F.col(target).cast("double")).alias("y")).where("y is not null")
    schema = f"key string, date {dict(rows.dtypes)['date']}, k int, " + ", ".join(f"{n} double" for n in names)

    def measured(sent):
        def run(group: pa.Table) -> pa.Table:
            beta, intercept, mean, scale = sent.value[group["key"][0].as_py()]
            found = measure(_forecasts(_floats(group["x"].combine_chunks()), wide, mean, scale, beta, intercept), group["y"].to_numpy())
            n = len(intercept)
            first = {c: pa.array([group[c][0].as_py()] * n, group.schema.field(c).type) for c in ("key", "date")}
            return pa.table({**first, "k": pa.array(range(n), pa.int32()), **{m: pa.array(found[m], pa.float64(), mask=np.isnan(found[m])) for m in names}})

        return run

    out = None
    for part in parts:
        held: dict[str, tuple] = {}
        for r in fits.where(F.col("key").isin(part)).orderBy("key", "k").collect():
            b, c, _, _ = held.setdefault(r["key"], ([], [], np.array(r["mean"]), np.array(r["scale"])))
            b.append(r["beta"])
            c.append(r["intercept"])
        sent = spark.sparkContext.broadcast({k: (np.array(b), np.array(c), m, s) for k, (b, c, m, s) in held.items()})  # its size is checked above

        one = ready.where(F.col("key").isin(part)).groupBy("key", "date").applyInArrow(measured(sent), schema)
        out = one if out is None else out.unionByName(one)
    return out


def _daily_ic(forecasts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    if len(y) < 10 or y.min() == y.max():
        return {"ic": np.full(len(forecasts), np.nan)}
    return {"ic": np.nan_to_num(correlations(forecasts, y), nan=0.0)}


def _past_record(forecasts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Squared error of the month with both sides less their date's mean, and the rank correlation; a constant side counts 0."""
    error = (y - y.mean()) - (forecasts - forecasts.mean(axis=1, keepdims=True))
    return {"sse": (error * error).sum(axis=1), "rankcorr": np.nan_to_num(correlations(forecasts, y), nan=0.0)}


def forecast(rows: DataFrame, chosen: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with the prediction of their key's chosen candidate; ``chosen`` has one row for each window (and whatever else names it)."""
    slopes = chosen.withColumn("slope", F.zip_with("beta", "scale", lambda b, s: b / s)).drop("beta", "scale")
    wide = rows.join(F.broadcast(slopes), "key")  # declared windows, one candidate each
    x = [finite(F.col(c).cast("double")) for c in columns]
    if len(x) <= 64:  # written out, this compiles to plain code
        total = F.col("intercept")
        for i, v in enumerate(x):
            total = total + F.coalesce(v - F.get("mean", F.lit(i)), F.lit(0.0)) * F.get("slope", F.lit(i))
    else:
        terms = F.zip_with(F.zip_with(F.array(*x), "mean", lambda a, m: F.coalesce(a - m, F.lit(0.0))), "slope", lambda a, b: a * b)
        total = F.aggregate(terms, F.col("intercept"), lambda s, t: s + t)
    return wide.withColumn("prediction", total).drop("slope", "mean", "intercept")


def forecast_wide(rows: DataFrame, chosen: DataFrame, columns: Sequence[str], wide: Wide) -> DataFrame:
    """month, date, permno, estimator, penalty, mix, ic and prediction of ``rows`` by each of their key's chosen candidates, whose columns are made in the tasks."""
    said = ("estimator", "penalty", "mix", "ic")
    held: dict[str, list] = {}
    for r in chosen.orderBy("key", *said[:3]).collect():  # declared windows, a candidate for each estimator
        held.setdefault(r["key"], []).append(r)
    ready = {k: (np.array([r["beta"] for r in own]), np.array([r["intercept"] for r in own]), np.array(own[0]["mean"]), np.array(own[0]["scale"]), [[r[c] for r in own] for c in said]) for k, own in held.items()}
    sent = rows.sparkSession.sparkContext.broadcast(ready)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in batch["key"].unique().to_pylist() if batch.num_rows else ():
                if key not in sent.value:
                    continue
                own = batch.filter(pc.equal(batch["key"], key))
                beta, intercept, mean, scale, facts = sent.value[key]
                p = _forecasts(_floats(own["x"]), wide, mean, scale, beta, intercept)
                for i, (*fact, forecast_) in enumerate(zip(*facts, p, strict=True)):
                    constants = [pa.array([v] * len(forecast_), pa.float64() if j else pa.string()) for j, v in enumerate(fact)]
                    yield pa.RecordBatch.from_arrays([own["key"], own["date"], own["permno"], *constants, pa.array(forecast_)], names=["month", "date", "permno", *said, "prediction"])

    features = F.array(*(F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in columns))
    kinds = dict(rows.dtypes)
    return rows.select("key", "date", "permno", features.alias("x")).mapInArrow(run, f"month string, date {kinds['date']}, permno {kinds['permno']}, estimator string, penalty double, mix double, ic double, prediction double")


def _chosen(panel: DataFrame, found: Sequence[Task], columns: Sequence[str], target: str, fit: Fit, per: Sequence[str], complete: bool, wide: Wide = as_they_are) -> DataFrame:
    """The candidate of best mean daily rank correlation on the validation block of each task, of each ``per``; the first of equals."""
    fits = fit_windows(panel, [(t.month, t.fit_first, t.fit_last) for t in found], columns, target, fit, complete=complete, wide=wide)
    daily = _cross_sections(rows_of(panel, [(t.month, t.valid_first, t.valid_last) for t in found]), fits, columns, target, _daily_ic, ["ic"], wide)
    scores = daily.groupBy("key", "k").agg(F.avg("ic").alias("ic"))
    of = Window.partitionBy("key", *per)
    all_scored = fits.join(scores, ["key", "k"], "left").withColumn("best", F.max("ic").over(of))
    eligible = all_scored.where((F.col("ic") >= F.col("best") - md.TIE) | F.col("best").isNull())
    return stored(eligible.withColumn("first", F.min("k").over(of)).where("k = first").select("key", "k", "estimator", "penalty", "mix", "ic", "beta", "intercept", "mean", "scale"), "walk-forward-chosen")


def _tested(panel: DataFrame, found: Sequence[Task], columns: Sequence[str]) -> DataFrame:
    return rows_of(panel.select("code", "date", "permno", *columns), [(t.month, t.test_first, t.test_last) for t in found])


def walk_forward(panel: DataFrame, found: Sequence[Task], columns: Sequence[str], target: str = "q", fit: Fit = md.candidates, per: Sequence[str] = (), complete: bool = False, wide: Wide = as_they_are) -> DataFrame:
    """Forecasts of every task's test month by the candidate of best mean daily rank correlation on its validation block; with
    ``per`` (such as "estimator"), by the best candidate of each.

    ``panel``: code (session), date, permno, the columns and the target. Returns month, date, permno, estimator, penalty, mix,
    ic (of validation; null where no date has one, and then the first candidate stands) and prediction. ``complete``: no column
    is ever missing; then ``wide`` may make the columns that are fitted from these, in the tasks, a few rows at a time.
    """
    chosen = _chosen(panel, found, columns, target, fit, per, complete, wide)
    if complete:
        return forecast_wide(_tested(panel, found, columns), chosen, columns, wide)
    return forecast(_tested(panel, found, columns), chosen, columns).select(F.col("key").alias("month"), "date", "permno", "estimator", "penalty", "mix", "ic", "prediction")


def refit_spans(task: Task, policy: str) -> list[tuple[int, int]]:
    """Sessions of the final fit: 'retain' the fit block, 'recent' as many up to the end of validation, 'union' both blocks."""
    fit, valid = (task.fit_first, task.fit_last), (task.valid_first, task.valid_last)
    spans = {"retain": [fit], "recent": [(task.valid_last - (task.fit_last - task.fit_first), task.valid_last)], "union": [fit, valid]}
    if policy not in spans:
        raise ValueError(f"no such policy: {policy}")
    return spans[policy]


def refit_forecasts(panel: DataFrame, found: Sequence[Task], columns: Sequence[str], target: str = "q", fit: Fit = md.candidates, policies: Sequence[str] = ("retain", "recent", "union"), complete: bool = False) -> DataFrame:
    """``walk_forward`` with every task's choice fitted again under each policy, the scaler and the penalties that are shares anew.

    A choice is a place in the menu, which ``fit`` must give in one order for every window. All final windows are sums of
    blocks of one pass; a union is the sum of its two windows. Returns month, policy, date, permno, estimator, penalty (of the final fit), mix, ic and prediction.
    """
    chosen = _chosen(panel, found, columns, target, fit, (), complete).select(F.col("key").alias("month"), "k", "ic")
    spans = [(f"{t.month}|{policy}", low, high) for t in found for policy in policies for low, high in refit_spans(t, policy)]
    named = F.split("key", "[|]")
    final = fit_windows(panel, spans, columns, target, fit, complete=complete).withColumns({"month": named[0], "policy": named[1]}).drop("key")
    picked = final.join(F.broadcast(chosen), ["month", "k"]).withColumnRenamed("month", "key")  # a row a month
    picked = picked.select("key", "policy", "estimator", "penalty", "mix", "ic", "beta", "intercept", "mean", "scale")
    return forecast(_tested(panel, found, columns), picked, columns).select(F.col("key").alias("month"), "policy", "date", "permno", "estimator", "penalty", "mix", "ic", "prediction")


def expanded_candidates(m: md.Moments) -> list[md.Candidate]:
    """The menu with a ridge penalty between any two powers of ten, a share between any two, and five ratios."""
    ridge = sorted({*md.RIDGE, *(3.0 * 10.0**e for e in range(-6, 3))}, reverse=True)
    shares = sorted({*md.SHARES, *(float(np.sqrt(a * b)) for a, b in zip(md.SHARES, md.SHARES[1:], strict=False))}, reverse=True)
    return md.candidates(m, ridge, shares, EXPANDED_MIXES)


def stability(panel: DataFrame, found: Sequence[Task], columns: Sequence[str], target: str = "q", fit: Fit = md.candidates) -> DataFrame:
    """month, left_out, n_dates, estimator, penalty, mix, ic, gap, same: the choice of every task with each month of its validation block left out.

    ``ic`` is the mean over the dates that remain, ``gap`` its lead over the second best (null for a lone candidate), ``same`` whether the whole
    block chooses alike. Sums by month are taken once and subtracted; forecasts are not touched.
    """
    fits = fit_windows(panel, [(t.month, t.fit_first, t.fit_last) for t in found], columns, target, fit)
    daily = _cross_sections(rows_of(panel, [(t.month, t.valid_first, t.valid_last) for t in found]), fits, columns, target, _daily_ic, ["ic"])
    by_month = daily.where("ic is not null").groupBy("key", "k", F.date_format("date", "yyyy-MM").alias("left_out")).agg(F.sum("ic").alias("s"), F.count("*").alias("n"))
    whole = Window.partitionBy("key", "k")
    sums = stored(by_month.withColumns({"all_s": F.sum("s").over(whole), "all_n": F.sum("n").over(whole)}), "stability")

    def chosen(scores: DataFrame, by: Sequence[str]) -> DataFrame:
        """The first candidate within the tie, with its lead."""
        group = Window.partitionBy(*by)
        ranked = scores.withColumns({"best": F.max("score").over(group), "place": F.row_number().over(group.orderBy(F.desc("score"), "k"))})
        gaps = F.max(F.when(F.col("place") == 1, F.col("score"))) - F.max(F.when(F.col("place") == 2, F.col("score")))
        first = F.min(F.when(F.col("score") >= F.col("best") - md.TIE, F.struct("k", "score")))
        return ranked.groupBy(*by).agg(first.alias("c"), gaps.alias("gap"), F.first("remaining").alias("n_dates"))

    rest = sums.where("all_n > n").select("key", "k", "left_out", ((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))).alias("score"), (F.col("all_n") - F.col("n")).alias("remaining"))
    full = chosen(sums.select("key", "k", (F.col("all_s") / F.col("all_n")).alias("score"), F.col("all_n").alias("remaining")).distinct(), ["key"]).select("key", F.col("c.k").alias("full_k"))
    out = chosen(rest, ["key", "left_out"]).join(full, "key").select("key", "left_out", "n_dates", F.col("c.k").alias("k"), F.col("c.score").alias("ic"), "gap", (F.col("c.k") == F.col("full_k")).alias("same"))
    return out.join(fits.select("key", "k", "estimator", "penalty", "mix"), ["key", "k"]).select(F.col("key").alias("month"), "left_out", "n_dates", "estimator", "penalty", "mix", "ic", "gap", "same")


def history_forecasts(panel: DataFrame, by_history: dict[int, Sequence[Task]], columns: Sequence[str], target: str = "q", fit: Fit = md.candidates) -> DataFrame:
    """Forecasts of every test month by the best candidate of the best length of history: month, date, permno, history, estimator, penalty, mix, ic, prediction.

    ``by_history``: sessions of the fit block -> tasks, in the order in which equal scores are settled. All
    histories of a month are scored on its one validation block, in the same pass; months that lack one of them are left out.
    """
    order = {h: i for i, h in enumerate(by_history)}
    common = set.intersection(*({t.month for t in found} for found in by_history.values()))
    jobs = [(f"{t.month}/{h}", t) for h, found in by_history.items() for t in found if t.month in common]
    fits = fit_windows(panel, [(key, t.fit_first, t.fit_last) for key, t in jobs], columns, target, fit)
    daily = _cross_sections(rows_of(panel, [(key, t.valid_first, t.valid_last) for key, t in jobs]), fits, columns, target, _daily_ic, ["ic"])
    parts = F.split("key", "/")
    scored = fits.join(daily.groupBy("key", "k").agg(F.avg("ic").alias("ic")), ["key", "k"], "left").withColumns({"month": parts[0], "history": parts[1].cast("int")})
    declared = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))[F.col("history")]
    of = Window.partitionBy("month")
    near = scored.withColumn("best", F.max("ic").over(of)).where((F.col("ic") >= F.col("best") - md.TIE) | F.col("best").isNull())
    chosen = near.withColumn("place", F.row_number().over(of.orderBy(declared, "k"))).where("place = 1").drop("key").withColumnRenamed("month", "key")
    chosen = stored(chosen.select("key", "history", "estimator", "penalty", "mix", "ic", "beta", "intercept", "mean", "scale"), "history-chosen")
    tests = {t.month: (t.month, t.test_first, t.test_last) for _, t in jobs}
    tested = rows_of(panel.select("code", "date", "permno", *columns), list(tests.values()))
    return forecast(tested, chosen, columns).select(F.col("key").alias("month"), "date", "permno", "history", "estimator", "penalty", "mix", "ic", "prediction")


def past_candidates(estimators: Sequence[str] = ("ols", "ridge", "lasso", "enet")) -> Fit:
    """Menu of the choice by past months, on standardised columns: penalties a row for ridge, shares for L1."""

    def fit(m: md.Moments) -> list[md.Candidate]:
        out: list[md.Candidate] = []

        def add(estimator: str, l2: float, l1: float, beta: np.ndarray) -> None:
            out.append(md.Candidate(estimator, l2, l1, beta, float(m.y_mean - m.x_mean @ beta), 0.0))

        top = float(np.abs(m.cross).max(initial=0.0))
        for name in estimators:
            if name in ("ols", "ridge"):
                menu = (0.0,) if name == "ols" else PAST_RIDGE
                for l2, beta in zip(menu, md.spectral(m, menu), strict=True):
                    add(name, l2, 0.0, beta)
            beta = None
            for l2, l1 in ((0.0, l1) for l1 in PAST_LASSO) if name == "lasso" else PAST_ENET if name == "enet" else ():
                beta = md.elastic_net(m, l1 * top, l2, beta)
                add(name, l2, l1, beta.copy())
        return out

    return fit


def past_choices(panel: DataFrame, windows: Sequence[tuple[str, int, int, int, int]], columns: Sequence[str], target: str, estimators: Sequence[str] = ("ols", "ridge", "lasso", "enet")) -> tuple[DataFrame, DataFrame]:
    """The candidate of each month, estimator and criterion ('sse' or 'rankcorr') by the record of the 12 months before it.

    ``windows``: month, first and last session of the fit, of the month. Only months with a fit and labels have a record; the
    first of them takes the default of its menu. Records equal to 10 places: the candidate declared first. Returns the choices (key, criterion,
    estimator, penalty, mix, the month's own sse and rankcorr) and the fits.
    """
    fits = fit_windows(panel, [w[:3] for w in windows], columns, target, past_candidates(estimators), by_date=False)
    daily = _cross_sections(rows_of(panel, [(w[0], w[3], w[4]) for w in windows]), fits, columns, target, _past_record, ["sse", "rankcorr"])
    monthly = daily.groupBy("key", "k").agg(F.sum("sse").alias("sse"), F.avg("rankcorr").alias("rankcorr"))
    records = monthly.join(fits.select("key", "k", "estimator", "penalty", "mix"), ["key", "k"])
    past = Window.partitionBy("k").orderBy("key").rowsBetween(-PAST_MONTHS, -1)
    is_default = F.lit(False)
    for name, (l2, l1) in PAST_DEFAULT.items():
        is_default |= (F.col("estimator") == name) & (F.col("penalty") == l2) & (F.col("mix") == l1)
    scored = records.withColumns({"past_sse": F.round(F.sum("sse").over(past), 10), "past_rankcorr": F.round(F.avg("rankcorr").over(past), 10)})
    out = None
    for criterion, order in (("sse", F.asc("past_sse")), ("rankcorr", F.desc("past_rankcorr"))):
        place = F.row_number().over(Window.partitionBy("key", "estimator").orderBy(order, F.when(is_default & F.col("past_sse").isNull(), 0).otherwise(1), "k"))
        one = scored.withColumn("place", place).where("place = 1").select("key", F.lit(criterion).alias("criterion"), "k", "estimator", "penalty", "mix", "sse", "rankcorr")
        out = one if out is None else out.unionByName(one)
    return out, fits


def past_forecasts(panel: DataFrame, windows: Sequence[tuple[str, int, int, int, int]], columns: Sequence[str], target: str) -> DataFrame:
    """month, criterion, estimator, penalty, mix, date, permno, prediction of every month's choices."""
    choices, fits = past_choices(panel, windows, columns, target)
    chosen = stored(choices.select("key", "k", "criterion").join(fits, ["key", "k"]), "past-choices")
    tested = rows_of(panel.select("code", "date", "permno", *columns), [(w[0], w[3], w[4]) for w in windows])
    return forecast(tested, chosen, columns).select(F.col("key").alias("month"), "criterion", "estimator", "penalty", "mix", "date", "permno", "prediction")


def _path(m: md.Moments, mix: float, penalties: Sequence[float]) -> list[np.ndarray]:
    beta, out = None, []
    for a in penalties:
        beta = md.elastic_net(m, a * mix, a * (1 - mix), beta)
        out.append(beta.copy())
    return out


def _held_error(s: np.ndarray, beta: np.ndarray, intercept: float) -> float:
    """Mean squared error on rows whose sums of products of (1, x, y) are ``s``."""
    v = np.concatenate(([-intercept], -beta, [1.0]))
    return float(v @ s @ v / s[0, 0])


def cross_validated(folds: Sequence[np.ndarray]) -> dict[str, md.Candidate]:
    """Ridge, lasso and elastic net with the penalty of best mean score over held-out folds, refitted on all.

    ``folds``: sums of products of (1, scaled columns, target) of each fold, with a last row for counts left out. Training sums are
    the whole's less a fold's. Ridge takes the greatest mean R squared of ``CV_RIDGE`` (sums of squares, not means, are
    penalised); the others the least mean squared error along 100 penalties a ratio, from the least that zeroes all
    on all rows down to a thousandth of it. Equal scores: the first, ratios in their order, ridge penalties rising.
    """
    folds = [f for f in folds if f[0, 0] > 0]
    whole = sum(folds)
    moments_of = lambda s: md.centred(np.append(s.ravel(), s[0, 0]))
    all_rows = moments_of(whole)
    spread = [f[-1, -1] / f[0, 0] - (f[0, -1] / f[0, 0]) ** 2 for f in folds]
    scores: dict[str, list[tuple[float, float, float]]] = {"ridge": [], "lasso": [], "enet": []}
    top = float(np.abs(all_rows.cross).max(initial=0.0))
    menus = {mix: [top / mix * CV_LEAST ** (i / (CV_STEPS - 1)) for i in range(CV_STEPS)] for mix in CV_MIXES}
    trained = [moments_of(whole - f) for f in folds]
    ridge = [md.spectral(m, [a / m.n for a in CV_RIDGE]) for m in trained]
    error = lambda m, f, beta: _held_error(f, beta, float(m.y_mean - m.x_mean @ beta))
    for i, a in enumerate(CV_RIDGE):
        scores["ridge"].append((float(np.mean([1 - error(m, f, r[i]) / v if v > 0 else 0.0 for m, f, r, v in zip(trained, folds, ridge, spread, strict=True)])), a, 0.0))
    for mix, menu in menus.items():
        paths = [_path(m, mix, menu) for m in trained]
        for i, a in enumerate(menu):
            found = (-float(np.mean([error(m, f, p[i]) for m, f, p in zip(trained, folds, paths, strict=True)])), a, mix)
            scores["enet"].append(found)
            if mix == 1.0:
                scores["lasso"].append(found)
    out = {}
    for name, menu in scores.items():
        _, a, mix = menu[int(np.argmax([s[0] for s in menu]))]
        beta = md.spectral(all_rows, [a / all_rows.n])[0] if name == "ridge" else md.elastic_net(all_rows, a * mix, a * (1 - mix))
        out[name] = md.Candidate(name, a, mix, beta, float(all_rows.y_mean - all_rows.x_mean @ beta), 0.0)
    return out


def cross_validated_forecasts(panel: DataFrame, windows: Sequence[tuple[str, int, int, int, int]], columns: Sequence[str], target: str, folds: int = 5) -> DataFrame:
    """month, date, permno, estimator, penalty, mix, prediction: every month by ridge, lasso and elastic net tuned on contiguous folds of its window's sessions."""
    spans = [(f"{key}/{i}", int(c[0]), int(c[-1])) for key, low, high, _, _ in windows for i, c in enumerate(np.array_split(np.arange(low, high + 1), folds)) if len(c)]
    cells = window_cells(panel, spans, columns, target, by_date=False).withColumn("month", F.split("key", "/")[0])
    p = len(columns)

    def run(rows: pa.Table) -> pa.Table:
        names = np.array(rows["key"].to_pylist())
        place, v = rows["cell"].to_numpy(), rows["v"].to_numpy()
        order = np.argsort(place, kind="stable")
        at, which = np.unique(place[order], return_inverse=True)
        _, mean, scale = _window_moments(at, np.bincount(which, v[order]), p, False) if (place >= 0).any() else (None, None, None)
        out: dict[str, list] = {c.split()[0]: [] for c in _FOUND.split(", ")}
        if mean is not None:
            sums = [_scaled_sums(place[names == n], v[names == n], mean, scale) for n in sorted(set(names.tolist()))]
            if sum(s[0, 0] > 0 for s in sums) > 1:
                for k, c in enumerate(cross_validated(sums).values()):
                    for name, value in (("key", rows["month"][0].as_py()), ("k", k), ("estimator", c.estimator), ("penalty", c.penalty), ("mix", c.mix), ("beta", c.beta.tolist()), ("intercept", c.intercept), ("mean", mean.tolist()), ("scale", scale.tolist()), ("n", int(sum(s[0, 0] for s in sums)))):
                        out[name].append(value)
        return pa.table({c.split()[0]: pa.array(out[c.split()[0]], _KINDS[c.split()[1]]) for c in _FOUND.split(", ")})

    fits = stored(cells.groupBy("month").applyInArrow(run, _FOUND), "cross-validated")
    tested = rows_of(panel.select("code", "date", "permno", *columns), [(w[0], w[3], w[4]) for w in windows])
    return forecast(tested, fits.drop("k", "n"), columns).select(F.col("key").alias("month"), "date", "permno", "estimator", "penalty", "mix", "prediction")


def legacy_spans(calendar: Sequence[str], months: Iterable[str], window: int = 252) -> Iterator[tuple[str, int, int, int, int]]:
    """Sessions of the windows that end two calendar days before a month, and of the month; months without a whole window are left out."""
    from .splits import legacy_windows

    at = {d: i for i, d in enumerate(calendar)}
    for month, first, last in legacy_windows(calendar, [*months], window):
        inside = [i for i, d in enumerate(calendar) if d[:7] == month]
        if inside:
            yield month, at[first], at[last], inside[0], inside[-1]
