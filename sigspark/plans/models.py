"""Walk-forward models on sufficient statistics.

A window of any size is reduced to one Gram matrix by partial sums in the tasks; all that is fitted
afterwards (least squares, ridge, lasso, elastic net, group ridge, component models) needs only that
matrix, a few hundred columns square. Predictions go back to the rows as a dot product.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite

RIDGE = tuple(float(10.0**k) for k in range(3, -7, -1))
# Penalties as shares of the least one that zeroes all coefficients, and the mixing ratios.
SHARES = (1.0, 0.3, 0.1, 0.03, 0.01, 0.003, 0.001, 0.0003, 0.0001)
MIXES = (0.1, 0.5, 0.9)
TIE = 1e-12


def equal_date_weights(rows: DataFrame, date: str = "date", name: str = "weight") -> DataFrame:
    """1 / (dates * rows of the date): every date weighs the same, and all sum to one."""
    dates = rows.agg(F.count_distinct(date).alias("__dates"))
    per_date = F.count("*").over(Window.partitionBy(date))
    return rows.crossJoin(F.broadcast(dates)).withColumn(name, 1.0 / (F.col("__dates") * per_date)).drop("__dates")  # one row on the right


def weighted_scaler(rows: DataFrame, columns: Sequence[str], weight: str = "weight", binary: Sequence[str] = ()) -> dict[str, tuple[float, float]]:
    """column -> (mean, scale) from weighted moments of its finite values; one aggregation for all columns.

    Weights are renewed to sum to one over the finite values. A constant or absent column has scale 1; binary
    ones stay as they are.
    """
    aggs = []
    for c in columns:
        x = finite(F.col(c).cast("double"))
        w = F.when(x.isNotNull(), F.col(weight))
        aggs += [F.sum(w).alias(f"w_{c}"), F.sum(w * x).alias(f"s_{c}"), F.sum(w * x * x).alias(f"q_{c}")]
    row = rows.agg(*aggs).first()
    out = {}
    for c in columns:
        mass = row[f"w_{c}"] or 0.0
        mean = row[f"s_{c}"] / mass if mass else 0.0
        variance = row[f"q_{c}"] / mass - mean * mean if mass else 0.0
        out[c] = (0.0, 1.0) if c in binary else (mean, float(np.sqrt(variance)) if variance > 1e-20 else 1.0)
    return out


def scaled(columns: Sequence[str], scaler: dict[str, tuple[float, float]]) -> Column:
    """Feature array of the scaled columns; a missing value is the mean, zero."""
    parts = []
    for c in columns:
        mean, scale = scaler[c]
        parts.append(F.coalesce((finite(F.col(c).cast("double")) - mean) / scale, F.lit(0.0)))
    return F.array(*parts)


@dataclass
class Moments:
    """Centered weighted second moments of features and target."""

    gram: np.ndarray
    cross: np.ndarray
    x_mean: np.ndarray
    y_mean: float
    y_variance: float
    n: int

    def of(self, columns: Sequence[int]) -> Moments:
        at = np.asarray(columns, int)
        return Moments(self.gram[np.ix_(at, at)], self.cross[at], self.x_mean[at], self.y_mean, self.y_variance, self.n)

    def mapped(self, m: np.ndarray) -> Moments:
        """Moments of the features X @ m; no row is touched."""
        return Moments(m.T @ self.gram @ m, m.T @ self.cross, self.x_mean @ m, self.y_mean, self.y_variance, self.n)


def cell_sums(rows: DataFrame, by: Sequence[str] = (), features: str = "features", target: str = "q", weight: str = "weight") -> DataFrame:
    """by, cell, v: weighted sums of products of (1, features, target) of each group, one triangle of a square by rows, and
    in the cell past the square the count. Tasks send one triangle per group they hold; Spark adds these cell by cell, so no task sees many matrices.

    Rows with a missing or non-finite feature, target or weight take no part.
    """
    keys = [*by]

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["f"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            z = np.column_stack((np.ones(len(x)), x, batch["y"].to_numpy(zero_copy_only=False)))
            w = batch["w"].to_numpy(zero_copy_only=False)
            groups = list(zip(*(batch[k].to_pylist() for k in keys), strict=True)) if keys else [()] * len(x)
            order: dict[tuple, list[int]] = {}
            for i in np.flatnonzero(np.isfinite(z).all(axis=1) & np.isfinite(w)).tolist():
                order.setdefault(groups[i], []).append(i)
            for g, at in order.items():
                part = np.append((z[at] * w[at, None]).T @ z[at], len(at))
                held[g] = held[g] + part if g in held else part
        for g, m in held.items():
            side = math.isqrt(len(m) - 1)
            cells = np.append(np.flatnonzero(np.triu(np.ones((side, side), bool))), side * side)
            columns = [pa.array([v] * len(cells), type_) for v, type_ in zip(g, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cells, pa.int64()), pa.array(m[cells])], names=[*keys, "cell", "v"])

    from pyspark.sql.pandas.types import to_arrow_type

    source = rows.select(*keys, F.col(features).alias("f"), F.col(target).cast("double").alias("y"), F.col(weight).cast("double").alias("w")).where("y is not null and f is not null")
    kinds = [to_arrow_type(source.schema[k].dataType) for k in keys]
    fields = "".join(f"`{k}` {source.schema[k].dataType.simpleString()}, " for k in keys)
    return source.mapInArrow(partial, f"{fields}cell long, v double").groupBy(*keys, "cell").agg(F.sum("v").alias("v"))


def moments(rows: DataFrame, by: Sequence[str] = (), features: str = "features", target: str = "q", weight: str = "weight") -> dict[tuple, Moments]:
    """Moments of each group, from ``cell_sums``."""
    keys = [*by]
    summed = cell_sums(rows, by, features, target, weight).toArrow()
    cells, sums = summed["cell"].to_numpy(), summed["v"].to_numpy()
    places: dict[tuple, list[int]] = {}
    for i, g in enumerate(zip(*(summed[k].to_pylist() for k in keys), strict=True) if keys else [()] * len(cells)):
        places.setdefault(g, []).append(i)
    out = {}
    for g, at in places.items():
        flat = np.zeros(cells[at].max() + 1)
        flat[cells[at]] = sums[at]
        half = flat[:-1].reshape(math.isqrt(len(flat) - 1), -1)
        half += np.triu(half, 1).T  # a view of flat
        out[g] = centred(flat)
    return out


def centred(flat: np.ndarray) -> Moments:
    """Moments from sums of products of (1, features, target) and the count behind them."""
    n, side = int(flat[-1]), int(round(np.sqrt(len(flat) - 1)))
    s = flat[:-1].reshape(side, side)
    mass = s[0, 0]
    s = s / mass
    mean = s[0, 1:]
    c = s[1:, 1:] - np.outer(mean, mean)
    c = (c + c.T) / 2
    gram, cross = c[:-1, :-1].copy(), c[:-1, -1].copy()
    still = np.diag(gram) <= 1e-14 * np.maximum(1.0, mean[:-1] ** 2)
    gram[still, :] = gram[:, still] = 0.0
    cross[still] = 0.0
    return Moments(gram, cross, mean[:-1].copy(), float(mean[-1]), float(c[-1, -1]), n)


@dataclass
class Candidate:
    estimator: str
    penalty: float
    mix: float
    beta: np.ndarray
    intercept: float
    kkt: float


def kkt(m: Moments, beta: np.ndarray, l1: float, l2: float) -> float:
    """How far the solution is from optimal: the greatest violation of the first-order conditions."""
    slope = m.cross - m.gram @ beta - l2 * beta
    on = beta != 0
    return float(max(np.abs(slope[on] - l1 * np.sign(beta[on])).max(initial=0.0), (np.abs(slope[~on]) - l1).max(initial=0.0), 0.0))


def duality_gap(m: Moments, beta: np.ndarray, l1: float, l2: float) -> float:
    """Primal minus dual value of 1/2 E(y - xb)^2 + l1 |b| + l2/2 b^2 (with l2 folded into the quadratic part)."""
    gram = m.gram + l2 * np.eye(len(beta))
    residual = m.y_variance - 2 * m.cross @ beta + beta @ gram @ beta
    worst = np.abs(m.cross - gram @ beta).max(initial=0.0)
    shrink = min(1.0, l1 / worst) if worst > 0 else 1.0
    primal = residual / 2 + l1 * np.abs(beta).sum()
    dual = shrink * (m.y_variance - m.cross @ beta) - shrink * shrink * residual / 2
    return float(max(primal - dual, 0.0))


def coordinate_descent(m: Moments, l1: float, l2: float, start: np.ndarray | None = None, tolerance: float = 1e-11, sweeps: int = 20_000) -> np.ndarray:
    """Elastic net on the Gram matrix: cyclic soft thresholding, active coordinates first, then a check of all."""
    beta = np.zeros(len(m.cross)) if start is None else start.copy()
    curve = np.diag(m.gram) + l2
    slope = m.cross - m.gram @ beta
    live = np.flatnonzero(curve > 0)
    for _ in range(sweeps):
        moved = 0.0
        for j in live:
            old = beta[j]
            u = slope[j] + m.gram[j, j] * old
            new = np.sign(u) * max(abs(u) - l1, 0.0) / curve[j]
            if new != old:
                beta[j] = new
                slope -= m.gram[:, j] * (new - old)
                moved = max(moved, abs(new - old) * curve[j])
        if moved <= tolerance:
            everything = np.flatnonzero(np.diag(m.gram) + l2 > 0)
            if len(live) == len(everything):
                return beta
            live = everything
        else:
            live = np.flatnonzero((beta != 0) & (curve > 0)) if moved < 1e-3 and np.any(beta != 0) else live
    return beta


def feature_sign(m: Moments, l1: float, l2: float, start: np.ndarray, tolerance: float = 1e-11, steps: int = 5_000) -> np.ndarray:
    """Exact end of an elastic-net descent, for nearly collinear columns where coordinates creep.

    With the signs of the non-zero coefficients held, the problem is a linear system. Go from the current
    point towards its solution, to the place of least objective among the points where a coefficient
    passes zero and the solution itself; when no move helps, let the worst coordinate in. (Feature-sign
    search: Lee, Battle, Raina and Ng, 2006.)
    """
    gram, beta = m.gram + l2 * np.eye(len(start)), start.copy()
    value = lambda b: b @ gram @ b / 2 - m.cross @ b + l1 * np.abs(b).sum()
    for _ in range(steps):
        slope = gram @ beta - m.cross
        sign = np.sign(beta)
        on = sign != 0
        if np.abs(slope[on] + l1 * sign[on]).max(initial=0.0) <= tolerance:
            pull = np.where(on, 0.0, np.abs(slope))
            worst = int(pull.argmax()) if len(pull) else 0
            if not len(pull) or pull[worst] <= l1 + tolerance:
                return beta
            sign[worst] = -np.sign(slope[worst])
            on[worst] = True
        at = np.flatnonzero(on)
        goal = np.linalg.lstsq(gram[np.ix_(at, at)], m.cross[at] - l1 * sign[at], rcond=1e-12)[0]
        way = goal - beta[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            stops = -beta[at] / way
        best = None
        for t in [1.0, *stops[(stops > 0) & (stops < 1)].tolist()]:
            b = beta.copy()
            b[at] += t * way
            b[at[np.abs(stops - t) <= 1e-14]] = 0.0
            if best is None or value(b) < best[0]:
                best = (value(b), b)
        if np.array_equal(best[1], beta):
            return beta
        beta = best[1]
    return beta


def elastic_net(m: Moments, l1: float, l2: float, start: np.ndarray | None = None) -> np.ndarray:
    return feature_sign(m, l1, l2, coordinate_descent(m, l1, l2, start, sweeps=500))


def spectral(m: Moments, ridge: Sequence[float]) -> list[np.ndarray]:
    """Ridge solutions for all penalties from one eigendecomposition; penalty 0 is minimum-norm least squares."""
    values, basis = np.linalg.eigh(m.gram)
    cut = max(float(values.max(initial=0.0)), 1.0) * 1e-12
    along = basis.T @ m.cross
    out = []
    for a in ridge:
        inverse = np.where(values > cut, 1.0 / np.where(values > cut, values, 1.0), 0.0) if a == 0 else 1.0 / (np.maximum(values, 0) + a)
        out.append(basis @ (along * inverse))
    return out


def candidates(m: Moments, ridge: Sequence[float] = RIDGE, shares: Sequence[float] = SHARES, mixes: Sequence[float] = MIXES) -> list[Candidate]:
    """The declared menu in order: least squares, ridge, lasso, elastic net; each passes its optimality check."""
    out: list[Candidate] = []

    def add(estimator: str, penalty: float, mix: float, beta: np.ndarray) -> None:
        l1, l2 = penalty * mix, penalty * (1 - mix)
        wrong = kkt(m, beta, l1, l2)
        if wrong > 2e-7:
            raise RuntimeError(f"{estimator} with penalty {penalty:g} is not optimal: {wrong:.2g}")
        out.append(Candidate(estimator, penalty, mix, beta, float(m.y_mean - m.x_mean @ beta), wrong))

    for a, beta in zip((0.0, *ridge), spectral(m, (0.0, *ridge)), strict=True):
        add("ridge" if a else "ols", a, 0.0, beta)
    top = float(np.abs(m.cross).max(initial=0.0))
    for estimator, among in (("lasso", (1.0,)), ("enet", mixes)):
        for mix in among:
            beta = None
            for share in shares:
                penalty = share * top / mix
                beta = elastic_net(m, penalty * mix, penalty * (1 - mix), beta)
                add(estimator, penalty, mix, beta.copy())
    return out


def group_ridge(m: Moments, groups: Sequence[Sequence[int]], penalties: Sequence[float]) -> np.ndarray:
    """Ridge with a penalty for each group of columns; an infinite penalty drops the group."""
    penalty = np.zeros(len(m.cross))
    for at, a in zip(groups, penalties, strict=True):
        penalty[list(at)] = a
    on = np.isfinite(penalty)
    beta = np.zeros(len(penalty))
    root = 1.0 / np.sqrt(np.where(penalty[on] > 0, penalty[on], 1e-12))
    white = m.of(np.flatnonzero(on)).mapped(np.diag(root))
    beta[on] = root * spectral(white, (1.0,))[0]
    return beta


def principal_components(covariance: np.ndarray, k: int) -> np.ndarray:
    """Loadings of the first k components scaled to unit deviation; the greatest loading of each is positive."""
    values, basis = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:k]
    vectors = basis[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return vectors / np.sqrt(np.maximum(values[order], 1e-300))


def predict(features: str, beta: np.ndarray, intercept: float) -> Column:
    """The dot product as a built-in expression, written out where it is short: that compiles to plain code."""
    if len(beta) <= 64:
        total = F.lit(float(intercept))
        for i, b in enumerate(beta):
            if b:
                total = total + F.get(features, F.lit(i)) * float(b)
        return total
    weights = F.array(*(F.lit(float(b)) for b in beta))
    return F.aggregate(F.zip_with(F.col(features), weights, lambda x, w: x * w), F.lit(float(intercept)), lambda s, x: s + x)


def _daily_scores(rows: DataFrame, found: Sequence[Candidate], target: str, features: str, chunk: int) -> Iterator[DataFrame]:
    """k, date, rank_ic of candidates, ``chunk`` of them per pass; the target is ranked once for each pass."""
    from .evaluation import rank_ic, ranked_target

    ranked = ranked_target(rows, target)
    for i in range(0, len(found), chunk):
        models = F.array(*(F.struct(F.lit(i + j).alias("k"), F.round(predict(features, c.beta, c.intercept), 14).alias("p")) for j, c in enumerate(found[i : i + chunk])))
        long = ranked.select("date", target, "target_rank", F.explode(models).alias("m")).select("date", target, "target_rank", "m.k", "m.p")
        yield rank_ic(long, "p", target, ("k", "date"), target_rank="target_rank")


def monthly_scores(rows: DataFrame, found: Sequence[Candidate], target: str, features: str = "features", chunk: int = 16) -> dict[str, list[float | None]]:
    """Mean daily rank correlation of each candidate by calendar month."""
    out: dict[str, list[float | None]] = {}
    for daily in _daily_scores(rows, found, target, features, chunk):
        for r in daily.groupBy("k", F.date_format("date", "yyyy-MM").alias("month")).agg(F.avg("rank_ic").alias("ic")).collect():
            out.setdefault(r["month"], [None] * len(found))[r["k"]] = r["ic"]
    return out


def score_candidates(rows: DataFrame, found: Sequence[Candidate], target: str, features: str = "features", chunk: int = 16) -> list[float | None]:
    """Mean daily rank correlation of each candidate on validation rows, ``chunk`` of them per pass."""
    out: dict[int, float | None] = {}
    for daily in _daily_scores(rows, found, target, features, chunk):
        out |= {r["k"]: r["ic"] for r in daily.groupBy("k").agg(F.avg("rank_ic").alias("ic")).collect()}
    return [out.get(k) for k in range(len(found))]


def first_best(scores: Sequence[float | None], tie: float = TIE) -> int:
    """The first place within ``tie`` of the best score; missing scores lose."""
    known = [s for s in scores if s is not None]
    if not known:
        raise ValueError("no candidate has a score")
    return next(i for i, s in enumerate(scores) if s is not None and s >= max(known) - tie)


def choose(rows: DataFrame, found: Sequence[Candidate], target: str, features: str = "features") -> tuple[Candidate, list[float | None]]:
    scores = score_candidates(rows, found, target, features)
    return found[first_best(scores)], scores


def refit_rows(panel: DataFrame, bounds: tuple[int, int, int, int], policy: str) -> DataFrame:
    """Rows for the final fit: 'retain' the fit block, 'recent' as many sessions up to the end of validation, 'union' both."""
    fit_first, fit_last, valid_first, valid_last = bounds
    code = F.col("code")
    if policy == "retain":
        return panel.where(code.between(fit_first, fit_last))
    if policy == "recent":
        return panel.where(code.between(valid_last - (fit_last - fit_first), valid_last))
    if policy == "union":
        return panel.where(code.between(fit_first, fit_last) | code.between(valid_first, valid_last))
    raise ValueError(f"no such policy: {policy}")


def stable_without_each_month(monthly: dict[str, Sequence[float | None]]) -> dict[str, int]:
    """The choice that is made when a month is left out of the validation mean, for each month."""
    months = sorted(monthly)
    size = len(next(iter(monthly.values())))
    out = {}
    for left in months:
        means = [[monthly[m][k] for m in months if m != left and monthly[m][k] is not None] for k in range(size)]
        out[left] = first_best([sum(v) / len(v) if v else None for v in means])
    return out


def tree_model(kind: str = "tree", depth: int = 5, least_leaf: int = 1, trees: int = 100, seed: int = 0):
    """A Spark ML regressor; leaf counts and cost pruning have no counterpart there, depth and leaf size do."""
    from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor

    common = dict(featuresCol="vector", labelCol="label", maxDepth=depth, minInstancesPerNode=least_leaf, seed=seed)
    return RandomForestRegressor(numTrees=trees, **common) if kind == "forest" else DecisionTreeRegressor(**common)


def fit_trees(rows: DataFrame, test: DataFrame, target: str, features: str = "features", **options) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    ready = lambda d: d.withColumn("vector", array_to_vector(F.col(features)))
    model = tree_model(**options).fit(ready(rows).select("vector", F.col(target).cast("double").alias("label")))
    return model.transform(ready(test)).drop("vector")


def contiguous_folds(codes: Sequence[int], folds: int = 5) -> list[tuple[int, int]]:
    """First and last code of unshuffled folds of date-sorted rows (``codes``: one per date, in order)."""
    cut = np.array_split(np.asarray(codes), folds)
    return [(int(c[0]), int(c[-1])) for c in cut if len(c)]


def cross_validated(rows: DataFrame, folds: int, ridge: Sequence[float] = (), mixes: Sequence[float] = (), shares: Sequence[float] = SHARES) -> Candidate:
    """The penalty of least mean squared error over contiguous date folds, refitted on all rows.

    One pass gives the moments of every fold; those of a training set are sums of the others', so no fold
    is read twice, and errors of held-out folds follow from their own moments.
    """
    coded = rows.where("q is not null")
    codes = [r[0] for r in coded.select("code").distinct().orderBy("code").collect()]
    bounds = contiguous_folds(codes, folds)
    number = F.lit(0)
    for k, (low, high) in enumerate(bounds):
        number = F.when(F.col("code").between(low, high), k).otherwise(number)
    by_fold = moments(coded.withColumn("fold", number).withColumn("w1", F.lit(1.0)), ["fold"], weight="w1")
    raw = {k[0]: _raw(m) for k, m in by_fold.items()}
    total = sum(raw.values())

    def fits(m: Moments) -> list[Candidate]:
        return candidates(m, ridge, shares if mixes else (), tuple(x for x in mixes if x < 1)) if mixes or ridge else candidates(m, (), (), ())

    errors = None
    for held in raw.values():
        found = fits(centred(total - held))
        own = np.array([_error(held, c) for c in found])
        errors = own if errors is None else errors + own
    final = fits(centred(total))
    return final[first_best([-float(e) for e in errors], tie=0.0)]


def _raw(m: Moments) -> np.ndarray:
    """Sums of products of (1, x, y), flattened, and the count: moments undone, so that groups add up."""
    mean = np.concatenate(([1.0], m.x_mean, [m.y_mean]))
    c = np.zeros((len(mean), len(mean)))
    c[1:-1, 1:-1], c[1:-1, -1], c[-1, 1:-1], c[-1, -1] = m.gram, m.cross, m.cross, m.y_variance
    return np.append((c + np.outer(mean, mean)) * m.n, m.n)


def _error(raw: np.ndarray, c: Candidate) -> float:
    side = int(round(np.sqrt(len(raw) - 1)))
    s = raw[:-1].reshape(side, side)
    v = np.concatenate(([-c.intercept], -c.beta, [1.0]))
    return float(v @ s @ v)


def select_history(scores: dict[int, float | None], order: Sequence[int] = (504, 252, 756)) -> int:
    """The history length of best validation score; ties go to the order declared."""
    return order[first_best([scores.get(h) for h in order])]


def adaptive_depth(scored: Sequence[tuple[str, float | None, int]]) -> str:
    """Of (name, score, parameters) the best score, then fewer parameters, then the order given."""
    known = [s for s in scored if s[1] is not None]
    best = max(s[1] for s in known)
    return min((s for s in known if s[1] >= best - TIE), key=lambda s: s[2])[0]


def ablation(rows: DataFrame, model: Candidate, groups: dict[str, Sequence[int]], target: str = "q", features: str = "features") -> DataFrame:
    """Loss of mean rank correlation when a group of inputs is held at its mean, zero."""
    from .evaluation import rank_ic

    variants = {"": ()} | {g: tuple(at) for g, at in groups.items()}
    betas = {g: np.where(np.isin(np.arange(len(model.beta)), at), 0.0, model.beta) for g, at in variants.items()}
    long = rows.select("date", target, F.explode(F.array(*(F.struct(F.lit(g).alias("g"), F.round(predict(features, b, model.intercept), 14).alias("p")) for g, b in betas.items()))).alias("m")).select("date", target, "m.g", "m.p")
    ic = rank_ic(long, "p", target, ("g", "date")).groupBy("g").agg(F.avg("rank_ic").alias("ic"))
    base = ic.where("g = ''").select(F.col("ic").alias("full_ic"))
    return ic.where("g <> ''").crossJoin(F.broadcast(base)).select(F.col("g").alias("dropped"), "ic", (F.col("full_ic") - F.col("ic")).alias("importance"))  # one row on the right


def response(spark, model: Candidate, feature: int, points: Sequence[float], second: int | None = None) -> DataFrame:
    """Forecasts on a grid of one input, or two, with all others at zero."""
    others = points if second is not None else (0.0,)
    rows = []
    for a in points:
        for b in others:
            x = np.zeros(len(model.beta))
            x[feature] = a
            if second is not None:
                x[second] = b
            rows.append((float(a), float(b), float(model.intercept + x @ model.beta)))
    return spark.createDataFrame(rows, "first double, second double, prediction double")
