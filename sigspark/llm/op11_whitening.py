"""11. Whitening of embeddings by hierarchical SVD merging.

Each task reduces its vectors, some thousand at a time, to a count, exact sums, and all singular values and right
singular vectors of the centred rows. Two such summaries merge by stacking what they keep under one further row,
sqrt(n1 n2 / (n1 + n2)) times the difference of their means, and taking the SVD anew: the merged factor has exactly
the covariance of all rows of both, and no dimension is cut. Tasks merge what they read, then Spark merges the tasks'
summaries in a tree of ``FAN`` children a node; a summary is as large as the square of the dimensions, whatever
the number of rows. Rows are never multiplied uncentred, so a large common offset costs no digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import floored, usable

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
FAN = 8
BLOCK = 1024
MOST = 2**52  # of a component times the scale; whole numbers up to there are exact as doubles
_INT = 16  # bytes of an exact sum

_SUMMARY = "n long, sums binary, rank long, factor binary"


@dataclass
class Summary:
    """What is kept of some rows: their number, the exact sums of each dimension, and the singular values times
    the right singular vectors of the rows less their mean, as rows of ``factor``."""

    n: int
    sums: list[int]
    factor: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        sums = x.sum(axis=0)
        return cls(len(x), sums.tolist(), _svd(x - sums / len(x)))

    def widened(self, width: int) -> Summary:
        more = width - len(self.sums)
        return Summary(self.n, self.sums + [0] * more, np.pad(self.factor, ((0, 0), (0, more)))) if more else self

    def merged(self, other: Summary) -> Summary:
        width = max(len(self.sums), len(other.sums))
        a, b = self.widened(width), other.widened(width)
        apart = np.array([(s * b.n - t * a.n) / (a.n * b.n) for s, t in zip(a.sums, b.sums, strict=True)])  # whole numbers up to the division
        row = math.sqrt(a.n * b.n / (a.n + b.n)) * apart
        return Summary(a.n + b.n, [s + t for s, t in zip(a.sums, b.sums, strict=True)], _svd(np.vstack((a.factor, b.factor, row[None]))))

    def packed(self) -> tuple[int, bytes, int, bytes]:
        return self.n, b"".join(s.to_bytes(_INT, "little", signed=True) for s in self.sums), len(self.factor), self.factor.astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, n: int, sums: bytes, rank: int, factor: bytes) -> Summary:
        whole = [int.from_bytes(sums[i : i + _INT], "little", signed=True) for i in range(0, len(sums), _INT)]
        return cls(n, whole, np.frombuffer(factor, "<f8").reshape(rank, len(whole)))


def _svd(rows: np.ndarray) -> np.ndarray:
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def _record(found: Summary, **keys: int) -> pa.RecordBatch:
    n, sums, rank, factor = found.packed()
    named = {k: pa.array([v], pa.int64()) for k, v in keys.items()}
    return pa.RecordBatch.from_pydict({**named, "n": pa.array([n], pa.int64()), "sums": pa.array([sums], pa.binary()), "rank": pa.array([rank], pa.int64()), "factor": pa.array([factor], pa.binary())})


def _slices(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, size):
            yield batch.slice(begin, size)


@dataclass
class Whitening:
    """The fit: rows, exact sums (less the offset), all variances, falling, and the components as rows."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray

    @property
    def trace(self) -> float:
        return float(self.variances.sum())

    @property
    def alive(self) -> np.ndarray:
        """Which components vary, beyond what rounding leaves of none."""
        top = self.variances.max(initial=0.0)
        return self.variances > top * (8 * len(self.sums) * np.finfo(float).eps) ** 2 if top > 0 else self.variances > 0

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sum)^2, exact; None beyond 64 bits."""
        far = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if far * far * max(1, len(self.sums)) < 2**63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """Scores of unit variance of the first components; NaN where a component has none."""
        mean = np.array([s / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.alive, 1.0 / np.sqrt(self.variances), np.nan)[:components]
        return (x - mean) @ self.components[:components].T * scale


def fit(table: DataFrame, vector: str = "embedding", scale: float = SCALE) -> Whitening | None:
    """Summaries of all usable vectors, merged in a tree; None if there is none. Only the root reaches the driver."""

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Summary | None = None
        for batch in _slices(batches, BLOCK):
            rows, x = usable(batch["v"])
            if len(rows):
                one = Summary.of(floored(x, scale, MOST))
                held = one if held is None else held.merged(one)
        if held is not None:
            yield _record(held)

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("child")
        held: Summary | None = None
        for r in rows.to_pylist():
            one = Summary.unpacked(r["n"], r["sums"], r["rank"], r["factor"])
            held = one if held is None else held.merged(one)
        return pa.Table.from_batches([_record(held, child=rows["node"][0].as_py())])

    leaves = table.select(F.col(vector).alias("v")).mapInArrow(reduce, _SUMMARY).withColumn("child", F.spark_partition_id().cast("long"))
    tree = materialize(leaves, "whitening-leaves")
    last = tree.agg(F.max("child")).first()[0]
    if last is None:
        return None
    while last > 0:  # a job for all levels: as many as the logarithm of the number of tasks
        last //= FAN
        tree = tree.withColumn("node", F.floor(F.col("child") / FAN)).groupBy("node").applyInArrow(merge, f"child long, {_SUMMARY}")
    root = tree.first()
    found = Summary.unpacked(root["n"], bytes(root["sums"]), root["rank"], bytes(root["factor"]))
    width = len(found.sums)
    s, vt = np.zeros(width), np.eye(width)
    if width:
        _, values, vt = np.linalg.svd(np.vstack((found.factor, np.zeros((width, width)))), full_matrices=False)  # rows of zeros: the basis is whole for few rows, too
        s[: len(values)] = values
    return Whitening(found.n, found.sums, s * s / found.n, vt)


def identity_error(table: DataFrame, model: Whitening, vector: str = "embedding", scale: float = SCALE, components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, from one pass over the rows; components without variance are left out."""
    alive = np.flatnonzero(model.alive[:components])
    m = len(alive)
    if not m:
        return 0.0

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((m + 1, m + 1))
        for batch in _slices(batches, BLOCK):
            rows, x = usable(batch["v"])
            if len(rows):
                w = model.whitened(_padded(floored(x, scale, MOST), len(model.sums)), components)[:, alive]
                one = np.column_stack((np.ones(len(w)), w))
                held += one.T @ one
        if held[0, 0]:
            cells = np.arange(held.size)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int64()), "v": pa.array(held.ravel(), pa.float64())})

    sums = np.zeros((m + 1) ** 2)
    for r in table.select(F.col(vector).alias("v")).mapInArrow(gather, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # a square of the components
        sums[r["cell"]] = r["v"]
    s = sums.reshape(m + 1, m + 1) / model.n
    return float(np.abs(s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:]) - np.eye(m)).max())


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def whiten(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: float = SCALE, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: id, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error.

    x = floor(scale * c) + 1000000 for every component c. Rows whose vector is null or holds null or
    non-finite components are left out; repeated rows count one by one, a null id stays null. Shorter vectors
    end in zeros (so does an empty one). |scale * c| beyond 2^52 is held there. A deviation beyond 64 bits is null. A
    component without variance (equal rows, one row, fewer rows than components) has a null ``whitened``, 0 as ``explained``
    and no part in ``identity_error``; equal variances may share their plane in any rotation. An empty table gives no rows.
    Other columns are ignored.
    """
    columns = [F.col(id_col).alias("vec_id"), F.col(vector).alias("v")]
    schema = f"vec_id {table.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(table, vector, scale)
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(table, model, vector, scale, components)
    m = min(components, len(model.sums))
    explained = np.where(model.alive, model.variances, 0.0)[:m] / (model.trace or 1.0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, BLOCK):
            rows, x = usable(batch["v"])
            if not len(rows) or not m:
                continue
            x = _padded(floored(x, scale, MOST), len(model.sums))
            each = np.repeat(np.arange(len(rows)), m)
            w = model.whitened(x, components).ravel()
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch["vec_id"].take(pa.array(rows[each])),
                "component": pa.array(np.tile(np.arange(1, m + 1), len(rows)), pa.int32()),
                "n": pa.array(np.full(len(each), model.n), pa.int64()),
                "deviation": pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                "whitened": pa.array(w, pa.float64(), mask=np.isnan(w)),
                "explained": pa.array(np.tile(explained, len(rows)), pa.float64()),
                "identity_error": pa.array(np.full(len(each), error), pa.float64()),
            })

    return table.select(*columns).mapInArrow(run, schema)
