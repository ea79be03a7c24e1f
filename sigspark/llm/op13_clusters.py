"""13. Centroid clustering with partial-distance search.

Vectors are integers, and so are all distances and sums: results do not hang on the order of rows or tasks. The
dimensions are gone through by falling variance, a few at a time. The first ``STEPS[0]`` dimensions of all centroids name a
likely nearest one, whose distance is finished; each other centroid goes on only for those vectors where its
distance so far is not strictly above the best so far, so that of equal distances all are finished and the smallest
number wins. A round is one pass over the vectors: tasks send, for each centroid, a count and the sums of its
vectors, Spark adds them, and the driver sees one row per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import floored, usable

K, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
STEPS = (8, 8, 16, 32)  # dimensions at a time; what is left goes last
BLOCK = 4096
MOST = 2**27  # of a component: squared distances and sums stay within 64 bits


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (equal distances: the smaller number), the squared distance, and how many
    differences were squared. ``order``: dimensions, those of great variance first."""
    x, c = x[:, order], centroids[:, order]
    edges = [0]
    for step in STEPS:
        edges.append(min(edges[-1] + step, x.shape[1]))
    edges[-1] = x.shape[1]
    first = edges[1]
    far = ((x[:, None, :first] - c[None, :, :first]) ** 2).sum(axis=2)
    best = far.argmin(axis=1)
    rows = np.arange(len(x))
    least = far[rows, best] + ((x[:, first:] - c[best, first:]) ** 2).sum(axis=1)
    done = len(x) * (len(c) * first + x.shape[1] - first)
    likely = best.copy()
    for k in range(len(c)):
        alive = np.flatnonzero((likely != k) & (far[:, k] <= least))
        so_far = far[alive, k]
        for low, high in zip(edges[1:], edges[2:], strict=False):
            if not len(alive):
                break
            so_far = so_far + ((x[alive, low:high] - c[k, low:high]) ** 2).sum(axis=1)
            done += len(alive) * (high - low)
            on = so_far <= least[alive]
            alive, so_far = alive[on], so_far[on]
        nearer = (so_far < least[alive]) | (k < best[alive])
        best[alive[nearer]], least[alive[nearer]] = k, so_far[nearer]
    return best, least, done


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def integer_vectors(table: DataFrame, id_col: str, vector: str, width: int, scale: float) -> DataFrame:
    """vec_id and v (``width`` little-endian 32-bit integers) of the vectors that take part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = usable(batch["v"], width)
            whole = floored(x, scale, MOST).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(rows)), pa.array([r.tobytes() for r in whole], pa.binary())], names=["vec_id", "v"])

    return table.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("v")).mapInArrow(run, f"vec_id {table.schema[id_col].dataType.simpleString()}, v binary")


def by_variance(vectors: DataFrame, width: int) -> np.ndarray:
    """Dimensions by falling variance. They decide how fast a centroid is abandoned, not the result, so plain doubles will do."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["v"], width).astype(float)
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(width), pa.int64()), "n": pa.array([float(len(x))] * width), "s": pa.array(x.sum(axis=0)), "q": pa.array((x * x).sum(axis=0))})

    sums = vectors.select("v").mapInArrow(partial, "dim long, n double, s double, q double").groupBy("dim").agg(*(F.sum(c).alias(c) for c in "nsq"))
    spread = {r["dim"]: r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in sums.where("n > 0").collect()}  # a row per dimension
    return np.array(sorted(range(width), key=lambda d: (-spread.get(d, 0.0), d)), np.int64)


def seeds(vectors: DataFrame, k: int, width: int) -> np.ndarray:
    """The k vectors whose ids hash lowest (sha256 of "1:<id>"), in that order; a null id seeds nothing."""
    hashed = vectors.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").where("h is not null")
    first = hashed.orderBy("h", "v").limit(k).collect()
    return np.array([np.frombuffer(r["v"], "<i4") for r in first], np.int64).reshape(-1, width)


def moved(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floor of its vectors' mean; those without vectors stay."""
    k, width = centroids.shape

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch["v"].slice(begin, BLOCK), width)
                at = nearest(x, centroids, order)[0]
                count += np.bincount(at, minlength=k)
                for j in np.unique(at).tolist():
                    total[j] += x[at == j].sum(axis=0)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(own, pa.int64()), "n": pa.array(count[own]), "s": pa.array(total[own].tolist(), pa.list_(pa.int64()))})

    sums = [F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)]
    out = centroids.copy()
    for r in vectors.select("v").mapInArrow(partial, "cluster long, n long, s array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # a row per centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def cluster(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: float = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Vectors of exactly ``width`` components, none null or non-finite, take part, as floor(scale * x), held within
    -+2^27. Repeated rows count one by one; a null id is clustered but seeds nothing; rows that share an id seed in
    the order of their components' bytes, equal ones next to each other, of which only the smaller number gets
    vectors. With fewer vectors than ``k`` there are as many centroids as vectors; without any there are no rows.
    If no vector has an id there is no centroid, and no rows. Other columns are ignored.
    """
    vectors = materialize(integer_vectors(table, id_col, vector, width, scale), "cluster-vectors")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    centroids = seeds(vectors, k, width)
    if not len(centroids):
        return table.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    order = by_variance(vectors, width)
    for _ in range(rounds):
        centroids = moved(vectors, centroids, order)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                at, far, _ = nearest(_matrix(part["v"], width), centroids, order)
                yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(at, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = materialize(vectors.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row per centroid
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(c, d, sum(inertia.values()), digest[c]) for c, d in sorted(inertia.items())]
    of_cluster = table.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most
