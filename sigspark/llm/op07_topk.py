"""7. Exact top-k by inner product with norm-bucketed retrieval.

Vectors are grouped into bands of similar length, and a band into buckets of about ``BLOCK`` vectors by hash. A
group of queries visits the buckets of every band that can still matter, longest first, in lanes of about ``LANE``
buckets, each read in one pass: the group is sent once per lane, not per bucket, and carries each query's k best
scores so far, of which the least is its running bound (at first a bound from a bounded probe). For each bucket a
query has a local cosine threshold, its bound over both lengths. A sample of the bucket tells how many vectors a
threshold leaves by coordinates (a vector that close to the query must have its largest coordinates near the
query's); where few are left, coordinates prune and then partial products over the leading coordinates, else
length alone prunes and the rest of the bucket is multiplied out in one product. Scores are exact integers. A
window over the lanes' k best takes the k best of all. Pruning skips only vectors that cannot be among the k
best, so results are exact whatever the probe and the samples hold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 10
SCALE = 1024
EVERY = 100
BLOCK, QUERIES = 4096, 512
LANE = 16  # buckets
PROBE = 2048
BAND = 1.05  # longest over shortest in a band
COORDINATES = 3
LEADING = 16  # coordinates in a partial product
SAMPLE = 64  # vectors of a bucket that choose how to prune it
FEW = 0.2  # share of a bucket left, below which its vectors are pruned one query at a time
_SLACK = 1e-9


def integer_vectors(table: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id, norm and v (little-endian int64 components) of the rows that take part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch["v"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.floor(scale * pc.list_flatten(batch["v"]).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
            ends = np.cumsum(sizes)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            ok = (bad[ends] == bad[ends - sizes]) & batch["v"].is_valid().to_numpy(zero_copy_only=False) & batch["id"].is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(ok)
            vectors = [x[ends[i] - sizes[i] : ends[i]] for i in rows]
            norms = pa.array([float(np.sqrt(v @ v)) for v in vectors], pa.float64())
            whole = [np.clip(v, -(2.0**62), 2.0**62).astype("<i8").tobytes() for v in vectors]
            yield pa.RecordBatch.from_arrays([batch["id"].cast(pa.int64()).take(pa.array(rows)), norms, pa.array(whole, pa.binary())], names=["id", "norm", "v"])

    return table.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).mapInArrow(run, "id long, norm double, v binary")


def matrix(rows: list[bytes], width: int = 0) -> np.ndarray:
    """int64 matrix; shorter vectors end in zeros."""
    width = max([width, *(len(r) // 8 for r in rows)])
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r, "<i8")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T; a score beyond 64 bits is held at the nearest long."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2.0**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: greater score first, then smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def coordinate_ranges(queries: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit ``queries``: their largest coordinates, and the least and greatest values there of unit vectors at ``cosines`` or more.

    Such a vector's coordinate f is within q_f * t -+ sqrt((1 - t^2)(1 - q_f^2)), stretched to the pole where q_f >= t.
    """
    at = np.argsort(-np.abs(queries), axis=1)[:, :COORDINATES]
    q, t = np.take_along_axis(queries, at, axis=1), np.clip(cosines, -1.0, 1.0)[:, None]
    spread = np.sqrt(np.maximum(0.0, 1 - t * t) * np.maximum(0.0, 1 - q * q))
    return at, np.where(-q >= t, -1.0, q * t - spread) - _SLACK, np.where(q >= t, 1.0, q * t + spread) + _SLACK


class Search:
    """The k best of a group of queries among the buckets it has visited; ``pruned`` counts query-candidate pairs by what became of them.

    ``sure``: a score that a query's k-th best has at least.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, norms: np.ndarray, sure: np.ndarray, k: int):
        self.ids, self.rows, self.norms, self.sure, self.k = ids, rows, norms, sure.copy(), k
        self.units = rows / np.maximum(norms, 1e-300)[:, None]
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
        self.found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
        self.pruned = Counter({"length": 0, "coordinates": 0, "partial product": 0, "multiplied": 0})

    def _keep(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        best = scores >= self.sure[i]
        if not best.any():
            return
        scores, ids = np.concatenate((self.scores[i], scores[best])), np.concatenate((self.found[i], ids[best]))
        top = _best(scores, ids, self.k)
        self.scores[i], self.found[i] = scores[top], ids[top]
        if len(top) == self.k:
            self.sure[i] = max(self.sure[i], float(self.scores[i][-1]))

    def visit(self, ids: np.ndarray, rows: np.ndarray, norms: np.ndarray) -> None:
        """One bucket, its vectors longest first."""
        if not len(ids):
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            bounded = (self.sure > 0) & (self.norms > 0)
            reach = np.where(bounded, self.sure / self.norms, 0.0)  # shorter vectors cannot reach the bound
            cosine = np.where(bounded & (norms[0] > 0), reach / norms[0], -1.0)
        alive = np.flatnonzero(cosine <= 1 + _SLACK)
        self.pruned["length"] += (len(self.ids) - len(alive)) * len(ids)
        if not len(alive):
            return
        sample = np.unique(np.linspace(0, len(ids) - 1, SAMPLE).astype(np.int64))
        at, low, high = coordinate_ranges(self.units[alive], cosine[alive])
        near = rows[sample][:, at] / np.maximum(norms[sample], 1e-300)[:, None, None]
        left = ((near >= low) & (near <= high)).all(axis=2).mean(axis=0)
        few = (left < FEW) & (cosine[alive] > 0)
        units = rows / np.maximum(norms, 1e-300)[:, None] if few.any() else rows
        for i, f, a, b in zip(alive[few], at[few], low[few], high[few], strict=True):
            # a shorter candidate needs a higher cosine still, so the bucket's threshold is safe for all
            near = np.flatnonzero(((units[:, f] >= a) & (units[:, f] <= b)).all(axis=1) & (ids != self.ids[i]))
            self.pruned["coordinates"] += len(ids) - len(near)
            q = self.rows[i]
            lead = np.argsort(-np.abs(q))[:LEADING]
            part = rows[near][:, lead].astype(float)
            rest = np.sqrt(np.maximum(0.0, norms[near] ** 2 - (part * part).sum(axis=1)))
            q_rest = np.sqrt(max(0.0, float(self.norms[i]) ** 2 - float((q[lead].astype(float) ** 2).sum())))
            able = part @ q[lead].astype(float) + rest * q_rest >= self.sure[i] - _SLACK * max(1.0, abs(self.sure[i])) - 1e-6 * self.norms[i] * norms[0]
            self.pruned["partial product"] += int((~able).sum())
            near = near[able]
            self.pruned["multiplied"] += len(near)
            self._keep(i, products(q[None], rows[near])[0], ids[near])
        many = alive[~few]
        if len(many):
            # lengths fall along the bucket: the least reach of these queries cuts it
            n = int(np.searchsorted(-norms, -(reach[many].min() * (1 - _SLACK)), "right"))
            self.pruned["length"] += len(many) * (len(ids) - n)
            self.pruned["multiplied"] += len(many) * n
            for row, i in zip(products(self.rows[many], rows[:n]), many, strict=True):
                other = ids[:n] != self.ids[i]
                self._keep(i, row[other], ids[:n][other])


def padded(rows: bytes, n: int, own: int, width: int) -> np.ndarray:
    return np.pad(np.frombuffer(rows, "<i8").reshape(n, own), ((0, 0), (0, width - own)))


def _band() -> Column:
    return F.when(F.col("norm") > 0, F.floor(F.log(BAND, F.col("norm")))).otherwise(-(10**6)).cast("long")


def _buckets(vectors: DataFrame, size: int, extra: list[str]) -> DataFrame:
    """One row per bucket of about ``size`` vectors of one band, longest first: band, part, least (of ``extra``), longest, width, ids, norms, rows and ``extra``."""
    banded = vectors.withColumn("band", _band())
    counts = banded.groupBy("band").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = banded.join(counts, "band").withColumn("part", F.pmod(F.xxhash64("id", "v", "copy"), F.col("parts")))

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("norm", "descending"), ("id", "ascending")])
        norms, own = rows["norm"].to_numpy(), matrix(rows["v"].to_pylist())
        more = [pa.array([rows[c].to_numpy().astype("<f8").tobytes()], pa.binary()) for c in extra]
        first = [pa.array([rows[c][0].as_py()], pa.int64()) for c in ("band", "part")]
        least = min((float(rows[c].to_numpy().min()) for c in extra), default=None)
        return pa.table([*first, pa.array([least], pa.float64()), pa.array([norms[0]]), pa.array([own.shape[1]], pa.int64()), pa.array([rows["id"].to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([norms.astype("<f8").tobytes()], pa.binary()), pa.array([own.astype("<i8").tobytes()], pa.binary()), *more], names=["band", "part", "least", "longest", "width", "ids", "norms", "rows", *extra])

    schema = ", ".join(["band long, part long, least double, longest double, width long, ids binary, norms binary, rows binary", *(f"{c} binary" for c in extra)])
    return dealt.groupBy("band", "part").applyInArrow(packed, schema)


def top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, block: int = BLOCK, lane: int = LANE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to the smaller id.

    Components are floor(scale * x). Rows that are null or hold null or non-finite components, or have no id,
    take no part. Candidates are all rows but those with the query's own id; repeated candidate rows count
    one by one, repeated query rows once. Shorter vectors end in zeros. An empty table, or no query,
    gives an empty result; other columns are ignored.
    """
    vectors = materialize(integer_vectors(table, id_col, vector, scale).withColumn("copy", F.monotonically_increasing_id()), "topk-vectors")
    asked = vectors.where(is_query).dropDuplicates(["id", "norm", "v"])
    n = vectors.count()
    probe = vectors.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // PROBE))) == 0).select("id", "v").limit(2 * PROBE).collect()  # a bound to start from, not the result
    p_ids, p_rows = np.array([r["id"] for r in probe], np.int64), [bytes(r["v"]) for r in probe]

    def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure = np.full(batch.num_rows, -np.inf)
            if batch.num_rows and len(p_ids):
                own = batch["v"].to_pylist()
                width = max(len(r) for r in own + p_rows) // 8
                scores, ids = products(matrix(own, width), matrix(p_rows, width)), batch["id"].to_numpy()
                for i in range(len(own)):
                    other = scores[i][p_ids != ids[i]]
                    if len(other) >= k:
                        sure[i] = float(np.partition(other, len(other) - k)[len(other) - k])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "norm", "v", "copy")), pa.array(sure)], names=["id", "norm", "v", "copy", "sure"])

    bounded = asked.select("id", "norm", "v", "copy").mapInArrow(bounds, "id long, norm double, v binary, copy long, sure double")
    queries = materialize(_buckets(bounded, QUERIES, ["sure"]).withColumn("group", F.monotonically_increasing_id()), "topk-queries")
    candidates = materialize(_buckets(vectors, block, []), "topk-candidates")
    bands = candidates.groupBy("band").agg(F.max("longest").alias("longest"), F.count("*").alias("buckets")).collect()  # some hundred: bands grow with the log of the lengths
    # a band's longest vector times the group's longest query must reach the least bound of the group
    each = F.explode(F.array(*(F.struct(F.lit(r.band).alias("band"), F.lit(r.longest).alias("longest"), F.lit(r.buckets).alias("buckets")) for r in bands))) if bands else F.lit(None).cast("struct<band:bigint,longest:double,buckets:bigint>")
    reached = F.col("longest") * F.col("b.longest") * (1 + _SLACK) >= F.col("least")
    meets = queries.select("group", "longest", "least", each.alias("b")).where(reached).select("group", "b.band", "b.buckets")
    # lanes go through the bands of a group: each has its share of every band, so that all lanes see long vectors first
    lanes = F.ceil(F.sum("buckets").over(Window.partitionBy("group")) / lane)
    planned = materialize(meets.withColumn("lanes", lanes), "topk-lanes")
    payload = ["width", "ids", "norms", "rows"]
    sent = planned.join(candidates, "band").select("group", F.pmod(F.col("band") + F.col("part"), F.col("lanes")).alias("lane"), F.lit(1).alias("kind"), F.col("longest"), *payload, F.lit(None).cast("binary").alias("sure"))
    heads = planned.groupBy("group").agg(F.max("lanes").alias("lanes")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    asks = heads.join(queries, "group").select("group", "lane", F.lit(0).alias("kind"), "longest", *payload, "sure")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        state: Search | None = None

        def result() -> pa.RecordBatch:
            sizes = [len(x) for x in state.found]
            columns = [np.repeat(state.ids, sizes), np.concatenate(state.found), np.concatenate(state.scores), np.repeat(at[0], sum(sizes)), np.repeat(np.arange(len(sizes)), sizes)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "vec_id", "score", "group", "place"])

        for batch in batches:
            for j in range(batch.num_rows):
                row = {c: batch[c][j].as_py() for c in batch.schema.names}
                ids, norms = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["norms"], "<f8")
                if row["kind"] == 0:
                    if state is not None:
                        yield result()
                    at = row["group"], row["lane"]
                    state = Search(ids, padded(row["rows"], len(ids), row["width"], row["width"]), norms, np.frombuffer(row["sure"], "<f8"), k)
                    continue
                width = max(row["width"], state.rows.shape[1])
                if width > state.rows.shape[1]:
                    wide = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))  # noqa: E731, B023
                    state.rows, state.units = wide(state.rows), wide(state.units)
                state.visit(ids, padded(row["rows"], len(ids), row["width"], width), norms)
        if state is not None:
            yield result()

    order = ("group", "lane", "kind", F.desc("longest"))
    found = asks.unionByName(sent).repartition("group", "lane").sortWithinPartitions(*order).mapInArrow(search, "query_id long, vec_id long, score long, group long, place long")
    best = Window.partitionBy("group", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
