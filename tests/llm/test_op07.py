"""Exact top-k against brute force, with lengths that make either pruning bite."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import op07_topk, queries
from sigspark.llm.op07_topk import Search, coordinate_ranges, products, top_k

SF = "/root/testdata/sf0.01"


def brute(rows, k=10):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in ok if i % 100 == 0}):
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def got(frame):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in frame.collect())


def test_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(queries.op7_top_k(spark, SF)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (100, [1.0, 1.0]), (100, [1.0, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (200, []), (300, [0.0, 0.0]), (7, [1.0]), (8, [1.0, 2.0, 3.0]), (9, [-3e5, 2e6])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    assert got(top_k(frame, F.col("id") % 100 == 0)) == brute(rows)
    assert top_k(frame.limit(0), F.col("id") % 100 == 0).count() == 0
    assert top_k(frame, F.col("id") == 77).count() == 0


@pytest.mark.parametrize("block", [40, 100_000])
def test_lengths_and_directions(spark, monkeypatch, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    v = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.05
    v *= rng.lognormal(0, 1.2, 900)[:, None]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    for name, value in (("QUERIES", 4), ("PROBE", 100), ("FEW", 0.5)):
        monkeypatch.setattr(op07_topk, name, value)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(top_k(frame, F.col("id") % 100 == 0, block=block, lane=3)) == brute(rows)


def searched(v, n_queries=40, k=10):
    """A search through buckets of 500, longest first, as a lane makes it; and the exact best scores."""
    norms = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norms)
    state = Search(np.arange(n_queries), v[:n_queries], norms[:n_queries], np.full(n_queries, -np.inf), k)
    for i in range(0, len(v), 500):
        at = order[i : i + 500]
        state.visit(at, v[at], norms[at])
    scores = v[:n_queries] @ v.T
    scores[np.arange(n_queries), np.arange(n_queries)] = np.iinfo(np.int64).min
    assert all(sorted(s.tolist()) == sorted(np.sort(x)[-k:].tolist()) for s, x in zip(state.scores, scores, strict=True))
    pairs = sum(state.pruned.values())
    return {name: n / pairs for name, n in state.pruned.items()}


def test_running_bounds_prune_skewed_lengths_and_close_directions():
    rng = np.random.default_rng(5)
    skewed = np.floor(1024 * rng.normal(size=(5000, 64)) * rng.lognormal(0, 1.0, 5000)[:, None] / 8).astype(np.int64)
    share = searched(skewed)
    assert share["length"] > 0.6, share
    centres = rng.normal(size=(50, 8))
    close = centres[rng.integers(0, 50, 5000)] + 0.05 * rng.normal(size=(5000, 8))
    close = np.floor(1024 * close / np.linalg.norm(close, axis=1)[:, None]).astype(np.int64)
    share = searched(close)
    assert share["coordinates"] > 0.5 and share["multiplied"] < 0.5, share


def test_the_table_of_unit_lengths_is_multiplied_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    share = searched(np.floor(1024 * np.array([r.embedding for r in rows], float)).astype(np.int64))
    print("unit lengths:", share)
    assert share["multiplied"] > 0.5  # README says so: neither length nor directions tell its vectors apart


def test_pruning_by_coordinates_keeps_all_that_reach_the_cosine():
    rng = np.random.default_rng(8)
    units = rng.normal(size=(4000, 6))
    units /= np.linalg.norm(units, axis=1)[:, None]
    for t in (0.5, 0.8, 0.95, 1.0):
        at, low, high = coordinate_ranges(units[:40], np.full(40, t))
        for q, f, a, b in zip(units, at, low, high, strict=False):
            left = np.flatnonzero(((units[:, f] >= a) & (units[:, f] <= b)).all(axis=1))
            assert set(np.flatnonzero(units @ q >= t)) <= set(left)
            assert t < 0.95 or len(left) < 600


def test_products_beyond_doubles_and_longs():
    a = np.array([[2**40, 3], [2**62, 2**62]], np.int64)
    assert products(a[:1], a[:1]).tolist() == [[2**63 - 1]]
    assert products(np.array([[2**30 + 1]]), np.array([[2**30 + 1]])).tolist() == [[(2**30 + 1) ** 2]]
