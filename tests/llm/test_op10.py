"""SimHash: fingerprints, anchors and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from sigspark.llm import op10_simhash, queries
from sigspark.llm.components import components
from sigspark.llm.op10_simhash import Anchors, forest, links, near_duplicates, representatives, simhash

SF = "/root/testdata/sf0.01"
ODD = [(5, None, 1), (3, "", 1), (9, " \n", 1), (4, "One", 2), (2, "one", 2), (None, "ONE", 2), (None, "lonely null words here", 3), (8, "a b c d " * 40_000, 4), (8, "a b c d " * 40_000, 4), (1, "É two", 5), (6, "é two", 6)]
SCHEMA = "doc_id long, text string, fp long"


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_components(prints):
    f = np.array(prints, np.uint64)
    x, y = np.nonzero(np.bitwise_count(f[:, None] ^ f) <= 2)
    return union(len(f), zip(x.tolist(), y.tolist(), strict=True))


def check(rows, given):
    prints = {(d, t): brute_print(t) for d, t in set(given)}
    roots = brute_components([prints[g] for g in given])
    name = {}
    for (d, _), r in zip(given, roots, strict=True):
        if d is not None:
            name[r] = min(name.get(r, d), d)
    want = sorted((str(d), f"{prints[d, t]:016x}", str(name.get(r))) for (d, t), r in zip(given, roots, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want


def test_documents(spark):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op10_simhash(spark, SF).collect()
    check(rows, given)
    assert sum(r.doc_id != r.component_id for r in rows) > 20


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    check(near_duplicates(odd).collect(), [r[:2] for r in ODD])
    assert near_duplicates(odd.limit(0)).count() == 0


def test_long_text_is_voted_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}x{i % 31}" for i in range(3000)).encode()
    want = simhash([text, b"a b", text])
    monkeypatch.setattr(op10_simhash, "_CHUNK", 700)
    assert simhash([text, b"a b", text]).tolist() == want.tolist()


@pytest.mark.parametrize("n", [10, 2_000, 60_000, 3_000_000, 10**9])
def test_linked_fingerprints_meet_at_either_home(n):
    rng, code = np.random.default_rng(n), Anchors(n, 2)
    f = rng.integers(0, 2**63, 300, np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, np.uint64)
    g = f ^ (np.uint64(1) << rng.integers(0, 64, 300, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, np.uint64))
    row, anchor = code.visits(f)
    home = code.visits(g)[1][:300]
    seen = set(zip(row.tolist(), anchor.tolist(), strict=True))
    assert len(seen) == len(row)
    assert all((k, int(home[k])) in seen for k in range(300))


def test_links_of_dense_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**62, 40, np.uint64)
    f = np.unique(np.concatenate([centres, *(centres[rng.integers(0, 40, 500)] ^ (np.uint64(1) << rng.integers(0, 64, 500, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, np.uint64)) for _ in range(4))]))
    monkeypatch.setattr(op10_simhash, "HOME", 4)
    frame = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long").repartition(3)
    got = {r.node: r.root for r in components(links(frame, len(f))).collect()}
    by_root = {}
    for x, r in zip(f.view(np.int64).tolist(), brute_components(f), strict=True):
        by_root.setdefault(r, []).append(x)
    want = {x: min(g) for g in by_root.values() for x in g}
    assert {x: got.get(x, x) for x in want} == want


def test_components_of_chains_stars_and_no_edges(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(3, 1), (5, 1), (9, 8)]


def test_dense_anchors_are_covered_again(spark):
    """Thousands of fingerprints about one point: anchors of any size find all links."""
    rng = np.random.default_rng(4)
    fps = np.unique(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (3000, 4)).astype(np.uint64), axis=1))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    near = np.bitwise_count(fps[:, None] ^ fps) <= 2
    want = {tuple(sorted(map(int, e))) for e in zip(*forest(*(fps[i].view(np.int64) for i in np.nonzero(near))), strict=True)}
    for dense in (10**9, 200):
        rows = links(frame, len(fps), dense=dense).collect()
        a, b = (np.array([r[k] for r in rows], np.int64) for k in ("a", "b"))
        assert {tuple(sorted(map(int, e))) for e in zip(*forest(a, b), strict=True)} == want


def test_representatives_keep_all_columns_and_choose_alike(spark):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(2, same, "mine", 1), (1, same, "b", 2), (1, same, "a", 3), (3, None, "x", 4), (4, "", "y", 5), (None, "other words here", "z", 6), (5, "long " * 60_000, "w", 7), (5, "long " * 60_000, "w", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, hash string, name int")
    got = sorted(map(tuple, representatives(frame).collect()), key=str)
    assert got == sorted(map(tuple, representatives(frame.repartition(5)).collect()), key=str)
    assert sorted(str(r[0]) for r in got) == ["1", "3", "5", "None"] and set(got) <= set(rows)
    assert representatives(frame).columns == frame.columns and representatives(frame.limit(0)).count() == 0
