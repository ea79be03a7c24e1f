"""Quality rules, line dedup and mixing against brute force on whole small tables and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigspark.llm import queries
from sigspark.llm.op01_quality import LINE_LIMIT, NGRAM_LIMITS, accepted, measure, quality
from sigspark.llm.op04_lines import dedup_lines, twice_seen
from sigspark.llm.op09_mixing import mixture, schedule

SF = "/root/testdata/sf0.01"
ODD = [
    (1, None, "a", 1),
    (2, "", "a", 2),
    (3, "x", None, 3),
    (4, " \t\n\x0b\x0c\r ", "b", 4),
    (5, "É ß 漢字 w # $ ", None, 5),
    (6, "long " * 60_000, "b", 6),
    (7, "the same line of over twenty\nshort\n  THE same line of over twenty \nend", "a", 7),
    (8, "the same line of over twenty", "a", 8),
    (9, "The Same Line of over twenty\r\n\n\n", "c", 9),
    (9, "The Same Line of over twenty\r\n\n\n", "c", 9),
    (10, "\n".join(["one two three four five six"] * 40), "c", 10),
    (None, "the same line of over twenty", None, None),
]
SCHEMA = "doc_id long, text string, source string, kept long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def repeated_words(w, n):
    count = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return {i + k for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for k in range(n)}


def brute_quality(text):
    w, lines, seen, dup, dup_chars = words(text), (text or "").split("\n"), set(), 0, 0
    for line in lines:
        if words(line):
            dup += line in seen
            dup_chars += sum(map(len, words(line))) if line in seen else 0
            seen.add(line)
    chars = sum(map(len, w))
    repeat = len(repeated_words(w, 3))
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)
    over = dup_chars > 0.20 * chars or any(sum(len(w[i]) for i in repeated_words(w, n)) > limit * chars for n, limit in ((5, 0.25), (7, 0.20), (10, 0.15)))
    return len(w), chars, sum(c in "#*$%&|<>" for c in text or ""), dup, repeat, failed, not failed and not over


def test_quality_matches_brute_force(spark, docs):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in queries.op1_quality_rules(spark, SF).collect()}
    assert got == {d: brute_quality(t) for d, t, _ in docs}
    assert 0.5 < sum(x[-1] for x in got.values()) / len(got) < 0.98


def test_quality_of_odd_rows(odd):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality(odd).collect())
    assert got == sorted((str(d), *brute_quality(t)) for d, t, _, _ in ODD)
    assert accepted(odd).columns == odd.columns and quality(odd.limit(0)).count() == 0


def brute_lines(docs):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t, _ in docs:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 20:
                held[key(line)].add(d)
    out = []
    for d, t, _ in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(held[key(x)]) < 3 or d == max(held[key(x)])]
        out.append((str(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup_matches_brute_force(spark, docs):
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op4_line_dedup(spark, SF).collect())
    assert got == brute_lines(docs)
    assert sum(r[2] for r in got) > 0


def test_line_dedup_of_odd_rows(odd):
    rows = dedup_lines(odd).collect()
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows)
    assert got == brute_lines([r[:3] for r in ODD])
    assert dedup_lines(odd.limit(0)).count() == 0
    assert dedup_lines(odd.withColumnRenamed("kept", "n_lines"), counts=None).columns == ["doc_id", "text", "source", "n_lines"]


def test_line_dedup_in_many_blocks_with_any_filter(spark, docs, odd):
    """Small blocks and parts; filters with room, and filters so full that every line is suspected."""
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    for bits in (16, 0.001):
        rows = dedup_lines(frame, block_bytes=300_000, part_lines=1000, bits_per_line=bits).collect()
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows) == brute_lines(docs)
    clash = odd.withColumnsRenamed({"source": "block", "kept": "doc"})
    rows = dedup_lines(clash, block_bytes=100).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows) == brute_lines([r[:3] for r in ODD])
    assert sorted(str((r.doc_id, r.block, r.doc)) for r in rows) == sorted(str((d, s, k)) for d, _, s, k in ODD)


def test_twice_filter_misses_nothing_and_passes_little():
    rng = np.random.default_rng(0)
    blocks = [np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64)) for _ in range(8)]
    shared = rng.integers(0, 2**63, 50).astype(np.uint64)
    blocks = [np.unique(np.concatenate((b, shared[i::8], shared[(i + 1) % 8 :: 8]))) for i, b in enumerate(blocks)]
    found = twice_seen(blocks, 16 * 16_000)
    assert all(f[np.isin(b, shared)].all() for b, f in zip(blocks, found, strict=True))
    assert sum(f.sum() for f in found) < 100 + 0.03 * sum(map(len, blocks))


def targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, budget = set(), 1.5 * sum(sizes.values())
    while True:
        left = budget - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        share = {s: 2 * sizes[s] if s in full else left * weight[s] / total for s in order}
        more = {s for s in order if s not in full and share[s] > 2 * sizes[s]}
        if not more:
            return share
        full |= more


def check_mix(rows, given):
    sizes = defaultdict(int)
    for _, t, s in given:
        sizes[s] += len(words(t))
    want, taken, largest = targets(sizes), defaultdict(int), defaultdict(int)
    assert sorted((str(r.doc_id), r.size, r.source_size) for r in rows) == sorted((str(d), len(words(t)), sizes[s]) for d, t, s in given)
    for r in rows:
        assert r.target == pytest.approx(want[r.source], abs=1e-5) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        # a source ends within a document of its target, or with what the others' ends leave of the budget
        assert want[s] - largest[s] <= taken[s] + 1e-6 and taken[s] <= want[s] + largest[s] + 1e-3 * want[s], s
    assert sum(taken.values()) <= sum(want.values()) + 1e-3


def test_mixing_meets_targets_and_reruns_agree(spark, docs):
    plan = schedule(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    check_mix(plan, docs)
    again = schedule(spark.read.parquet(f"{SF}/documents.parquet").repartition(5, "lang")).collect()
    assert sorted(plan) == sorted(again)


def test_mixing_of_odd_rows(spark, odd):
    given = [r[:3] for r in ODD]
    plan = schedule(odd).collect()
    check_mix(plan, given)
    mixed = mixture(odd).collect()
    assert mixture(odd).columns == odd.columns
    assert sum(len(words(r.text)) for r in mixed) == sum(r.taken for r in plan)
    assert schedule(odd.limit(0)).count() == 0 and mixture(odd.limit(0)).count() == 0


def fair_queue(given):
    """(id, text) in the order of the mix, by a plain queue: one served document after the other."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sizes, number, flows = defaultdict(int), Counter(), defaultdict(list)
    for d, t, s in given:
        sizes[s] += len(words(t))
    target = targets(sizes) if sum(sizes.values()) else {}
    for repeat in (0, 1):
        number.clear()
        for d, t, s in given:
            digest = md5(t or "")
            number[d, s, digest] += 1
            nth = number[d, s, digest]
            place = int(md5(f"mix:{repeat}:{'null' if d is None else d}:{digest}:{nth}")[:13], 16) / 16**13
            flows[s].append((repeat, place, (d is not None, d or 0), digest, nth, d, t))
    turns = []
    for s, flow in flows.items():
        served = 0
        for repeat, _, key, digest, nth, d, t in sorted(flow, key=lambda x: x[:5]):
            served += len(words(t))
            if target.get(s):
                turns.append((served / round(target[s], 6), key, digest, nth, repeat, d, t))
    out, used = [], 0
    for *_, d, t in sorted(turns, key=lambda x: x[:5]):
        used += len(words(t))
        if used > round(sum(target.values()), 3):
            break
        out.append((d, t))
    return out


def test_the_mix_stands_in_the_order_of_a_fair_queue(spark, docs, odd):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    got = [(r.doc_id, r.text) for r in mixture(frame).collect()]
    assert got == fair_queue(docs)
    assert sum(a == b for a, b in zip(got, got[1:])) < 5  # copies stand apart
    assert [(r.doc_id, r.text) for r in mixture(odd.withColumnRenamed("kept", "turn"), bucket=2).collect()] == fair_queue([r[:3] for r in ODD])
    same = spark.createDataFrame([(None, "a b", "s", 1)] * 40 + [(1, "a b c", "s", 1)] * 40, SCHEMA).repartition(7)
    assert [(r.doc_id, r.text) for r in mixture(same, bucket=5).collect()] == fair_queue([(None, "a b", "s")] * 40 + [(1, "a b c", "s")] * 40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aab é\n\t#|c漢"), max_size=160), min_size=1, max_size=4))
def test_measures_of_any_texts(texts):
    got = measure([t.encode() for t in texts], NGRAM_LIMITS, LINE_LIMIT)
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert [tuple(got[k][i] for k in keys) for i in range(len(texts))] == [brute_quality(t) for t in texts]
