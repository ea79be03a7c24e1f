"""LM scores against a plain dictionary model, and against the base model on held-out texts."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from sigspark.llm import queries
from sigspark.llm.op06_lm import PRIORS, Automaton, Block, packed_answers, packed_keys, score, unpacked_answers, unpacked_keys, words_of

SF = "/root/testdata/sf0.01"
ODD = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "Ab aB É", 0), (5, "w " * 60_000, 0), (6, "w w", 0), (6, "w w", 0), (None, "null trains", 0), (17, "null trains", 0), (9, "x", 1)]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def model(train, order):
    """Counts of each order, tokens, types, discount and priors, from plain dictionaries."""
    counts = [Counter(tuple(t[i : i + k]) for t in train for i in range(len(t) - k + 1)) for k in range(1, order + 1)]
    n, v = sum(counts[0].values()), len(counts[0])
    once, twice = (sum(x == y for x in counts[0].values()) for y in (1, 2))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    return counts, n, v, discount, [PRIORS[min(k, len(PRIORS)) - 1] for k in range(1, order)]


def probability(w, history, counts, n, v, discount, priors):
    if not history:
        return ((counts[0][w,] - discount) / n if counts[0][w,] else discount * v / n) if n else 1.0
    m = priors[len(history) - 1]
    rest = probability(w, history[1:], counts, n, v, discount, priors)
    return (counts[len(history)][(*history, w)] + m * rest) / (counts[len(history) - 1][history] + m)


def brute(docs, order=3):
    c, n, v, discount, priors = model([tokens(t) for d, t in docs if not held(d)], order)
    out = []
    for d, text in docs:
        t = tokens(text)
        s = sum(math.log10(probability(w, tuple(t[max(0, i - order + 1) : i]), c, n, v, discount, priors)) for i, w in enumerate(t))
        out.append((str(d), held(d), len(t), sum(c[0][w,] > 0 for w in t), n, sum(math.log10((c[0][w,] + 1) / (n + v + 1)) for w in t), s))
    return sorted(out)


def same(frame, docs, order=3):
    rows = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in frame.collect())
    want = brute(docs, order)
    assert [r[:5] for r in rows] == [r[:5] for r in want]
    for r, w in zip(rows, want, strict=True):
        assert r[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-6)
    return rows


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = same(queries.op6_lm_scores(spark, SF), docs)
    held_out = lambda rows, k: sum(r[k] for r in rows if r[1])
    assert held_out(rows, 6) > held_out(rows, 5)
    bigram = score(spark.read.parquet(f"{SF}/documents.parquet"), order=2).where("held_out").agg({"score": "sum"}).first()[0]
    assert held_out(rows, 6) > bigram
    print("held out: base, bigram, trigram", held_out(rows, 5), bigram, held_out(rows, 6))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_other_orders_in_many_blocks(spark, order):
    tiny = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same(score(tiny, order=order, block_bytes=50_000), [(r.doc_id, r.text) for r in tiny.collect()], order)


def test_forty_short_texts_score_by_the_same_rule(spark):
    rows = [(i, f"a{i % 3} b{i % 4} c{i % 2} a{i % 3}", 0) for i in range(40)]
    same(score(spark.createDataFrame(rows, "doc_id long, text string, n int"), block_bytes=100), [r[:2] for r in rows])


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string, block int")
    same(score(odd, block_bytes=1000), [r[:2] for r in ODD])
    assert score(odd.limit(0)).count() == 0
    lone = next(d for d in range(100) if held(d))
    only = spark.createDataFrame([(lone, "a b", 0)], "doc_id long, text string, n int")
    row = score(only).first()
    assert (row.n_known, row.train_tokens, row.base_score, row.score) == (0, 0, 0.0, 0.0)


def automaton(texts, order):
    block = Block([t.encode() for t in texts], np.ones(len(texts), bool), order)
    counts = block.grams[0].counts
    return block, Automaton(block, int(counts.sum()), int((counts > 0).sum()), 0.5, [5.0] * (order - 1))


def arcs_of(block, a):
    """(state, word) -> weight and target, for every trained arc."""
    first = np.cumsum([1, *(len(g.keys) for g in block.grams)])
    out = {(0, w): (a.weights[0][w], a.targets[0][w]) for w in range(block.n_words)}
    for k, g in enumerate(block.grams[1:], 1):
        out |= {(first[k - 1] + b, w): (a.weights[k][i], a.targets[k][i]) for i, (b, w) in enumerate(zip(g.begin, g.word, strict=True)) if a.weights[k][i] == a.weights[k][i]}
    return out


def test_arcs_of_every_state_sum_to_one():
    """Over all words and the unknown one, whatever the state: its own arcs and those behind its failure arcs."""
    block, a = automaton(["a b a c", "b b a", "c a b d", "d d"], 3)
    arcs = arcs_of(block, a)
    unknown = 0.5 * block.n_words / block.grams[0].counts.sum()
    for state in {0} | {t for _, t in arcs.values()} - {1}:  # nothing follows an end
        total = 0.0
        for word in [*range(block.n_words), None]:
            weight, s = 0.0, state
            while s and (s, word) not in arcs:
                weight, s = weight + a.fail[s], a.up[s]
            total += 10 ** (weight + (math.log10(unknown) if word is None else arcs[s, word][0]))
        assert total == pytest.approx(1), state


def test_state_is_carried_and_failures_go_one_word_shorter():
    block, a = automaton(["a b c", "x b d"], 3)
    arcs = arcs_of(block, a)
    assert max(a.up) > 0  # bigram states fail to word states, not to the empty one
    number = {w: i for i, w in enumerate(["\n", *"abcxd"])}
    ab = arcs[arcs[0, number["a"]][1], number["b"]][1]
    assert (ab, number["c"]) in arcs and (ab, number["d"]) not in arcs and (a.up[ab], number["d"]) in arcs
    # "a b d" is read by arc, arc, failure, arc
    new = Block([b"a b d"], np.zeros(1, bool), 3)
    for k, g in enumerate(new.grams):
        known = {int(x): int(c) for x, c in zip(block.grams[k].keys, block.grams[k].counts, strict=True)}
        g.counts = np.array([known.get(int(x), 0) for x in g.keys])
    totals = (8, 6, 0.5, [5.0, 5.0])
    path = arcs[0, number["a"]][0] + arcs[arcs[0, number["a"]][1], number["b"]][0] + a.fail[ab] + arcs[a.up[ab], number["d"]][0]
    d = arcs[a.up[ab], number["d"]][1]
    assert Automaton(new, *totals).read()[0] == pytest.approx(path + arcs[d, 0][0])


def walked(block, a):
    """One token after another, carrying the state."""
    at = [np.full(len(block.tokens), -1) for _ in block.grams]
    for numbers, (places, found) in zip(at, block.places, strict=True):
        numbers[places] = found
    out = []
    for begin, size in zip(block.first.tolist(), block.sizes.tolist(), strict=True):
        total, state, length = 0.0, 0, 0
        for i in range(begin, begin + size):
            while (weight := a.weights[length][at[length][i]]) != weight:
                total, state, length = total + a.fail[state], a.up[state], length - 1
            total, state = total + weight, a.targets[length][at[length][i]]
            length = min(length + 1, len(at) - 1) if state else 0
        out.append(total)
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_all_states_at_once_are_those_of_a_walk(order):
    """The same scores, without a step of Python a token."""
    rng = np.random.default_rng(order)
    texts = [b" ".join(b"w%d" % w for w in rng.zipf(1.5, n)) for n in [0, 1, 2, *rng.integers(3, 900, 200)]]
    block = Block(texts, rng.random(len(texts)) < 0.5, order)
    counts = block.grams[0].counts
    a = Automaton(block, int(counts.sum()), int((counts > 0).sum()), 0.5, [5.0] * (order - 1))
    begin = time.process_time()
    found = a.read()
    middle = time.process_time()
    np.testing.assert_allclose(found, walked(block, a), rtol=1e-12)
    assert (middle - begin) * 5 < time.process_time() - middle


def test_words_split_at_ascii_white_space_alone():
    texts = [b"", None, b" \t\x0b\x0c\r\n ", b"  A b\x0bc ", "É\u00a0x\u2003y Z\x1cz\x85".encode(), b"last"]
    words, sizes = words_of(texts)
    expected = [(t or b"").lower().split() for t in texts]
    assert words.to_pylist() == [w for ws in expected for w in ws] and sizes.tolist() == list(map(len, expected))
    assert len(words_of([])[0]) == len(words_of([])[1]) == 0


def test_packing_of_keys_and_counts_loses_nothing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        assert (unpacked_keys(packed_keys(keys), len(keys)) == keys).all()
        own = rng.integers(0, 3, n)
        shared = rng.integers(0, 2, n) > 0
        total = own + shared * rng.integers(0, 5000, n)
        assert all((x == y).all() for x, y in zip(unpacked_answers(packed_answers(total, shared), own), (total, shared), strict=True))
