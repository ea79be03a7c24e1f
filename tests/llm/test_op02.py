"""Substring dedup: every long shared passage is found, texts without one are left alone."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from sigspark.llm import queries
from sigspark.llm.op02_substrings import LONGEST, chunks, cut_words, gear_hashes, least_of_windows, passages, without_repeats, GEAR

SF = "/root/testdata/sf0.01"


def sharing(docs, n):
    """Ids of documents that hold a window of n words which another holds too."""
    held = defaultdict(set)
    for d, t in docs:
        w = (t or "").lower().split()
        for i in range(len(w) - n + 1):
            held[" ".join(w[i : i + n])].add(d)
    return {d for ids in held.values() if len(ids) > 1 for d in ids}


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op2_substring_dedup(spark, SF).collect()
    got = {r.doc_id for r in rows}
    assert sharing(docs, 55) <= got <= sharing(docs, 19)
    assert all(r.first_doc_id < r.last_doc_id and 0 <= r.n_kept_words <= r.n_words for r in rows)


def test_planted_passages_survive_insertions(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    text = lambda n: [word() for _ in range(n)]
    passage = text(55)
    docs = [(i, " ".join(text(rng.randint(20, 300)) + (passage if i % 3 == 0 else []) + text(rng.randint(0, 90)))) for i in range(120)]
    long_ = text(110)
    shifted = long_[:50] + text(3) + long_[50:]
    docs += [(500, "\n".join(text(30) + shifted + text(9))), (504, " ".join(long_ + text(5))), (501, None), (502, ""), (None, " ".join(passage)), (503, " ".join(p.upper() for p in passage))]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, chunk int")
    got = {r.doc_id for r in passages(frame).collect()}
    assert got == {i for i in range(0, 120, 3)} | {500, 503, 504}
    assert passages(frame.limit(0)).count() == 0


def test_every_passage_of_51_words_is_found_whatever_its_word_length(spark):
    rng = random.Random(7)
    docs, want = [], set()
    for k, longest in enumerate([1, 2, 3, 5, 9, 30] * 150):
        word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rng.randint(1, longest)))  # noqa: E731, B023
        text = lambda n: [word() for _ in range(n)]  # noqa: E731, B023
        passage = text(51)
        docs += [(2 * k + i, " ".join(text(rng.randint(0, 40)) + passage + text(rng.randint(0, 40)))) for i in (0, 1)]
        want |= {2 * k, 2 * k + 1}
    assert {r.doc_id for r in passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_least_of_windows():
    hashes = np.random.default_rng(3).integers(0, 40, 300)
    want = {max(range(i, i + 12), key=lambda j: (-hashes[j], j)) for i in range(289)}
    assert least_of_windows(hashes, 12).tolist() == sorted(want) and least_of_windows(hashes[:11], 12).tolist() == []


def test_repeated_rows_and_own_repeats_are_one_document(spark):
    once = " ".join(f"w{i}" for i in range(80))
    frame = spark.createDataFrame([(1, once + " " + once), (1, once), (2, "short text")], "doc_id long, text string")
    assert passages(frame).count() == 0


def test_chunks_cover_the_words():
    for text in (b"one", b"a b " * 5000, b"x" * 3000 + b" y " + b"z" * 900, bytes(range(33, 127)) * 40, " ".join(str(i) for i in range(9000)).encode()):
        joined, ends, upto = chunks(text)
        assert ends == sorted(set(ends)) and ends[-1] == len(joined) and upto[-1] == len(text.split())
        longest_word = max(map(len, joined.split()))
        assert max(np.diff(ends, prepend=0)) <= LONGEST + longest_word + 1


def test_gear_hash_by_doubling_is_the_rolling_hash():
    data = np.random.default_rng(0).integers(0, 256, 500, np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(GEAR[b])) & 0xFFFF
        want.append(h)
    assert gear_hashes(data).tolist() == want


def test_cut_texts_keep_the_first_copy(spark):
    rng = random.Random(4)
    text = lambda n: [f"{rng.randint(0, 10**6):x}" for _ in range(n)]
    passage, heads, tails = text(80), [text(30) for _ in range(4)], [text(20) for _ in range(4)]
    rows = [(i, " ".join(h) + "\n" + "\t ".join(passage) + "\n" + " ".join(t), 7) for i, (h, t) in enumerate(zip(heads, tails, strict=True))] + [(9, None, 1), (None, " ".join(passage), 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, first long")
    got = {r.doc_id: r.text for r in without_repeats(frame).collect()}
    assert without_repeats(frame).columns == frame.columns and got[0] == rows[0][1] and got[9] is None and got[None] == rows[-1][1]
    for i in (1, 2, 3):
        words = got[i].split()
        assert words[:30] == heads[i] and words[-20:] == tails[i] and len(words) < 75
    assert passages(without_repeats(frame)).count() == 0


def test_cutting_all_or_no_words():
    text = b"  one two\n three " + b"word " * 50
    assert cut_words(text, []) == text and cut_words(text, [(0, 30), (20, 53)]) == b"  " and cut_words(text, [(1, 2), (1, 3)]) == b"  one " + b"word " * 50


def plain_chunks(text):
    """Words up to each cut, by the rule alone: the rolling gear hash word by word, the least of each window, long chunks cut."""
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    joined, h, ends, hashes, at = b" ".join(w), 0, [], [], 0
    for word in w:
        at += len(word)
        ends.append(at)
        at += 1
    stops = set(ends)
    for i, b in enumerate(joined):
        h = ((h << 1) + int(GEAR[b])) & 0xFFFF
        if i + 1 in stops:
            hashes.append(h)
    cuts = sorted({max(range(i, i + 12), key=lambda j: (-hashes[j], j)) for i in range(len(w) - 11)} - {len(w) - 1} | ({len(w) - 1} if w else set()))
    out, last = [], 0
    begin = 0
    for cut in cuts:
        for j in range(begin, cut):
            if ends[j] - last >= LONGEST and ends[cut] - last > LONGEST:
                out.append(j + 1)
                last = ends[j]
        out.append(cut + 1)
        begin, last = cut + 1, ends[cut]
    return w, out


def brute(rows):
    """All columns of ``passages`` and the texts' cut words, from dictionaries of whole spans."""
    spans, holders = {}, defaultdict(set)
    for d, t in rows:
        if d is None or t is None:
            continue
        w, cuts = plain_chunks(t.encode())
        own = []
        for k, b in enumerate([0, *cuts][: len(cuts)]):
            e = next((j for j in range(k, len(cuts)) if cuts[j] - b >= 20), None)
            if e is not None:
                own.append((k, e, b, cuts[e], b" ".join(w[b : cuts[e]])))
                holders[own[-1][-1]].add(d)
        spans[d, t] = own
    out, cut = [], {}
    for (d, t), own in spans.items():
        hits = [s for s in own if len(holders[s[-1]]) > 1]
        cut[d, t] = {i for s in hits if min(holders[s[-1]]) != d for i in range(s[2], s[3])}
        runs = []
        for s in hits:
            if runs and s[0] <= max(x[1] for x in runs[-1]) + 1:
                runs[-1].append(s)
            else:
                runs.append([s])
        for r in runs:
            inside, gone = {i for s in r for i in range(s[2], s[3])}, {i for s in r if min(holders[s[-1]]) != d for i in range(s[2], s[3])}
            ids = [d for s in r for d in holders[s[-1]]]
            out.append((d, r[0][0], len(inside), len(inside - gone), min(ids), max(ids)))
    return sorted(out), cut


def same(frame, rows):
    want, cut = brute(rows)
    got = sorted((r.doc_id, r.first_chunk, r.n_words, r.n_kept_words, r.first_doc_id, r.last_doc_id) for r in passages(frame).collect())
    assert got == want
    kept = Counter((r.doc_id, None if r.text is None else tuple(r.text.split())) for r in without_repeats(frame).collect())
    assert kept == Counter((d, None if t is None else tuple(w for i, w in enumerate(t.split()) if i not in cut.get((d, t), ()))) for d, t in rows)
    return want


def test_documents_against_brute_force(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert len(same(frame, [tuple(r) for r in frame.collect()])) > 5


def test_rows_that_share_an_id_keep_their_own_words(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(f"{rng.randint(0, 10**6):x}" for _ in range(n))
    p, u = text(80), text(120)
    rows = [(0, p), (1, p + " tail"), (1, u), (1, p), (1, p), (0, None), (2, ""), (None, p), (3, u[:400] + " " + p), (3, "x " * 30_000)]
    frame = spark.createDataFrame([(d, t, 1, 2, 3, 4) for d, t in rows], "doc_id long, text string, doc int, key int, cut int, chunk int")
    same(frame, rows)
    assert without_repeats(frame).columns == frame.columns
    got = [r.text for r in without_repeats(frame).collect()]
    assert u in got
    # two ids only: nothing of the second id's other texts is touched
    two = spark.createDataFrame([(0, p), (1, p + " tail"), (1, u)], "doc_id long, text string")
    assert {len(r.text.split()) for r in without_repeats(two).collect() if r.text.startswith(u[:20])} == {120}
