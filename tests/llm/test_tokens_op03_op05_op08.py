"""Token counts, token files and packing against the tokenizer library itself."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sigspark.llm import queries
from sigspark.llm.common import work_dir
from sigspark.llm.op03_token_counts import token_counts
from sigspark.llm.op05_token_files import Shard, read_dataset, read_dictionary, write_dataset
from sigspark.llm.op08_packing import local_search, next_fit, pack, pieces
from sigspark.llm.tokens import Encoder

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    (4, None, 1),
    (1, "", 2),
    (2, "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>, <|endoftext|>.", 3),
    (3, "É, H̱ x, É. 漢字　ok, …, it's I'LL. \x85 z\x00", 4),
    (None, "long word " * 30_000, 5),
    (5, "x" * 3000 + ". " + "y1" * 400, 6),
    (5, "x" * 3000 + ". " + "y1" * 400, 6),
]
SCHEMA = "doc_id long, text string, n_tokens long"


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, ids(r.text), len(r.text.encode())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBcIKé̱́ ,.'\n\t<|>stdendoftext1漢…\xa0\x85 ſİ"), max_size=40), max_size=6))
def test_encoder_equals_the_library(texts):
    got, sizes = encoder.encode([t.encode() for t in texts])
    want = [ids(t) for t in texts]
    assert sizes.tolist() == [len(x) for x in want] and got.tolist() == [i for x in want for i in x]


encoder = Encoder(PATH)


def test_encoder_with_a_small_cache_and_another_tokenizer(monkeypatch):
    from sigspark.llm import tokens

    monkeypatch.setattr(tokens, "CACHED", 50)
    small, texts = Encoder(PATH), [f"w{i} v{i % 7} x" for i in range(100)]
    for t in texts * 2:
        assert small.encode([t.encode()])[0].tolist() == ids(t)
    other = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_chunk and other.encode([b"a b", None])[0].tolist() == other.tokenizer.encode("a b").ids


def test_token_counts(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op3_token_counts(spark, SF).collect()}
    assert got == {d: (n, len(x), len(x) > 2048) for d, x, n in docs}
    few = token_counts(spark.read.parquet(f"{SF}/documents.parquet"), PATH, head=50)  # nearly all in the tail
    assert {r.doc_id: r.n_tokens for r in few.collect()} == {d: len(x) for d, x, _ in docs}


def test_token_counts_of_odd_rows(odd):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(odd, PATH).collect())
    assert got == sorted((str(d), len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048) for d, t, _ in ODD)
    assert token_counts(odd.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts(odd, public_tokenizers.path("byte_bpe_50k.json"))


def test_chunks_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"Some Words, here.", "e\u0331 Mark, it.".encode(), b"<|endoftext|> A, b.", None, b"Last, One."]
    alone = [encoder.chunks([t])[0] for t in texts]
    got, n = encoder.chunks(texts)
    assert n.tolist() == [len(x) for x in alone] and got == [c for x in alone for c in x]


def test_token_counts_when_the_passes_cut_batches_differently(spark):
    rows = [(i, f"Word{i}, Other{i}. " * 30 + ("e\u0331" if i % 97 == 0 else "")) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")  # the id makes batches of the second pass shorter
    try:
        got = {r.doc_id: r.n_tokens for r in token_counts(frame, PATH, head=1).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {d: len(ids(t)) for d, t in rows}


def test_token_files_round_trip(spark, docs):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_token_files(spark, SF).collect()}
    want, at = {}, 0
    for d, x, _ in sorted(docs):
        want[d] = (at, len(x) + 1, crc([*x, 1]))
        at += len(x) + 1
    assert got == want


def test_token_files_of_odd_rows_and_random_access(spark, odd):
    out = work_dir(spark, "test-token-files")
    write_dataset(odd, PATH, out, shard_bytes=100_000)
    rows = read_dataset(spark, out, ids=True).collect()
    key = lambda d: (d is not None, d or 0)
    want = sorted(((d, [*ids(t), 1]) for d, t, _ in ODD), key=lambda r: (key(r[0]), len(r[1])))
    got = sorted(((r.doc_id, r.ids) for r in rows), key=lambda r: (key(r[0]), len(r[1])))
    assert got == want
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert [s for s, _ in starts] == np.concatenate(([0], np.cumsum([n for _, n in starts])[:-1])).tolist()
    words = read_dictionary(out)
    names = [r.file for r in spark.read.parquet(f"{out}/manifest").collect()]
    for name in names:
        shard = Shard(f"{out}/{name}", words)
        assert [shard[k].tolist() for k in range(shard.n)] == [x.tolist() for x in shard.frames()]
    with pytest.raises(ValueError):
        Shard(f"{out}/{names[0]}", words + b"x")
    write_dataset(odd.limit(0), PATH, work := work_dir(spark, "test-empty"))
    assert read_dataset(spark, work).count() == 0


def check_packing(rows, given):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = Counter((d, k // 4096, k, len(x[k : k + 4096]), crc(x[k : k + 4096])) for d, x in given for k in range(0, len(x), 4096))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.concatenate(([0], np.cumsum([r.length for r in s])[:-1])).tolist()
        assert sum(r.length for r in s) <= 4096
    return len(by_sequence), sum(r.length for r in rows)


def test_packing(spark, docs):
    n, total = check_packing(queries.op8_packing(spark, SF).collect(), [(d, [*x, 1]) for d, x, _ in docs])
    assert n <= -(-total // 4096) + 1


def test_packing_of_odd_rows(odd):
    check_packing(pack(odd, PATH).collect(), [(d, [*ids(t), 1]) for d, t, _ in ODD])
    assert pack(odd.limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=120))
def test_local_search_keeps_items_and_never_adds_bins(lengths):
    bins = next_fit(lengths, 100)
    n, squares = len(bins), sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    kinds = Counter()
    after = local_search([list(b) for b in bins], lengths, 100, kinds)
    assert n - len(after) == kinds["bins"]
    assert sorted(i for b in after for i in b) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in b) for b in after) <= 100 and len(after) <= n
    assert sum(sum(lengths[i] for i in b) ** 2 for b in after) >= squares


def test_local_search_empties_bins():
    for lengths in ([1300 + (i * 37) % 200 for i in range(900)], [20 + (i * 7919) % 2500 for i in range(3000)], [1 + (i * 31) % 90 for i in range(20_000)]):
        bins, kinds = next_fit(lengths, 4096), Counter()
        after = local_search([list(b) for b in bins], lengths, 4096, kinds)
        assert len(after) == len(bins) - kinds["bins"] <= len(bins)
        if min(lengths) < 1000:
            assert len(after) == -(-sum(lengths) // 4096)


def test_packing_reaches_the_lower_bound_through_the_search(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lengths = [r.length for r in pieces(frame, PATH).collect() if r.length < 4096]
    kinds = Counter()
    bins = next_fit(lengths, 4096)
    assert len(local_search([list(b) for b in bins], lengths, 4096, kinds)) == -(-sum(lengths) // 4096) < len(bins)
    assert kinds["bins"] > 20 and min(kinds[k] for k in ("move", "one for one", "two for one")) > 0
    print(len(bins), kinds)
