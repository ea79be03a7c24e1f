"""Every stage of the pipeline against brute force on its own input, and run() as a whole."""

from collections import Counter, defaultdict

import corpus_pipeline
from sigspark.llm.common import materialize

from test_op01_op04_op09 import brute_lines, brute_quality, targets, words
from test_op10 import brute_components, brute_print
from test_tokens_op03_op05_op08 import check_packing, ids

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        got[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns

    kept = [r for r in before if brute_quality(r.text)[-1]]
    assert sorted(got["quality_rules"]) == sorted(kept) and 0 < len(kept) < len(before)

    import hashlib

    want = {(d, sha) for d, _, _, sha in brute_lines([(r.doc_id, r.text, r.source) for r in kept])}
    assert {(str(r.doc_id), hashlib.sha256(r.text.encode()).hexdigest()) for r in got["line_dedup"]} == want
    assert all(r.n_chars == len(r.text) for r in got["line_dedup"])

    rows = got["line_dedup"]
    groups = defaultdict(list)
    for r, root in zip(rows, brute_components([brute_print(r.text) for r in rows]), strict=True):
        groups[root].append(r)
    assert sorted(got["near_duplicates"]) == sorted(min(g, key=lambda r: r.doc_id) for g in groups.values())

    rows, mixed = got["near_duplicates"], got["source_mix"]
    taken, sizes = Counter(r.doc_id for r in mixed), defaultdict(int)
    assert set(mixed) <= set(rows) and max(taken.values()) <= 2
    for r in rows:
        sizes[r.source] += len(words(r.text))
    for s, want_ in targets(sizes).items():
        largest = max(len(words(r.text)) for r in rows if r.source == s)
        assert abs(sum(len(words(r.text)) for r in mixed if r.source == s) - want_) <= largest

    check_packing(got["packing"], [(r.doc_id, [*ids(r.text), 1]) for r in mixed])


def test_run_agrees_with_its_stages(spark):
    result = corpus_pipeline.run(spark, SF)
    assert result.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and result.count() > 0
    again = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert Counter(map(key, result.collect())) == Counter(map(key, again.collect()))


def test_odd_rows_pass_all_stages(spark):
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "w " * 60, "en", None, 120), (3, " ".join(f"word{i}" for i in range(90)), None, "a", 5), (3, " ".join(f"word{i}" for i in range(90)), None, "a", 5)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = materialize(stage(spark, frame, SF), "test-odd")
        assert set(r.doc_id for r in frame.collect()) <= {3}
