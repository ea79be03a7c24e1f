"""2. Substring dedup by content-defined chunking with a gear rolling hash.

A text is normalised to its words joined by single spaces with A-Z lower-cased. Each word end has a gear
hash over its last 16 bytes, and the least of every ``WINDOW`` word ends is a cut, so an insertion shifts
nothing beyond the windows it touches. From each chunk on, the fewest chunks of at least ``MIN_WORDS`` words
are a span; spans are compared by 128-bit digest over all documents, and the document with the least id keeps
one. Overlapping or touching spans that other documents hold too are a passage; shorter repeats (a phrase that
many texts share) are left alone.

No passage of over 50 words is missed, whatever its words are. Its hashes agree from the ninth word on, as 16
bytes hold 8 words at most; of two texts that share it the cuts agree from the least of its first whole window
(at most word 8 + ``WINDOW``) to the least of its last (``WINDOW`` - 1 words before the end at most): a window
that reaches out of the passage and has its least in between would have beaten that one. So whole shared chunks
leave out 20 words at the front and 11 at the end at most, and 20 of 51 are left: a span. Words outside the
common cuts are not in a passage's count.

Digests are counted by an aggregation with map-side combine; only those of two documents or more go on,
written to a table, and meet the chunks again in a join whose hot partitions Spark can split. Chunks are
cut anew for it, which costs less than to write them. Rows are told apart by id and a hash of the text, so that
texts that share an id keep their own chunks and equal rows are one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, binary, free_name, materialize, text_slices

MIN_WORDS = 20
WINDOW = 12  # words; 51 - 2 * WINDOW - 7 is MIN_WORDS
LONGEST = 64  # bytes; a chunk without a cut for so long is cut at the next word end

# The gear table comes from a rule: 256 draws of a seeded generator.
GEAR = np.random.default_rng(2024).integers(0, 1 << 16, 256, np.uint16)


def gear_hashes(buffer: np.ndarray) -> np.ndarray:
    """At each byte, sum of GEAR[b] << age over the last 16 bytes, mod 2**16; by doubling the window."""
    h = GEAR[buffer]
    for span in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] << np.uint16(span)
        h = h + shifted
    return h


def least_of_windows(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of every ``window`` neighbours, the last of equal ones."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64)
    least, span = hashes.astype(np.int64) << 40 | np.arange(n - 1, -1, -1), 1
    while span < window:
        step = min(span, window - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    at = n - 1 - (least & (1 << 40) - 1)
    return at[np.diff(at, prepend=-1) > 0]


def chunks(text: bytes | None) -> tuple[bytes, list[int], np.ndarray]:
    """The normalised text, the chunk ends (bytes, each a word end), and words up to each end."""
    words = (text or b"").lower().split()
    if not words:
        return b"", [], np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    at = least_of_windows(gear_hashes(np.frombuffer(joined, np.uint8))[ends - 1])
    at = np.append(at[at < len(words) - 1], len(words) - 1)
    gaps = np.diff(ends[at], prepend=0)
    if (gaps > LONGEST).any():
        cuts, begin = [], 0
        for stop in at.tolist():
            last = int(ends[begin - 1]) if begin else 0
            while ends[stop] - last > LONGEST:
                cut = int(np.searchsorted(ends, last + LONGEST))
                if cut >= stop:
                    break
                cuts.append(cut)
                last = int(ends[cut])
            cuts.append(stop)
            begin = stop + 1
        at = np.array(cuts)
    return joined, ends[at].tolist(), at + 1


def span_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc, key (hash of the text), chunk (number in its text), span (chunks), begin (words before it), words, high and low (digest) of every span of every row with an id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            row, digests, parts = [], [], [np.zeros((4, 0), np.int64)]
            for i, t in enumerate(binary(batch["text"])):
                joined, ends, upto = chunks(t)
                begin = np.append(0, upto)[:-1] if len(upto) else upto
                last = np.searchsorted(upto, begin + min_words)
                n = int(np.searchsorted(last, len(upto)))  # the others have too few words after them
                last, first = last[:n], np.arange(n)
                starts = [0, *ends]
                digests += [xxhash.xxh3_128_digest(joined[a:b].lstrip()) for a, b in zip(starts[:n], [ends[k] for k in last.tolist()], strict=True)]
                row += [i] * n
                parts.append(np.stack((first, last - first + 1, begin[:n], upto[last] - begin[:n])))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            numbers = [pa.array(x) for x in np.concatenate(parts, axis=1).astype(np.int32)]
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc"].take(at), batch["key"].take(at), *numbers, pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["doc", "key", "chunk", "span", "begin", "words", "high", "low"])

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    numbers = [T.StructField(c, T.IntegerType()) for c in ("chunk", "span", "begin", "words")]
    return source.mapInArrow(run, T.StructType([source.schema["doc"], T.StructField("key", T.LongType()), *numbers, T.StructField("high", T.LongType()), T.StructField("low", T.LongType())]))


def _shared(docs: DataFrame, id_col: str, text: str, min_words: int) -> DataFrame:
    """doc, key, chunk, span, begin, words, least and most (ids that hold it) of every span that documents share, once for equal rows."""
    table = span_table(docs, id_col, text, min_words)
    counted = table.groupBy("high", "low").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    twice = materialize(counted.where("least < most"), "substring-twice")
    return table.join(twice, ["high", "low"]).drop("high", "low").distinct()


def _runs(shared: DataFrame) -> DataFrame:
    """``shared`` with ``run`` (number of the maximal run of touching spans in its row), new and new_earlier.

    ``new``: words of the span that no span before it covers; ``new_earlier``: the same among the spans that an
    earlier document holds, zero for the others.
    """
    row = Window.partitionBy("doc", "key").orderBy("chunk")
    before = row.rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.col("least") != F.col("doc")
    end = F.col("begin") + F.col("words")
    upto, covered, cut = F.max(F.col("chunk") + F.col("span")).over(before), F.max(end).over(before), F.max(F.when(earlier, end)).over(before)
    fresh = lambda upto: end - F.greatest("begin", F.least(F.coalesce(upto, F.lit(0)), end))
    opened = shared.withColumns({"opens": F.coalesce((F.col("chunk") > upto).cast("int"), F.lit(0)), "new": fresh(covered), "new_earlier": F.when(earlier, fresh(cut)).otherwise(0)})
    return opened.withColumn("run", F.sum("opens").over(row.rowsBetween(Window.unboundedPreceding, 0)))


def passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Passages that repeat across documents: id, first_chunk, n_words, n_kept_words, first_doc_id and last_doc_id.

    One row for each maximal run of spans (of at least ``min_words`` words) that other documents hold too.
    ``n_kept_words`` are in no span that an earlier document holds; the others are safe to cut.
    ``first_doc_id`` and ``last_doc_id`` are the least and greatest ids that share a span of the run.
    Null and empty texts and rows without an id have no chunks; rows with one id are one document, whose
    own repeats do not count, and each of its texts has rows of its own (equal ones once); very long texts are
    processed whole; an empty table gives an empty result; other columns are ignored.
    """
    runs = _runs(_shared(docs, id_col, text, min_words)).groupBy("doc", "key", "run")
    words = runs.agg(*(f.cast("long").alias(n) for n, f in {"first_chunk": F.min("chunk"), "n_words": F.sum("new"), "n_kept_words": F.sum("new") - F.sum("new_earlier")}.items()), F.min("least").alias("first_doc_id"), F.max("most").alias("last_doc_id"))
    return words.select(F.col("doc").alias(id_col), "first_chunk", "n_words", "n_kept_words", "first_doc_id", "last_doc_id")


def cut_words(text: bytes, cuts: Iterable[tuple[int, int]]) -> bytes:
    """The text without some ranges of its words, given in order; each word goes with the white space after it."""
    white = WHITE[np.frombuffer(text, np.uint8)]
    starts = np.append(np.flatnonzero(~white & np.concatenate(([True], white[:-1]))), len(text))
    out, at = [], 0
    for first, last in cuts:
        out.append(text[at : max(at, starts[first])])
        at = max(at, starts[last])
    return b"".join([*out, text[at:]])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut from all documents but the first that holds them; all columns stay, whatever their names.

    Rows without an id and null texts stay as they are. Of rows with one id each keeps what is its own.
    """
    names, doc, key, cut = docs.columns, free_name(docs, "doc"), free_name(docs, "key"), free_name(docs, "cut")
    ranges = _shared(docs, id_col, text, min_words).where(F.col("least") != F.col("doc")).groupBy(F.col("doc").alias(doc), F.col("key").alias(key))
    cuts = ranges.agg(F.array_sort(F.collect_list(F.array("begin", F.col("begin") + F.col("words")))).alias(cut))

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            new = [cut_words(t, c) if t and c else t for t, c in zip(binary(batch[text]), batch[cut].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()).cast(pa.string()) if c == text else batch[c] for c in names], names=names)

    return docs.join(cuts, (F.col(id_col) == F.col(doc)) & (F.xxhash64(text) == F.col(key)), "left").mapInArrow(rewrite, docs.schema)
