"""1. Quality rules: repetition coverage from rolling hashes of several n-gram lengths.

For every text the characters that lie inside word n-grams found twice or more in that text, and
inside lines equal to an earlier line, are measured with numpy. Each measure is a share of all word
characters and has a limit; a text over any limit is rejected, as is one that fails the base rules.

Everything is local to a text, so the operator is one map over the input: no shuffle, no state, and a
lost executor costs only its own tasks. Memory is bounded by a slice of about 2 MB of text or one text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, binary, text_slices

#: n-gram length -> largest share of word characters inside n-grams of that length that occur twice or more.
NGRAM_LIMITS = {5: 0.25, 7: 0.20, 10: 0.15}
#: largest share of word characters inside lines equal to an earlier line.
LINE_LIMIT = 0.20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# The symbols that the base rules count.
SYMBOLS = b"#*$%&|<>"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_DOC_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash (mod 2**64) of every window of ``length`` words."""
    windows = max(0, len(hashes) - length + 1)
    out = np.zeros(windows, np.uint64)
    for k in range(length if windows else 0):
        out = out * _MULTIPLIER + hashes[k : k + windows]
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """True where an equal key came before."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def covered(words: Words, hashes: np.ndarray, length: int) -> np.ndarray:
    """True for words inside an n-gram of ``length`` words that its text holds twice or more."""
    span = rolling(hashes, length)
    whole = words.doc[: len(span)] == words.doc[length - 1 :] if len(span) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    at = at[repeated(span[at] ^ (words.doc[at].astype(np.uint64) * _DOC_MULTIPLIER))]
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + length, -1)
    return np.cumsum(edges)[:-1] > 0


def duplicate_lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line, and the word characters in them."""
    breaks = np.flatnonzero(words.bytes == 10)
    starts = np.concatenate(([0], breaks[:-1] + 1))
    chars = np.concatenate(([0], np.cumsum(words.chars)))
    first, last = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, breaks)
    doc = np.searchsorted(words.begins, starts, "right") - 1
    keys = np.fromiter(map(hash, words.buffer.split(b"\n")), np.int64, len(starts)).view(np.uint64)
    again = later(keys ^ (doc.astype(np.uint64) * _DOC_MULTIPLIER)) & (last > first)
    count = np.bincount(doc[again], minlength=words.n_docs)
    inside = np.bincount(doc[again], (chars[last] - chars[first])[again], words.n_docs)
    return count.astype(np.int64), inside.astype(np.int64)


def measure(texts: list[bytes | None], ngram_limits: dict[int, float], line_limit: float) -> dict[str, np.ndarray]:
    """All columns of the result, for a run of texts."""
    words = Words(texts)
    hashes = words.hashes
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.concatenate(([0], np.cumsum(symbol[words.bytes])))
    n_words, word_chars = words.per_doc(), words.per_doc(words.chars)
    n_dup_lines, line_chars = duplicate_lines(words)
    n_repeat_words = words.per_doc(covered(words, hashes, 3))
    failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)
    out = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": (symbols[words.ends] - symbols[words.begins]).astype(np.int64),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
        "base_failed": failed,
        "dup_line_chars": line_chars,
    }
    over = line_chars > line_limit * word_chars
    for length, limit in ngram_limits.items():
        out[f"dup_{length}gram_chars"] = inside = words.per_doc(covered(words, hashes, length) * words.chars)
        over |= inside > limit * word_chars
    return out | {"kept": ~failed & ~over}


def quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Measures and verdict for every row of ``docs``: the id, then the measures.

    A null or empty text has no words and fails the base rules; a null id is carried. Repeated rows are
    judged one by one and an empty table gives an empty result. Very long texts are processed whole.
    Other columns are ignored, whatever their names.
    """
    limits = dict(NGRAM_LIMITS if ngram_limits is None else ngram_limits)
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "dup_line_chars", *(f"dup_{n}gram_chars" for n in limits), "kept"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = measure(binary(batch.column("text")), limits, line_limit)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(found[m]) for m in measures)], names=[id_col, *measures])

    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), *(T.StructField(m, T.BooleanType() if m in ("kept", "base_failed") else T.LongType()) for m in measures)])
    return source.mapInArrow(run, schema)


def accepted(docs: DataFrame, text: str = "text", ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns as they are."""
    limits = dict(NGRAM_LIMITS if ngram_limits is None else ngram_limits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            yield batch.filter(pa.array(measure(binary(batch.column(text)), limits, line_limit)["kept"]))

    return docs.mapInArrow(run, docs.schema)
