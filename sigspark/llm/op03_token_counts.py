"""3. Token counts without token ids: pieces are counted once per distinct pre-token.

Pass 1 counts the distinct pre-tokens (white-space chunks, see ``tokens``) of the corpus, and the
tokenizer counts the pieces of each once. Pass 2 turns every document into pre-token frequencies and
joins the two. The join is split by frequency: the pre-tokens of the head, at most ``HEAD`` of them by
a threshold read off a histogram, are sent to all tasks, where frequencies times pieces are summed in
place; those of the tail go through a shuffle join. Hot pre-tokens never shuffle, and the broadcast has
a fixed bound at every size. A pre-token of over ``LONG`` bytes goes by a digest; its bytes travel to pass 1 alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, materialize, text_slices
from .tokens import encoder

LIMIT = 2048
HEAD = 1 << 18
LONG = 256


def key_of(chunk: bytes) -> bytes:
    """A short pre-token itself; a space, which none has, and a 128-bit digest for a long one."""
    return chunk if len(chunk) <= LONG else b" " + xxhash.xxh3_128_digest(chunk)


def vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """chunk, n, pieces: the key of every distinct pre-token, its frequency and its number of ids."""

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            keys = [pa.array([key_of(c) for c in counts], pa.binary()), pa.array([c if len(c) > LONG else None for c in counts], pa.binary())]
            out = pa.RecordBatch.from_arrays([*keys, pa.array(list(counts.values()), pa.int64())], names=["chunk", "long", "n"])
            counts.clear()
            return out

        for batch in text_slices(batches, text):
            counts.update(encoder(path).chunks(binary(batch.column(text)))[0])
            if len(counts) > 400_000:
                yield flush()
        yield flush()

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [x or c for c, x in zip(binary(batch["chunk"]), binary(batch["long"]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["chunk"], batch["n"], pa.array(encoder(path).counts(whole))], names=["chunk", "n", "pieces"])

    counted = docs.select(text).mapInArrow(local, "chunk binary, long binary, n long").groupBy("chunk", "long").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(pieces, "chunk binary, n long, pieces long")


def head_threshold(words: DataFrame, head: int) -> int:
    """The least frequency that at most ``head`` pre-tokens reach."""
    bins = words.groupBy(F.ceil(F.log2("n") * 64).alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    threshold, total = 1 << 62, 0
    for row in sorted(bins.collect(), key=lambda r: -r["bin"]):  # 64 bins for each doubling
        total += row["words"]
        if total > head:
            break
        threshold = row["least"]
    return threshold


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """For every row of ``docs``: id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    Counts are those of the tokenizer at ``path`` without added special tokens. Null texts are empty.
    Rows with equal or null ids are counted one by one; very long texts and chunks are counted whole;
    an empty table gives an empty result; other columns are ignored. A tokenizer that does not drop
    white space has no such pre-tokens and raises ValueError.
    """
    if not encoder(path).by_chunk:
        raise ValueError(f"{path}: this tokenizer joins pieces across white space")
    words = materialize(vocabulary(docs, path, text), "token-words")
    threshold = head_threshold(words, head)
    known = {bytes(r["chunk"]): r["pieces"] for r in words.where(F.col("n") >= threshold).select("chunk", "pieces").collect()}  # ``head`` rows at most
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        get = sent.value.get
        for batch in text_slices(batches, "text"):
            texts = binary(batch.column("text"))
            chunks, n_chunks = encoder(path).chunks(texts)
            if max(map(len, chunks), default=0) > LONG:
                chunks = [key_of(c) for c in chunks]
            found = np.fromiter(map(get, chunks, repeat(-1)), np.int64, len(chunks))
            doc = np.repeat(np.arange(len(texts)), n_chunks)
            tail: Counter[tuple[int, bytes]] = Counter()
            for i in np.flatnonzero(found < 0).tolist():
                tail[int(doc[i]), chunks[i]] += 1
            sums = np.bincount(doc, np.maximum(found, 0), len(texts)).astype(np.int64)
            sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
            n, m = len(texts), len(tail)
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((row + np.arange(n), [row + d for d, _ in tail])).astype(np.int64)), pa.concat_arrays([ids, pa.nulls(m, ids.type)]), pa.concat_arrays([pa.array(sizes), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([c for _, c in tail], pa.binary())]), pa.array(np.concatenate((sums, list(tail.values()))).astype(np.int64))],
                names=["row", "id", "n_bytes", "chunk", "n"],
            )
            row += n

    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), source.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("chunk", T.BinaryType()), T.StructField("n", T.LongType())])
    rows = materialize(source.mapInArrow(frequencies, schema), "token-frequencies")
    # every chunk was counted in pass 1; were the table to change in between, the query fails rather than drop tokens
    pieces = F.coalesce("pieces", F.raise_error(F.lit("token_counts: a pre-token of the second pass was not in the first")).cast("long"))
    tails = rows.where("chunk is not null").join(words.select("chunk", "pieces"), "chunk", "left").groupBy("row").agg(F.sum(F.col("n") * pieces).alias("rest"))
    total = F.col("n") + F.coalesce("rest", F.lit(0))
    summed = rows.where("chunk is null").join(tails, "row", "left")
    return summed.select(F.col("id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
