"""4. Line dedup with two Bloom filters, for hashes seen once and hashes seen twice.

Documents are dealt by hash into blocks of about ``BLOCK_BYTES``. Every block sends one 64-bit hash per distinct
key to the part of the hash range that it falls in. A part has its own pair of filters, ``BITS_PER_LINE`` bits for each
of about ``PART_LINES`` lines: a hash whose bits are all set in the once-filter sets them in the twice-filter. The
part then tests its hashes against the twice-filter and answers each block with one bit per hash. Filters are
made and tested where they live, so they grow with the input, and none is collected or sent out. Only the
suspected keys go on, as 128-bit digests: their documents are counted exactly and the keeper is chosen. A filter too
small for its lines would let more keys through and the result stays exact.

The blocks' shuffle is made once and read by all three steps (hashes, suspects, rewriting): a text moves once.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, free_name

MIN_CHARS = 20
MIN_DOCS = 3
BITS_PER_LINE = 16
PROBES = 3
PART_LINES = 1 << 17
BLOCK_BYTES = 8 << 20
STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The line's key, or None if it is too short."""
    key = line.strip(STRIP).lower()
    return key if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars) else None


def keys_of(text: bytes | None, min_chars: int) -> set[bytes]:
    return {k for line in (text or b"").split(b"\n") if (k := key_of(line, min_chars)) is not None}


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions for each 64-bit hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) % np.uint64(bits) for k in range(PROBES)], axis=1).astype(np.int64)


def parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of the hash range of each hash: falls in order with the sorted hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def twice_seen(hashes: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """For each block's distinct hashes, which of them the twice-filter holds; never misses one of two blocks."""
    once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
    for own in hashes:
        at = probes(own, bits)
        seen = once[at].all(axis=1)
        twice[at[seen].ravel()] = True
        once[at.ravel()] = True
    return [twice[probes(own, bits)].all(axis=1) for own in hashes]


def block_hashes(texts: list[bytes | None], known: list[bool], min_chars: int) -> tuple[list[set[bytes]], np.ndarray, np.ndarray]:
    """Keys of each text, the sorted distinct hashes of them all, and which hashes two texts of the block hold."""
    keys = [keys_of(t, min_chars) if ok else set() for t, ok in zip(texts, known, strict=True)]
    flat = [k for own in keys for k in own]
    hashes, n = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat)), return_counts=True)
    return keys, hashes, n > 1


def repeated_keys(dealt: DataFrame, id_col: str, text: str, block: str, min_chars: int, min_docs: int, parts: int, bits: int) -> DataFrame:
    """block, doc, digest: the keys that each document of each block has to drop."""

    def ask(rows: pa.Table) -> pa.Table:
        _, hashes, local = block_hashes(binary(rows[text]), rows[id_col].is_valid().to_pylist(), min_chars)
        part = parts_of(hashes, parts)
        full, begins = np.unique(part, return_index=True)
        cuts = list(zip(begins.tolist(), [*begins[1:].tolist(), len(hashes)], strict=True)) if len(full) else []
        columns = [pa.array(full, pa.int64()), pa.array([rows[block][0].as_py()] * len(full), pa.int64()), pa.array([hashes[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([np.packbits(local[a:b]).tobytes() for a, b in cuts], pa.binary())]
        return pa.table(columns, names=["part", "block", "hashes", "local"])

    def answer(rows: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(h, np.uint64) for h in rows["hashes"].to_pylist()]
        found = twice_seen(hashes, bits)
        local = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(h)].astype(bool) for x, h in zip(rows["local"].to_pylist(), hashes, strict=True)]
        # a hash that two texts of one block hold may be in that block alone
        return pa.table([rows["block"], rows["part"], pa.array([np.packbits(f | x).tobytes() for f, x in zip(found, local, strict=True)], pa.binary())], names=["block", "part", "twice"])

    kind = dealt.schema[id_col].dataType

    def suspects(rows: pa.Table, answers: pa.Table) -> pa.Table:
        keys, hashes, _ = block_hashes(binary(rows[text]), rows[id_col].is_valid().to_pylist(), min_chars)
        twice = np.zeros(len(hashes), bool)
        edges = np.searchsorted(parts_of(hashes, parts), np.arange(parts + 1)) if len(hashes) else np.zeros(parts + 1, np.int64)
        for part, bits_ in zip(answers["part"].to_pylist(), answers["twice"].to_pylist(), strict=True):
            a, b = edges[part], edges[part + 1]
            twice[a:b] = np.unpackbits(np.frombuffer(bits_, np.uint8))[: b - a].astype(bool)
        seen = set(hashes[twice].tolist())
        row, digests = [], []
        for i, own in enumerate(keys):
            hit = [digest(k) for k in own if xxhash.xxh3_64_intdigest(k) in seen]
            row += [i] * len(hit)
            digests += hit
        at = pa.array(row, pa.int64())
        return pa.table([rows[block].take(at), rows[id_col].take(at), pa.array(digests, pa.binary())], names=["block", "doc", "digest"])

    asked = dealt.groupBy(block).applyInArrow(ask, "part long, block long, hashes binary, local binary")
    answered = asked.groupBy("part").applyInArrow(answer, "block long, part long, twice binary")
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc", kind), T.StructField("digest", T.BinaryType())])
    found = dealt.groupBy(block).cogroup(answered.groupBy("block")).applyInArrow(suspects, schema)
    confirmed = found.groupBy("digest").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs)
    return found.join(confirmed, "digest").where(F.col("doc") != F.col("keeper")).select("block", "doc", "digest").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: tuple[str, str] | None = ("n_lines", "n_dropped"), block_bytes: int = BLOCK_BYTES, part_lines: int = PART_LINES, bits_per_line: float = BITS_PER_LINE) -> DataFrame:
    """``docs`` without repeated lines: all its columns, then lines before and lines dropped, if ``counts`` names them.

    A line's key is the line stripped of white space at both ends with A-Z lower-cased. A key of at
    least ``min_chars`` code points in at least ``min_docs`` documents loses all its lines except in the
    largest id that holds it. Null texts are one empty line and become empty. Rows without an id stay
    as they are and count for nothing; rows with one id are one document, wherever they are dealt. Very long texts
    and lines are processed whole; an empty table gives an empty result. A column named like a count is replaced;
    other columns stay, whatever their names.
    """
    lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    n_bytes, n_lines = docs.agg(F.sum(F.octet_length(text)), F.sum(lines)).first()
    blocks, parts = max(1, -(-(n_bytes or 0) // block_bytes)), max(1, -(-(n_lines or 0) // part_lines))
    names, block = [c for c in docs.columns if c not in (counts or ())], free_name(docs, "block")
    # dealt by content, so that a task run again deals alike; only rows equal in id and text stay together
    dealt = docs.select(*names).withColumn(block, F.pmod(F.xxhash64(id_col, text), F.lit(blocks))).repartition(blocks, block)
    dropped = repeated_keys(dealt, id_col, text, block, min_chars, min_docs, parts, max(64, int(part_lines * bits_per_line)))

    def rewrite(rows: pa.Table, drops: pa.Table) -> pa.Table:
        gone: dict[object, set[bytes]] = {}
        for doc, key in zip(drops["doc"].to_pylist(), drops["digest"].to_pylist(), strict=True):
            gone.setdefault(doc, set()).add(key)
        kept, before, after = [], [], []
        for doc, t in zip(rows[id_col].to_pylist(), binary(rows[text]), strict=True):
            lines = (t or b"").split(b"\n")
            drop = gone.get(doc)
            left = [x for x in lines if (k := key_of(x, min_chars)) is None or digest(k) not in drop] if drop else lines
            kept.append(b"\n".join(left))
            before.append(len(lines))
            after.append(len(lines) - len(left))
        columns = [pa.array(kept, pa.binary()).cast(pa.string()) if c == text else rows[c] for c in names]
        extra = [pa.array(before, pa.int64()), pa.array(after, pa.int64())] if counts else []
        return pa.table([*columns, *extra], names=[*names, *(counts or ())])

    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in counts or ())])
    return dealt.groupBy(block).cogroup(dropped.groupBy("block")).applyInArrow(rewrite, schema)
