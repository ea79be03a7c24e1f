"""5. Token files: each document a zstandard frame of its own, under one shared dictionary.

A dataset is a folder of ``shard-*.tok`` files, ``dictionary.zdict`` and a Parquet ``manifest`` with one
row per shard. A shard holds documents in ascending id order:

    "SGTK" | u16 version | u16 bytes per id (2 or 4) | sha256 of the dictionary | frames
    index: i64 ids | u8 id is null | u64 frame ends (from the file's start) | u64 ids before the frame, with one more for the end
    footer: u64 index place | u64 documents | "SGTK"

Little-endian throughout. A reader seeks to one index entry and one frame. The dictionary is trained on
serialized ids of a bounded sample (``SAMPLE`` documents of ``SAMPLE_IDS`` ids); every document is
written. Tasks write under names of their own and only the committed manifest says which files count,
so retried and speculative attempts do no harm.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary, input_bytes, text_slices
from .tokens import encoder

MAGIC = b"SGTK"
HEADER = "<4sHH32s"
FOOTER = "<QQ4s"
SHARD_BYTES = 32 << 20  # of text
SAMPLE, SAMPLE_IDS, DICTIONARY = 1000, 4096, 64 << 10
LEVEL = 2


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def train_dictionary(docs: DataFrame, path: str, n_docs: int, width: int, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> bytes:
    """A dictionary from about ``sample`` documents picked by the hash of their id; empty if there is too little to learn from."""

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            ids, sizes = encoder(path).encode(binary(batch.column("text")))
            each = np.split(ids, np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_IDS].astype(f"<u{width}").tobytes() for x in each], pa.binary())], names=["ids"])

    picked = docs.where(F.pmod(F.xxhash64(id_col), F.lit(max(1, n_docs // sample))) == 0).select(F.col(text).alias("text"))
    samples = [bytes(r["ids"]) for r in picked.mapInArrow(heads, "ids binary").limit(2 * sample).collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(256, sum(map(len, samples)) // 10)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_dataset(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text: str = "text", end_id: int | None = 1, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every text with the tokenizer at ``path``, append ``end_id``, and write the dataset to ``out``.

    Null texts are empty. Rows with equal ids are documents of their own, side by side; null ids come
    first. A very long text is one frame. An empty table gives a dataset without shards.
    """
    spark = docs.sparkSession
    width = 2 if encoder(path).size <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
    n_docs = docs.count()
    words = train_dictionary(docs, path, n_docs, width, id_col, text)
    fs, where = _open(out)
    fs.create_dir(where, recursive=True)
    with fs.open_output_stream(f"{where}/dictionary.zdict") as f:
        f.write(words)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(words) if words else None
        zip_ = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        fs, where = _open(out)
        name, file = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok", None
        docs_, nulls, ends, before = [], [], [], [0]
        for batch in text_slices(batches, "text", 4 << 20):
            ids, sizes = encoder(path).encode(binary(batch.column("text")))
            if file is None:
                file = fs.open_output_stream(f"{where}/{name}")
                at = file.write(struct.pack(HEADER, MAGIC, 1, width, hashlib.sha256(words).digest()))
            tail = np.array([] if end_id is None else [end_id], f"<u{width}").tobytes()
            stop = np.cumsum(sizes)
            for begin, end in zip((stop - sizes).tolist(), stop.tolist(), strict=True):
                at += file.write(zip_.compress(ids[begin:end].astype(f"<u{width}").tobytes() + tail))
                ends.append(at)
                before.append(before[-1] + end - begin + (end_id is not None))
            keys = batch.column("id").to_pylist()
            docs_ += [k or 0 for k in keys]
            nulls += [k is None for k in keys]
        if file is not None:
            file.write(np.array(docs_, "<i8").tobytes() + np.array(nulls, "u1").tobytes() + np.array(ends, "<u8").tobytes() + np.array(before, "<u8").tobytes())
            file.write(struct.pack(FOOTER, at, len(docs_), MAGIC))
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([name]), pa.array([len(docs_)], pa.int64()), pa.array([before[-1]], pa.int64())], names=["shard", "file", "n_docs", "n_tokens"])

    shards = max(1, -(-input_bytes(docs, text) // shard_bytes))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    ordered = keyed.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(write, "shard long, file string, n_docs long, n_tokens long").write.mode("overwrite").parquet(f"{out}/manifest")


class Shard:
    """Random access to one shard: ``Shard(uri, dictionary)[k]`` reads one index entry and one frame."""

    def __init__(self, uri: str, words: bytes):
        fs, where = _open(uri)
        self.file = fs.open_input_file(where)
        size = self.file.size()
        self.index, self.n, magic = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        first, _, self.width, digest = struct.unpack(HEADER, self.file.read_at(struct.calcsize(HEADER), 0))
        if first != MAGIC or magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        if digest != hashlib.sha256(words).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)

    def _entries(self, place: int, k: int, count: int, kind: str) -> np.ndarray:
        kind = np.dtype(kind)
        return np.frombuffer(self.file.read_at(count * kind.itemsize, self.index + place + k * kind.itemsize), kind)

    def ids(self) -> list[int | None]:
        return [None if null else i for i, null in zip(self._entries(0, 0, self.n, "<i8").tolist(), self._entries(8 * self.n, 0, self.n, "u1").tolist(), strict=True)]

    def starts(self) -> np.ndarray:
        return self._entries(17 * self.n, 0, self.n + 1, "<u8").astype(np.int64)

    def __getitem__(self, k: int) -> np.ndarray:
        begin = int(self._entries(9 * self.n, k - 1, 1, "<u8")[0]) if k else struct.calcsize(HEADER)
        return self._frame(begin, int(self._entries(9 * self.n, k, 1, "<u8")[0]))

    def _frame(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.unzip.decompress(self.file.read_at(end - begin, begin)), f"<u{self.width}").astype("<u4")

    def frames(self) -> Iterator[np.ndarray]:
        begin = struct.calcsize(HEADER)
        for end in self._entries(9 * self.n, 0, self.n, "<u8").tolist():
            yield self._frame(begin, end)
            begin = end


def read_dictionary(out: str) -> bytes:
    fs, where = _open(out)
    with fs.open_input_stream(f"{where}/dictionary.zdict") as f:
        return f.read()


def read_dataset(spark: SparkSession, out: str, id_col: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row per document in the files: id, start (ids before it in the dataset), n_tokens, ids_crc32, and ``ids`` if asked for."""
    manifest = spark.read.schema("shard long, file string, n_docs long, n_tokens long").parquet(f"{out}/manifest")
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("base", base)
    names = [id_col, "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = read_dictionary(out)
        for batch in batches:
            for name, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist(), strict=True):
                shard = Shard(f"{out}/{name}", words)
                keys, starts, frames = shard.ids(), shard.starts(), shard.frames()
                for k in range(0, shard.n, 500):
                    part = [next(frames) for _ in keys[k : k + 500]]
                    columns = [pa.array(keys[k : k + 500], pa.int64()), pa.array(starts[k : k + len(part)] + base), pa.array([len(x) for x in part], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array([x.astype(np.int64) for x in part], pa.list_(pa.int64()))] if ids else [])], names=names)

    fields = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    n = max(1, manifest.count())
    return shards.repartitionByRange(n, "shard").mapInArrow(read, fields)
