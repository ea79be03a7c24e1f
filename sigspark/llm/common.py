"""What the operators of this subpackage share: tables, scratch folders, batches and words.

A *word* is everywhere ``[^\\x20\\x09-\\x0D]+``, which is what ``bytes.split()`` splits UTF-8 at.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: True for bytes that begin a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    A temporary folder stands in only where the setting is absent and the master is local, as in tests.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sigspark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A path for one run of one operator; nobody else uses it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and any executor may be lost."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` lacks; Spark does not tell letter case apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def input_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; one cheap pass, used to size blocks and shards."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        run = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if end > begin:
                yield batch.slice(begin, end - begin)


class Words:
    """The words of a run of texts, found with numpy over one buffer; texts are parted by a newline.

    ``hashes``: 64-bit hash of each word (equal within one process), ``doc``: index of its text,
    ``chars``: its code points.
    """

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        self.buffer = b"\n".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.cumsum(sizes + 1) - (sizes + 1)
        self.ends = self.begins + sizes
        self.bytes = np.frombuffer(self.buffer + b"\n", np.uint8)
        white = WHITE[self.bytes]
        edge = np.diff(white.astype(np.int8), prepend=np.int8(1))
        self.starts = np.flatnonzero(edge == -1)
        self.stops = np.flatnonzero((edge == 1) & (np.arange(len(edge)) > 0))[: len(self.starts)]
        self.points = np.concatenate(([0], np.cumsum(LEADS[self.bytes])))
        self.chars = self.points[self.stops] - self.points[self.starts]
        self.doc = np.searchsorted(self.begins, self.starts, "right") - 1
        self.n_docs = len(texts)

    @property
    def hashes(self) -> np.ndarray:
        return np.fromiter(map(hash, self.buffer.split()), np.int64, len(self.starts)).view(np.uint64)

    def per_doc(self, weights: np.ndarray | None = None) -> np.ndarray:
        """Sum of a weight over the words of each text."""
        return np.bincount(self.doc, weights, self.n_docs).astype(np.int64)
