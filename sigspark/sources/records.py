"""Message records in loose CSV: a record begins at a line with an id and a comma, other lines continue it.

A Python data source reads each file line by line and yields Arrow batches, so a file is never held
whole. Files are the unit of parallelism; a record may span lines, so files are not split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed value: how a record begins.
RECORD_START = re.compile(rb"^(\d{5,12}),")
BATCH = 10_000


def unquote(body: str) -> str:
    """Without a pair of outer quotes; doubled quotes inside become single."""
    body = body.strip()
    if len(body) >= 2 and body[0] == body[-1] == '"':
        body = body[1:-1]
    return body.replace('""', '"')


def records(lines: Iterator[bytes]) -> Iterator[tuple[int, str]]:
    """(message_id, message_body); lines before the first record, such as a header, are skipped."""
    key, body = None, []
    for line in lines:
        line = line.rstrip(b"\r\n")
        if start := RECORD_START.match(line):
            if key is not None:
                yield key, unquote("\n".join(body))
            key, body = int(start[1]), [line[start.end() :].decode("utf-8", "replace")]
        elif key is not None:
            body.append(line.decode("utf-8", "replace"))
    if key is not None:
        yield key, unquote("\n".join(body))


class _File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class _Reader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[_File]:
        fs, where = pafs.FileSystem.from_uri(self.uri)
        info = fs.get_file_info(where)
        if info.type == pafs.FileType.File:
            return [_File(self.uri)]
        scheme = self.uri[: -len(where)] if self.uri.endswith(where) else ""
        found = fs.get_file_info(pafs.FileSelector(where, recursive=True))
        return [_File(scheme + f.path) for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(partition.uri)
        with pa.PythonFile(fs.open_input_stream(where), mode="r") as raw:
            keys, bodies = [], []
            for key, body in records(_lines(raw)):
                keys.append(key)
                bodies.append(body)
                if len(keys) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bodies)], names=["message_id", "message_body"])
                    keys, bodies = [], []
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bodies)], names=["message_id", "message_body"])


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


class MessageRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_records"

    def schema(self) -> str:
        return "message_id long, message_body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """message_id and message_body of all records of a file or of the files below a folder."""
    spark.dataSource.register(MessageRecords)
    return spark.read.format("message_records").load(path)
