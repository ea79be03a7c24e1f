"""One writer at a time on a table of months, on any Hadoop file system.

A lease is a numbered file; a taker makes the next number once the last one has run out or was given back. A month is
written to a folder of its lease's number and counts once its marker is there, so months that are done are the checkpoint of a
killed run, and what it left half-written is never read. A writer that lost its lease cannot mark a month, and if it
still does, in the moment between looking and marking, the higher number's month is the one that is read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Busy(RuntimeError):
    """Another writer holds the lease."""


class Fenced(RuntimeError):
    """The lease was lost to a writer with a higher number."""


class _Files:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(folder))] if self.fs.exists(self.at(folder)) else []

    def write(self, name: str, text: str, overwrite: bool) -> bool:
        try:
            out = self.fs.create(self.at(name), overwrite)
        except Exception as e:
            if not overwrite and self.fs.exists(self.at(name)):
                return False
            raise e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


class Lease:
    """The right to write below ``path`` for ``seconds`` from the last renewal; ``number`` grows with every taker."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 600.0, clock=time.time):
        self.files, self.seconds, self.clock, self.owner = _Files(spark, path), seconds, clock, uuid.uuid4().hex
        last = self._last()
        if last and (until := self._until(last)) is not None and until > clock():
            raise Busy(f"{path} is leased until {until:.0f}")
        self.number = last + 1
        text = self._text()
        if not self.files.write(f"_lease/{self.number:012d}", text, False) or self.files.read(f"_lease/{self.number:012d}") != text:
            raise Busy(f"{path} was taken at this moment")

    def _text(self, until: float | None = None) -> str:
        return f"{self.owner} {self.clock() + self.seconds if until is None else until!r}"

    def _last(self) -> int:
        return max((int(n) for n in self.files.names("_lease") if n.isdigit()), default=0)

    def _until(self, number: int) -> float | None:
        parts = self.files.read(f"_lease/{number:012d}").split()
        return float(parts[1]) if len(parts) == 2 else None  # a taker that died while it wrote holds nothing

    def check(self) -> None:
        """An error if a later writer has taken over, or the lease has run out."""
        if self._last() != self.number or self.files.read(f"_lease/{self.number:012d}").split()[:1] != [self.owner]:
            raise Fenced(f"lease {self.number} was lost")
        if self._until(self.number) <= self.clock():
            raise Fenced(f"lease {self.number} has run out")

    def renew(self) -> None:
        self.check()
        self.files.write(f"_lease/{self.number:012d}", self._text(), True)

    def release(self) -> None:
        self.check()
        self.files.write(f"_lease/{self.number:012d}", self._text(0.0), True)


def _done(files: _Files) -> dict[str, int]:
    """Month -> the highest number that marked it."""
    out: dict[str, int] = {}
    for name in files.names("_done"):
        month, _, number = name.partition(".")
        if number.isdigit():
            out[month] = max(out.get(month, 0), int(number))
    return out


def months_to_do(spark: SparkSession, path: str, months: Iterable[str]) -> list[str]:
    done = _done(_Files(spark, path))
    return [m for m in months if m not in done]


def write_month(df: DataFrame, path: str, month: str, lease: Lease) -> None:
    """Write one month (yyyy-MM) under a lease; it counts from its marker on."""
    lease.renew()
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/rows/month={month}/lease={lease.number}")
    lease.check()
    lease.files.write(f"_done/{month}.{lease.number}", "", True)


def read_months(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all finished months, each from its highest lease, with their month."""
    done = _done(_Files(spark, path))
    out = spark.createDataFrame([], f"{schema}, month string")
    if not done:
        return out
    paths = [f"{path.rstrip('/')}/rows/month={m}/lease={n}" for m, n in sorted(done.items())]
    rows = spark.read.schema(f"{schema}, month string, lease long").option("basePath", f"{path.rstrip('/')}/rows").parquet(*paths)
    return rows.select(*out.columns)


def copy_by_month(df: DataFrame, path: str, lease: Lease, date: str = "date", unit: str = "yyyy-MM") -> list[str]:
    """Write the months (or other units) of ``df`` that are not done yet, in order; returns them. Run again after a loss, it goes on where it stopped."""
    spark = df.sparkSession
    month = F.date_format(date, unit)
    todo = months_to_do(spark, path, [r[0] for r in df.select(month.alias("m")).distinct().orderBy("m").collect()])  # a row a month
    for m in todo:
        write_month(df.where(month == m), path, m, lease)
    return todo
