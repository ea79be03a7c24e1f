"""12. Secrets, told apart by how widely they are owned.

Patterns find spans in every text. What they hold (and other long runs of letters and digits) are candidates, known by a digest of
their value. For each digest Spark counts the distinct repositories and owners that hold it, in all of the corpus: a value that many owners
hold is a copied example, one of few owners that also looks random is a live credential. Only digests are shuffled, never texts, and copies of a
digest within a task are counted together first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEADS, binary, materialize, text_slices

KINDS = ("assign", "access", "hex", "live")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX, LEAST_RUN = 12, 18, 16, 20
OWNERS, REPOSITORIES = 2, 25  # most of them that a live credential has
#: A live credential: 16 characters or more, 4 letters, 4 digits, 8 different ones, none of these in it in either case.
LIVE_LENGTH, LIVE_LETTERS, LIVE_DIGITS, LIVE_DISTINCT = 16, 4, 4, 8
PLACEHOLDER = re.compile(rb"example|sample|dummy|placeholder|changeme|your_|xxxx|123456|abcdef", re.IGNORECASE)

_HEX, _RUN = np.zeros(256, bool), np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")] = True


def runs(data: np.ndarray, of: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Begin and end of the maximal runs of at least ``least`` bytes of a class."""
    edge = np.flatnonzero(np.diff(of[data].astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    begins, ends = edge[::2], edge[1::2]
    long = ends - begins >= least
    return list(zip(begins[long].tolist(), ends[long].tolist(), strict=True))


def looks_live(value: bytes) -> bool:
    letters, digits = sum(map(value.count, _LETTERS)), sum(map(value.count, _DIGITS))
    return len(value) >= LIVE_LENGTH and letters >= LIVE_LETTERS and digits >= LIVE_DIGITS and len(set(value)) >= LIVE_DISTINCT and not PLACEHOLDER.search(value)


_DIGITS = [bytes([c]) for c in b"0123456789"]
_LETTERS = [bytes([c]) for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]


@dataclass
class Found:
    """Base spans (kind, start, end) and candidates (start, end, digest, looks live) of a text, in code points."""

    spans: list[tuple[int, int, int]]
    candidates: list[tuple[int, int, bytes, bool]]


def scan(texts: list[bytes | None]) -> list[Found]:
    """All spans and candidates of some texts; the runs of all of them are found in one sweep."""
    texts = [t or b"" for t in texts]
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]  # bytes of the text
    values: list[set[tuple[int, int]]] = [set() for _ in texts]

    def place(found: list[tuple[int, int]], kind: int | None) -> None:
        for a, b in found:
            i = int(np.searchsorted(begins, a, "right")) - 1
            a, b = int(a - begins[i]), int(b - begins[i])
            values[i].add((a, b))
            if kind is not None:
                spans[i].append((kind, a, b))

    if len(data):
        place(runs(data, _HEX, LEAST_HEX), 2)
        place(runs(data, _RUN, LEAST_RUN), None)
    place([m.span() for m in ACCESS.finditer(joined) if m.end() - m.start() >= LEAST_ACCESS], 1)
    for i, text in enumerate(texts):
        lower = text.lower()
        if any(w.encode() in lower for w in WORDS):
            for m in ASSIGN.finditer(text):
                if m.end(2) - m.start(2) >= LEAST_ASSIGN:
                    spans[i].append((0, m.start(), m.end()))
                    values[i].add(m.span(2))
    out = []
    for text, own, held in zip(texts, spans, values, strict=True):
        if held and not text.isascii():
            points = np.concatenate(([0], np.cumsum(LEADS[np.frombuffer(text, np.uint8)])))
        else:
            points = None
        at = (lambda p: p) if points is None else (lambda p, points=points: int(points[p]))
        base = sorted(((k, at(a), at(b)) for k, a, b in own), key=lambda s: (s[1], s[0]))
        candidates = [(at(a), at(b), hashlib.blake2b(text[a:b], digest_size=16).digest(), looks_live(text[a:b])) for a, b in sorted(held)]
        out.append(Found(base, candidates))
    return out


_SCHEMA = "repository {repo}, owner {owner}, row long, kinds array<int>, starts array<long>, ends array<long>, held array<struct<start:long,end:long,digest:binary,live:boolean>>"


def scanned(docs: DataFrame, text: str, repository: str, owner: str) -> DataFrame:
    """Spans and candidates of every document, without its text; ``row`` numbers the rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            found = scan(binary(part["text"]))
            held = [[{"start": a, "end": b, "digest": d, "live": y} for a, b, d, y in f.candidates] for f in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("digest", pa.binary()), ("live", pa.bool_())]))
            columns = [pa.array([[s[j] for s in f.spans] for f in found], pa.list_(pa.int32() if j == 0 else pa.int64())) for j in range(3)]
            yield pa.RecordBatch.from_arrays([part["repository"], part["owner"], part["row"], *columns, pa.array(held, kind)], names=["repository", "owner", "row", "kinds", "starts", "ends", "held"])

    named = docs.select(F.col(repository).alias("repository"), F.col(owner).alias("owner"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    kinds = {"repo": docs.schema[repository].dataType.simpleString(), "owner": docs.schema[owner].dataType.simpleString()}
    return named.mapInArrow(run, _SCHEMA.format(**kinds))


def ownership(found: DataFrame) -> DataFrame:
    """digest, repositories, owners: how many distinct ones hold each candidate; a null one counts as one more.

    Pairs are made distinct first, so that the copies of a value, however many, are dealt out by all three keys.
    """
    held = found.where(F.size("held") > 0).select("repository", "owner", F.explode(F.array_distinct(F.transform("held", lambda c: c["digest"]))).alias("digest"))
    per_owner = held.distinct().groupBy("digest", "owner").agg(F.count("*").alias("repositories"))
    return per_owner.groupBy("digest").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def find_secrets(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """repository, and of its text n_assign, n_access, n_hex, n_live, n_copied (candidates held by more), base (spans
    as kind:start:end) and spans (base ones and those of live credentials), sorted by start, then kind, then end.

    One row for each document. A live span is the value of a base span, or a run of at least 20 letters, digits and
    underscores, that looks random, is no placeholder, and is held by at most ``owners`` owners and ``repositories`` repositories
    (a repository under two owners counts twice). Places are code points, ends exclusive. A null or empty text has no
    spans. Repeated rows each get a row, and count as one holder; null owners and null repositories are one
    owner and one repository. An empty table gives no rows; other columns are ignored.
    """
    found = materialize(scanned(docs, text, repository, owner), "secrets-found")
    wide = materialize(ownership(found), "secrets-ownership")
    each = found.where(F.size("held") > 0).select("row", F.explode("held").alias("c")).select("row", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.live").alias("live"), F.col("c.digest").alias("digest"))
    narrow = (F.col("owners") <= owners) & (F.col("repositories") <= repositories)
    judged = each.join(wide, "digest").select("row", "start", "end", (F.col("live") & narrow).alias("is_live"), (~narrow).alias("copied"))
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("is_live"), F.struct("start", F.lit(3).alias("kind"), "end")))).alias("live"), F.count_if("copied").alias("n_copied"))  # the candidates of one document
    base = F.transform(F.arrays_zip("starts", "kinds", "ends"), lambda s: F.struct(s["starts"].alias("start"), s["kinds"].alias("kind"), s["ends"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    joined = found.join(spans, "row", "left").withColumn("live", F.coalesce("live", none)).withColumn("base", base)
    return joined.select(
        F.col("repository").alias(repository), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.size("live").cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        written(F.col("base")).alias("base"), written(F.array_sort(F.concat("base", "live"))).alias("spans"),
    )
