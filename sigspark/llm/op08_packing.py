"""8. Best-fit packing with swap-based local search.

Documents become pieces of at most ``SIZE`` tokens; a full piece is a sequence by itself. The others are dealt by
a hash of their place in the written table into groups of about ``GROUP`` pieces, each packed by one task. A
group is first filled bin after bin (next fit); then local search between underfull bins moves one document, or
exchanges one for one or two for one, each time raising the sum of squared fills, so that fuller bins fill
up and emptier ones run dry. It ends when no exchange helps or no fewer bins are possible. A group ends with a
bin or so that is not full, one in several thousand sequences.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, materialize, text_slices
from .tokens import encoder

SIZE = 4096
GROUP = 50_000


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int | None = 1) -> DataFrame:
    """id, piece, start, length, ids_crc32: every document's ids, cut only where longer than ``size``."""
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [] if end_id is None else [end_id]
        for batch in text_slices(batches, "text", 4 << 20):
            ids, sizes = encoder(path).encode(binary(batch.column("text")))
            row, piece, start, length, crc = [], [], [], [], []
            for i, own in enumerate(np.split(ids, np.cumsum(sizes)[:-1])):
                own = np.concatenate((own, tail)).astype("<u4")
                for k in range(0, len(own), size):
                    part = own[k : k + size]
                    row.append(i)
                    piece.append(k // size)
                    start.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            columns = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["id"], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in names[2:])])
    return source.mapInArrow(cut, schema)


def next_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers, filled one after the other in the items' order."""
    bins: list[list[int]] = []
    room = 0
    for item, length in enumerate(lengths):
        if length > room or not bins:
            bins.append([])
            room = size
        bins[-1].append(item)
        room -= length
    return bins


class _Givers:
    """Items of bins that may still give, by length; ``mask`` has a bit for each length there is."""

    def __init__(self) -> None:
        self.items: dict[int, set[int]] = {}
        self.mask = 0

    def add(self, length: int, item: int) -> None:
        self.items.setdefault(length, set()).add(item)
        self.mask |= 1 << length

    def remove(self, length: int, item: int) -> None:
        self.items[length].discard(item)
        if not self.items[length]:
            self.mask &= ~(1 << length)


def _sums(lengths: list[int]) -> tuple[int, int]:
    """Bit masks of the items' lengths and of the sums of two items."""
    singles = pairs = 0
    for n in lengths:
        pairs |= singles << n  # the items before this one
        singles |= 1 << n
    return singles, pairs


def _best_exchange(own: list[int], lengths: list[int], givers: int, room: int) -> tuple[int, int, list[int]] | None:
    """Most tokens that an exchange adds (at most ``room``), the length that comes, and the items of ``own`` that go back.

    Of equal gains the longest that can come: short items stay with the givers, where they fit last gaps. What
    may go back is taken by its sum of lengths, of which there are no more than a bin has places.
    """
    singles, pairs = _sums([lengths[i] for i in own])
    backs, best = 1 | singles | pairs, (0, 0)
    while backs:
        worth = backs.bit_length() - 1
        backs ^= 1 << worth
        come = (givers & ((1 << (worth + room + 1)) - 1)).bit_length() - 1
        if come - worth > best[0]:
            best = come - worth, come
            if best[0] == room:
                break
    gain, come = best
    worth = come - gain
    if not gain:
        return None
    if not worth:
        return gain, come, []
    if singles >> worth & 1:
        return gain, come, [next(i for i in own if lengths[i] == worth)]
    seen: dict[int, int] = {}
    for i in own:
        if worth - lengths[i] in seen:
            return gain, come, [seen[worth - lengths[i]], i]
        seen.setdefault(lengths[i], i)
    return None


def local_search(bins: list[list[int]], lengths: list[int], size: int, emptied: Counter[str] | None = None) -> list[list[int]]:
    """Raise the sum of squared fills by moves and exchanges between underfull bins until none helps.

    Receivers are taken fullest first and get the exchange that fills them best, from bins with more room:
    passing d tokens from a bin of fill f to one of fill g >= f changes the sum by 2d(g + d - f) > 0. The sum
    is bounded, so the search ends. ``emptied`` counts exchanges of each kind, and the bins run dry under "bins".
    """
    emptied = Counter() if emptied is None else emptied
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // size)
    used = sum(f > 0 for f in fill)
    gained = True
    while gained and used > least:
        open_ = sorted((b for b in range(len(bins)) if 0 < fill[b] < size), key=lambda b: -fill[b])
        home, givers, gained = {}, _Givers(), False
        for b in open_:
            for i in bins[b]:
                home[i] = b
                givers.add(lengths[i], i)
        for b in open_:
            if not fill[b]:
                continue
            for i in bins[b]:  # a receiver gives no more in this round
                givers.remove(lengths[i], i)
            while fill[b] < size:
                best = _best_exchange(bins[b], lengths, givers.mask, size - fill[b])
                if best is None:
                    break
                gain, come, back = best
                item = min(givers.items[come], key=lambda i: fill[home[i]]) if len(givers.items[come]) < 8 else next(iter(givers.items[come]))
                giver = home[item]
                givers.remove(come, item)
                bins[giver].remove(item)
                bins[b].append(item)
                for i in back:
                    bins[b].remove(i)
                    bins[giver].append(i)
                    home[i] = giver
                    givers.add(lengths[i], i)
                fill[b] += gain
                fill[giver] -= gain
                gained = True
                emptied[("move", "one for one", "two for one")[len(back)]] += 1
                if not fill[giver]:
                    used -= 1
                    emptied["bins"] += 1
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], size: int) -> list[list[int]]:
    return local_search(next_fit(lengths, size), lengths, size)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int | None = 1, group: int = GROUP) -> DataFrame:
    """For every piece of every row of ``docs``: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty and still have their end id. Rows with equal or null ids are packed one by one.
    Very long texts are encoded whole, then cut; full pieces have sequence ids below zero and join no group, so a
    long text fills none. An empty table gives an empty result; other columns are ignored.
    """
    cut = pieces(docs, path, id_col, text, size, end_id).withColumn("row", F.monotonically_increasing_id())
    cut = materialize(cut, "pack-pieces")
    own = [c for c in cut.columns if c != "row"]
    names = [*own, "sequence_id", "offset"]
    full = cut.where(F.col("length") == size).select(*own, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = cut.where(F.col("length") < size)
    groups = max(1, -(-part.count() // group))
    dealt = part.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def pack_group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        lengths = rows["length"].to_pylist()
        first = rows["group"][0].as_py() << 32
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(pack_lengths(lengths, size)):
            at = 0
            for i in b:
                sequence[i], offset[i] = first + k, at
                at += lengths[i]
        return pa.table([*(rows[c] for c in own), pa.array(sequence), pa.array(offset)], names=names)

    packed = dealt.groupBy("group").applyInArrow(pack_group, full.schema)
    return full.unionByName(packed).withColumnRenamed("id", id_col)
