"""10. SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit majority votes over shingle hashes. The anchors are the words of a covering
code: the product of ``k`` repetition codes of odd length L (each a perfect code of radius R = (L-1)/2);
``k`` grows with the number of distinct fingerprints, so that an anchor is home to about ``HOME`` of
them. A fingerprint is home at the anchor that its blocks decode to, and is sent to every anchor within
covering radius plus threshold: those where the distances of its blocks exceed R by at most the
threshold in sum. Of two fingerprints that link, either meets the other at its home. Anchors are compared with
numpy, and a task reports a spanning forest of the links it found, not the links; the components of
all forests are the components of all links. Copies share a fingerprint and are one node.

An anchor with more than ``DENSE`` visitors is covered once more, by a second code over other bits that is as long as
its anchors need: its visitors go to the pairs of first and second anchors, and those at home in both meet all within
the threshold, for the same reason. Where one code finds fingerprints close together, the other parts them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, free_name, materialize, text_slices
from .components import components

SHINGLE = 3
SEED = 42
THRESHOLD = 2
HOME = 64
DENSE = 50_000
_CHUNK = 100_000


def simhash(texts: list[bytes | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints as int64. A text of fewer words than a shingle is one shingle; one of none is 0."""
    ones, count = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    owners, hashes, pending = [], [], 0

    def vote() -> None:
        h = np.concatenate(hashes)
        own = np.repeat(np.array([d for d, _ in owners]), [n for _, n in owners])
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        begins = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
        hashes.clear()
        owners.clear()

    digest = xxhash.xxh64_intdigest
    for d, text in enumerate(texts):
        words = (text or b"").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = min(shingle, len(words))
        count[d] = n = len(words) - k + 1
        pairs = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
        for i in range(0, n, _CHUNK):
            m = min(_CHUNK, n - i)
            hashes.append(np.fromiter((digest(joined[a:b], seed) for _, (a, b) in zip(range(m), pairs)), np.uint64, m))
            owners.append((d, m))
            pending += m
            if pending >= _CHUNK:
                vote()
                pending = 0
    if hashes:
        vote()
    return np.packbits(2 * ones > count[:, None], axis=1).view(">u8").astype(np.uint64).ravel().view(np.int64)


def fingerprints(rows: DataFrame, text: str = "text", name: str = "fp", shingle: int = SHINGLE, seed: int = SEED, carry: bool = True) -> DataFrame:
    """``rows`` with the fingerprint (signed 64-bit) as the last column; without the text unless ``carry``."""
    fields = [f for f in rows.schema.fields if f.name != name and (carry or f.name != text)]
    own = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), pa.array(simhash(binary(batch[text]), shingle, seed))], names=[*own, name])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.LongType())]))


class Anchors:
    """The covering code for about ``n`` fingerprints and the anchors that each must visit.

    ``turned``: blocks take every so many-th bit instead of neighbours.
    """

    def __init__(self, n: int, threshold: int, turned: bool = False):
        self.blocks = min(64, max(2, math.ceil(math.log2(max(1, n / HOME)))))
        length = 64 // self.blocks
        self.length = length - 1 + length % 2
        self.threshold = threshold
        places = [[self.blocks * j + k if turned else self.length * k + j for j in range(self.length)] for k in range(self.blocks)]
        self.masks = [sum(1 << b for b in block) for block in places]

    def visits(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and anchors; the first len(fps) of them are the homes, in order."""
        radius = (self.length - 1) // 2
        weight = np.stack([np.bitwise_count(fps & np.uint64(m)) for m in self.masks], axis=1).astype(np.int64)
        bits = weight > radius
        place = np.uint64(1) << np.arange(self.blocks, dtype=np.uint64)
        home = (bits * place).sum(axis=1, dtype=np.uint64)
        excess = np.where(bits, weight - radius, radius + 1 - weight)  # of the block's other code word
        row, at, spent, last = np.arange(len(fps)), home, np.zeros(len(fps), np.int64), np.full(len(fps), -1)
        rows, anchors = [row], [at]
        for _ in range(min(self.threshold, self.blocks)):  # one more block differs from home, in rising order
            more = []
            for k in range(self.blocks):
                ok = np.flatnonzero((last < k) & (spent + excess[row, k] <= self.threshold))
                more.append((row[ok], at[ok] ^ place[k], spent[ok] + excess[row[ok], k], np.full(len(ok), k)))
            row, at, spent, last = (np.concatenate(x) for x in zip(*more, strict=True))
            rows.append(row)
            anchors.append(at)
        return np.concatenate(rows), np.concatenate(anchors)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that connect what the links a-b connect."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that end where a run of equal keys ends, from batches sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or held[0][key][0].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _send(code: Anchors, again: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (anchor, second, fp, home) for every anchor that a fingerprint visits; ``again``: for every second anchor of such rows."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                part = batch.slice(i, 5000)
                fps = part["fp"].to_numpy().view(np.uint64)
                row, anchor = code.visits(fps)
                at_home = np.arange(len(row)) < len(fps)
                first = part["anchor"].to_numpy()[row] if again else anchor.view(np.int64)
                second = anchor.view(np.int64) if again else np.zeros(len(row), np.int64)
                home = at_home & part["home"].to_numpy(zero_copy_only=False)[row] if again else at_home
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(fps[row].view(np.int64)), pa.array(home)], names=["anchor", "second", "fp", "home"])

    return send


def links(distinct: DataFrame, n: int, threshold: int = THRESHOLD, dense: int = DENSE) -> DataFrame:
    """a, b: spanning forests of the links between the ``n`` fingerprints in ``distinct`` (fp)."""
    code = Anchors(n, threshold)
    visits = "anchor long, second long, fp long, home boolean"

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for table in whole_groups(batches, "anchor"):
            anchor, second = table["anchor"].to_numpy(), table["second"].to_numpy()
            fps, home = table["fp"].to_numpy().view(np.uint64), table["home"].to_numpy()
            begins = np.flatnonzero((anchor[1:] != anchor[:-1]) | (second[1:] != second[:-1])) + 1
            edges = [0, *begins.tolist(), len(anchor)]
            for begin, end in zip(edges, edges[1:], strict=False):
                all_ = fps[begin:end]
                own = all_[home[begin:end]]
                step = max(1, 2_000_000 // len(all_))
                for i in range(0, len(own), step):
                    x, y = np.nonzero(np.bitwise_count(own[i : i + step, None] ^ all_) <= threshold)
                    x, y = own[i + x], all_[y]
                    later = x < y
                    found.append((x[later].view(np.int64), y[later].view(np.int64)))
                    held += len(found[-1][0])
                    if held > 2_000_000:
                        found = [forest(*map(np.concatenate, zip(*found, strict=True)))]
                        held = len(found[0][0])
        if held:
            a, b = forest(*map(np.concatenate, zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    sent = distinct.select("fp").mapInArrow(_send(code, False), visits)
    crowds = materialize(sent.groupBy(F.col("anchor").alias("crowd")).agg(F.count("*").alias("n")).where(F.col("n") > dense), "simhash-dense")
    most = crowds.agg(F.max("n")).first()[0]
    if most is not None:
        again = sent.join(crowds.select("crowd"), F.col("anchor") == F.col("crowd"), "left_semi").mapInArrow(_send(Anchors(most, threshold, turned=True), True), visits)
        sent = sent.join(crowds.select("crowd"), F.col("anchor") == F.col("crowd"), "left_anti").unionByName(again)
    return sent.repartition("anchor", "second").sortWithinPartitions("anchor", "second").mapInArrow(compare, "a long, b long")


def classes(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """fp, root and component_id for every fingerprint of ``prints`` (id, fp)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = materialize(components(links(distinct, distinct.count(), threshold)).select(F.col("node").alias("fp"), "root"), "simhash-roots")
    named = materialize(roots.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("name")), "simhash-names")
    linked = roots.join(named, "root")
    # a name of null stays null where the component has no id at all
    of_linked = F.when(F.col("root").isNotNull(), F.col("name")).otherwise(F.col("least"))
    return materialize(distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), of_linked.alias("component_id")), "simhash-known")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, seed: int = SEED) -> DataFrame:
    """For every row of ``docs``: id, fingerprint (16 hex digits) and component_id.

    The component is that of links at ``threshold`` or fewer differing bits, named by its smallest id;
    rows without an id link others but do not name a component unless they are all it has (then null).
    Null or empty texts have fingerprint zero, linked like any other. Repeated rows each return. Very
    long texts are hashed whole; an empty table gives an empty result; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    prints = materialize(fingerprints(own, shingle=shingle, seed=seed, carry=False), "simhash-prints")
    known = classes(prints, threshold)
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(known, "fp").select(F.col("id").alias(id_col), fingerprint.alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, seed: int = SEED) -> DataFrame:
    """One row of ``docs`` of each component: one with the smallest id; all columns as they are, whatever their names.

    Null and empty texts are one group; rows without an id go first only where all of a component lack one. Of rows
    with equal ids that with the least hash of its columns stays, so reruns agree; rows equal in all columns are one. Very long texts are hashed whole; an empty table gives an
    empty result. A row is known by its id and two hashes of its columns, so that of the texts only the winners'
    join moves any.
    """
    id_ = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name")
    whole = [F.xxhash64(text, *docs.columns), F.xxhash64(*docs.columns, text)]
    own = docs.select(F.col(id_col).alias("id"), id_, whole[0].alias("hash"), whole[1].alias("hash2"), F.col(text).alias("text"))
    prints = materialize(fingerprints(own, shingle=shingle, seed=seed, carry=False), "simhash-prints")
    known = classes(prints.select("id", "fp"), threshold)
    first = prints.join(known, "fp").where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("name", "hash", "hash2")).alias("k"))
    names = [free_name(docs, n) for n in ("name", "hash", "hash2")]
    kept = materialize(first.select(*(F.col(f"k.{c}").alias(n) for c, n in zip(("name", "hash", "hash2"), names, strict=True))).distinct(), "simhash-kept")
    named = docs.withColumns(dict(zip(names, (id_, *whole), strict=True)))
    return named.join(kept, names, "left_semi").dropDuplicates(names).select(*docs.columns)
