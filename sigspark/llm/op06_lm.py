"""6. LM scoring with a weighted backoff automaton.

The model is an n-gram model over words and text ends, smoothed by absolute discounting (unigrams) and
Dirichlet priors: p(w) = (c(w) - D) / N, or D V / N for an unknown word, and for a history h and the same without its
first word h': p(w | h) = (c(h w) + M p(w | h')) / (c(h) + M), with a prior M for each order. As an automaton: the states
are the histories seen in training; a state has an arc for every word seen after it, to the state of the longest
known ending of history and word, and a failure arc of weight M / (c(h) + M) to the state without the first word; the
empty state has an arc for every word. A text is read once from left to right: the state is carried, failure arcs
are followed until the next word has an arc, and the log-probabilities of all these arcs add up.

The priors are parameters of the model, the same for a corpus of any size; all else is counted over all training documents.

The automaton of a whole corpus fits no machine, so each block of about ``BLOCK_BYTES`` of text gets the part
that its texts can reach: blocks send the 64-bit hashes of their distinct n-grams, sorted and coded by their gaps,
with training counts to hash shards; a shard sums the counts over all blocks and answers each block with the
totals of the n-grams that others hold too. Words and bigrams are asked first; of longer n-grams only those need
asking whose beginning and ending were trained on and are both held by other blocks too. An n-gram goes at most once per block and shard each way, so
a very common word is as many entries as there are blocks. All counts are over all training documents, none is
cut off.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, input_bytes, text_slices

FOLDS, HELD_OUT = 7, 2
ORDER = 3
PRIORS = (100.0, 2.0)  # strength of orders 2 and 3; longer ones have the last
BLOCK_BYTES = 6 << 20
SHARD_BLOCKS = 4  # blocks' worth of n-grams in a shard
END = b"\n"  # no word is like it

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def longer(begin: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their beginnings and last words."""
    return mixed(begin * _A + word * _C + _B)


def packed_counts(x: np.ndarray) -> bytes:
    """A byte for each count; those of 255 or more follow as longs."""
    return np.minimum(x, 255).astype("u1").tobytes() + x[x >= 255].astype("<i8").tobytes()


def unpacked_counts(b: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(b, "u1", n).astype(np.int64)
    out[out == 255] = np.frombuffer(b, "<i8", offset=n)
    return out


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys without loss: the low 5 bytes of each, then the gaps of the high parts as counts."""
    low = keys.astype("<u8").view("u1").reshape(-1, 8)[:, :5].tobytes()
    return low + packed_counts(np.diff((keys >> np.uint64(40)).astype(np.int64), prepend=0))


def unpacked_keys(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), "u1")
    out[:, :5] = np.frombuffer(b, "u1", 5 * n).reshape(-1, 5)
    return out.view("<u8").ravel() | np.cumsum(unpacked_counts(b[5 * n :], n)).astype(np.uint64) << np.uint64(40)


def packed_answers(total: np.ndarray, shared: np.ndarray) -> bytes:
    """A bit for each n-gram that other blocks hold too, then the totals of those."""
    return np.packbits(shared).tobytes() + packed_counts(total[shared])


def unpacked_answers(b: bytes, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals, which are a block's own where it alone holds the n-gram, and which other blocks hold."""
    n = -(-len(own) // 8)
    shared = np.unpackbits(np.frombuffer(b, "u1", n))[: len(own)].astype(bool)
    out = own.copy()
    out[shared] = unpacked_counts(b[n:], int(shared.sum()))
    return out, shared


def words_of(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, A-Z lower-cased, and how many each text has."""
    raw = pa.array([t or b"" for t in texts], pa.large_binary()).view(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(raw))
    words = lists.flatten().view(pa.large_binary())
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white space at an end splits off an empty piece
    upto = np.append(0, np.cumsum(full))
    return words.filter(pa.array(full)), np.diff(upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()])


class Grams:
    """The distinct n-grams of one order in a block: ``begin`` and ``end`` are numbers one order lower, ``word`` the last word's."""

    def __init__(self, begin: np.ndarray, end: np.ndarray, word: np.ndarray, counts: np.ndarray, keys: np.ndarray):
        self.begin, self.end, self.word, self.own, self.keys = begin, end, word, counts, keys
        self.counts, self.shared = counts.copy(), np.zeros(len(counts), bool)


class Block:
    """The n-grams of some texts up to ``order``; word number 0 is the text end. Counts are of training texts."""

    def __init__(self, texts: list[bytes | None], train: np.ndarray, order: int):
        words, sizes = words_of(texts)
        coded = words.dictionary_encode()
        self.n_words = len(coded.dictionary) + 1
        self.sizes = sizes + 1
        self.tokens = np.zeros(len(words) + len(texts), np.int64)
        at = np.ones(len(self.tokens), bool)
        at[np.cumsum(self.sizes) - 1] = False
        self.tokens[at] = coded.indices.to_numpy() + 1
        self.first = np.cumsum(self.sizes) - self.sizes
        counted = np.repeat(train, self.sizes)
        n_tokens = len(self.tokens)
        place = np.arange(n_tokens) - np.repeat(self.first, self.sizes)  # in its text
        none = np.zeros(self.n_words, np.int64)
        words_ = word_hashes([END, *coded.dictionary.to_numpy(zero_copy_only=False)])
        self.grams = [Grams(none, none, np.arange(self.n_words), np.bincount(self.tokens[counted], minlength=self.n_words), words_)]
        at, numbers = np.arange(n_tokens), self.tokens
        self.places = [(at, numbers)]  # of each order: where its n-grams end, and their numbers
        for k in range(1, order):
            here = at[place[at] >= k]
            before = np.zeros(n_tokens, np.int64)
            before[at] = numbers
            codes = pa.array(before[here - 1] * self.n_words + self.tokens[here]).dictionary_encode()
            of = codes.indices.to_numpy()
            begin, word = np.divmod(codes.dictionary.to_numpy(), self.n_words)
            end = np.zeros(len(begin), np.int64)
            end[of] = before[here]
            self.grams.append(Grams(begin, end, word, np.bincount(of[counted[here]], minlength=len(begin)), longer(self.grams[-1].keys[begin], words_[word])))
            at, numbers = here, of
            self.places.append((at, numbers))

    def asked(self, k: int) -> np.ndarray:
        """Numbers of the n-grams of order k + 1 whose counts are not known from shorter ones, in the order of their keys."""
        g = self.grams[k]
        some = np.arange(len(g.keys))
        if k > 1:
            able = self.grams[k - 1].shared & (self.grams[k - 1].counts > 0)
            some = np.flatnonzero(able[g.begin] & able[g.end])
        return some[np.argsort(g.keys[some])]

    def learn(self, k: int, shards: int, answers: dict[int, bytes]) -> None:
        g, order = self.grams[k], self.asked(k)
        edges = np.searchsorted(shard_of(g.keys[order], shards), np.arange(shards + 1))
        for shard, b in answers.items():
            own = order[edges[shard] : edges[shard + 1]]
            g.counts[own], g.shared[own] = unpacked_answers(b, g.own[own])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Automaton:
    """The part of the model that one block reaches: state 0 is empty, then the histories of each order in turn.

    ``fail`` and ``up``: weight and target of each state's failure arc. ``weights`` and ``targets``: of the other arcs, by
    order: the arc of a history on the next word is the n-gram of both, so it is known by its number; untrained ones
    (nan) are no arcs. The empty state has an arc for every word; an unknown word leads back to it.
    """

    def __init__(self, block: Block, tokens: int, types: int, discount: float, priors: list[float]):
        self.block, n = block, block.n_words
        order = len(block.grams)
        first = np.cumsum([1, *(len(g.keys) for g in block.grams)])  # the states of each order begin here
        c = block.grams[0].counts.astype(float)
        p = np.where(c > 0, c - discount, discount * types) / tokens if tokens else np.ones(n)
        self.weights, self.targets = [np.log10(p)], [np.where(c > 0, first[0] + np.arange(n), 0)]
        fail, up = [np.zeros(1)], [np.zeros(1, np.int64)]
        history = np.where(np.arange(n) == 0, 0.0, c)  # nothing follows an end
        for k in range(1, order):
            g, prior = block.grams[k], priors[k - 1]
            fail.append(np.log10(prior / (history + prior)))
            up.append(first[k - 2] + block.grams[k - 1].end if k > 1 else np.zeros(n, np.int64))
            c = g.counts.astype(float)
            p = (c + prior * p[g.end]) / (history[g.begin] + prior)
            self.weights.append(np.where(c > 0, np.log10(p), np.nan))
            self.targets.append(first[k] + np.arange(len(c)) if k < order - 1 else first[k - 1] + g.end)
            history = np.where(g.word == 0, 0.0, c)
        self.fail, self.up = np.concatenate(fail), np.concatenate(up)

    def read(self) -> np.ndarray:
        """Log10 probability of each text, read from left to right.

        The state before a token is the longest ending with a state of what the text has so far. As the ending of a trained
        n-gram is trained too, its length is the number of orders that are trained at the token before, so the states of all
        tokens are found at once: each token adds the failure arcs from its state down to the first one that has the arc.
        """
        block, n, most = self.block, len(self.block.tokens), len(self.weights) - 1
        fails = np.split(self.fail, np.cumsum([1, *(len(g.keys) for g in block.grams[: most - 1])]))
        known, total = np.zeros(n, np.int64), np.zeros(n)  # orders trained at a token; its log-probability
        for k, ((at, number), w) in enumerate(zip(block.places, self.weights, strict=True)):
            weight = w[number]
            arc = ~np.isnan(weight)
            total[at[arc]] = weight[arc]  # that of the longest history wins
            if k:
                known[at[arc]] = k + 1
            else:
                known[at] = self.targets[0][number] > 0
        length = np.append(0, np.minimum(known, most)[:-1])  # of the state before a token
        length[block.first] = 0
        for k in range(1, most + 1):  # histories of k words that are left by a failure arc
            at, number = block.places[k - 1]
            number_of = np.zeros(n, np.int64)
            number_of[at] = number
            left = np.flatnonzero((length >= k) & (known <= k))
            total[left] += fails[k][number_of[left - 1]]
        return np.add.reduceat(total, block.first)


def packed_texts(rows: DataFrame, blocks: int) -> DataFrame:
    """block, ids, train, texts: rows (id, text, train) dealt to blocks by content; those of one slice and block are one zstandard frame.

    Dealt by content, a task run again deals alike.
    """
    kind = rows.schema["id"].dataType

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor()
        for batch in text_slices(batches, "text", 32 << 20):
            block = batch["block"].to_numpy()
            order = np.argsort(block, kind="stable")
            texts = binary(batch["text"])
            cuts = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)]
            frames = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = [texts[i] or b"" for i in order[a:b].tolist()]
                frames.append(zip_.compress(np.fromiter(map(len, own), "<i8", len(own)).tobytes() + b"".join(own)))
            at, edges = pa.array(order), pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(edges, batch[c].take(at)) for c in ("id", "train")]
            yield pa.RecordBatch.from_arrays([pa.array(block[order][cuts[:-1]]), *lists, pa.array(frames, pa.binary())], names=["block", "ids", "train", "texts"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("long"))
    return dealt.mapInArrow(pack, T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("train", T.ArrayType(T.BooleanType())), T.StructField("texts", T.BinaryType())]))


def unpacked_texts(rows: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """The texts of a block and which of them train."""
    texts: list[bytes] = []
    for n, frame in zip(rows["ids"].combine_chunks().value_lengths().to_pylist(), rows["texts"].to_pylist(), strict=True):
        raw = zstandard.decompress(frame)
        ends = np.cumsum(np.frombuffer(raw, "<i8", n)) + 8 * n
        texts += [raw[a:b] for a, b in zip([8 * n, *ends.tolist()], ends.tolist(), strict=False)]
    return texts, rows["train"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(bool)


def training_totals(docs: DataFrame, text: str, train: str, shards: int = 1) -> tuple[int, int, float]:
    """Tokens, types and absolute discount n1 / (n1 + 2 n2) of all training texts, from exact counts of all their words."""

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = np.fromiter(counts.keys(), np.uint64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
            by = np.argsort(keys)
            keys, n = keys[by], n[by]
            edges = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
            full = np.flatnonzero(np.diff(edges)).tolist()
            cut = [slice(edges[s], edges[s + 1]) for s in full]
            columns = [pa.array(full, pa.int64()), pa.array([x.stop - x.start for x in cut], pa.int64()), pa.array([packed_keys(keys[x]) for x in cut], pa.binary()), pa.array([packed_counts(n[x]) for x in cut], pa.binary())]
            counts.clear()
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "n", "keys", "counts"])

        for batch in text_slices(batches, text):
            words = Block(binary(batch[text]), np.ones(batch.num_rows, bool), 1).grams[0]
            counts.update(dict(zip(words.keys.tolist(), words.own.tolist(), strict=True)))
            if len(counts) > 1_000_000:
                yield from flush()
        yield from flush()

    def summed(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked_keys(b, n) for b, n in zip(rows["keys"].to_pylist(), rows["n"].to_pylist(), strict=True)])
        counts = np.concatenate([unpacked_counts(b, n) for b, n in zip(rows["counts"].to_pylist(), rows["n"].to_pylist(), strict=True)])
        _, at = np.unique(keys, return_inverse=True)
        totals = np.bincount(at, counts).astype(np.int64)
        return pa.table({name: pa.array([v], pa.int64()) for name, v in (("tokens", int(totals.sum())), ("types", len(totals)), ("once", int((totals == 1).sum())), ("twice", int((totals == 2).sum())))})

    sent = docs.where(train).select(text).mapInArrow(local, "shard long, n long, keys binary, counts binary")
    names = ("tokens", "types", "once", "twice")
    sums = sent.repartition(shards, "shard").groupBy("shard").applyInArrow(summed, ", ".join(f"{c} long" for c in names))
    tokens, types, once, twice = (v or 0 for v in sums.agg(*(F.sum(c) for c in names)).first())
    return tokens, types, once / (once + 2 * twice) if 0 < once and twice else 0.5


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, order: int = ORDER, block_bytes: int = BLOCK_BYTES, priors: Sequence[float] = PRIORS) -> DataFrame:
    """For every row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Rows whose crc32(id as text) mod ``folds`` is ``held_out`` do not train; rows without an id do.
    Null texts are empty: one end token. Repeated rows train and are scored one by one. Without any
    training text every score is zero. Very long texts are read whole; an empty table gives an empty
    result; other columns are ignored. ``order`` is the length of the longest n-grams, at least 2.
    """
    priors = [*priors, *[priors[-1]] * order][: order - 1]
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_out, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), (~held).alias("train"))
    blocks = max(1, -(-input_bytes(docs, text) // block_bytes))
    shards = -(-blocks // SHARD_BLOCKS)
    tokens, types, discount = training_totals(rows, "text", "train", shards)
    dealt = packed_texts(rows, blocks).repartition(blocks, "block")

    def block_of(rows_: pa.Table, answers: pa.Table | None, rounds: int) -> Block:
        block = Block(*unpacked_texts(rows_), rounds)
        known: dict[int, dict[int, bytes]] = {}
        if answers is not None:
            for k, shard, b in zip(*(answers[c].to_pylist() for c in ("k", "shard", "totals")), strict=True):
                known.setdefault(k, {})[shard] = b
        for k in sorted(known):  # the shorter ones say which longer ones were asked for
            block.learn(k, shards, known[k])
        return block

    def question(block: Block, number: int, orders: Iterable[int]) -> pa.Table:
        out: list[tuple[int, int, int, bytes, bytes]] = []
        for k in orders:
            g, asked = block.grams[k], block.asked(k)
            edges = np.searchsorted(shard_of(g.keys[asked], shards), np.arange(shards + 1))
            for shard in np.flatnonzero(np.diff(edges)).tolist():
                own = asked[edges[shard] : edges[shard + 1]]
                out.append((k, shard, len(own), packed_keys(g.keys[own]), packed_counts(g.own[own])))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.array([number] * len(out), pa.int64())], names=["k", "shard", "n", "keys", "counts", "block"])

    def ask(rows_: pa.Table) -> pa.Table:
        return question(block_of(rows_, None, 2), rows_["block"][0].as_py(), (0, 1))

    def ask_longer(k: int):
        return lambda rows_, answers: question(block_of(rows_, answers, k + 1), rows_["block"][0].as_py(), (k,))

    def answer(rows_: pa.Table) -> pa.Table:
        keys = [unpacked_keys(b, n) for b, n in zip(rows_["keys"].to_pylist(), rows_["n"].to_pylist(), strict=True)]
        counts = [unpacked_counts(b, len(k)) for b, k in zip(rows_["counts"].to_pylist(), keys, strict=True)]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        edges = np.cumsum([len(k) for k in keys])[:-1]
        parts = np.split(np.bincount(at, np.concatenate(counts)).astype(np.int64)[at], edges)
        shared = np.split(np.bincount(at)[at] > 1, edges)
        return pa.table([rows_["block"], rows_["k"], rows_["shard"], pa.array([packed_answers(t, c) for t, c in zip(parts, shared, strict=True)], pa.binary())], names=["block", "k", "shard", "totals"])

    def read(rows_: pa.Table, answers: pa.Table) -> pa.Table:
        block = block_of(rows_, answers, order)
        c = block.grams[0].counts[block.tokens]
        base = np.add.reduceat(np.log10((c + 1) / (tokens + types + 1)), block.first)
        known = np.add.reduceat((c > 0).astype(np.int64), block.first)
        ids, held_ = rows_["ids"].combine_chunks().flatten(), ~unpacked_texts(rows_)[1]
        scores = Automaton(block, tokens, types, discount, priors).read()
        return pa.table([ids, pa.array(held_), pa.array(block.sizes), pa.array(known), pa.array([tokens] * len(held_), pa.int64()), pa.array(base), pa.array(scores)], names=names)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    asks, answers_ = "k int, shard long, n long, keys binary, counts binary, block long", "block long, k int, shard long, totals binary"
    by_shard = lambda asked: asked.repartition(shards, "shard").groupBy("shard", "k").applyInArrow(answer, answers_).repartition(blocks, "block")
    answered = by_shard(dealt.groupBy("block").applyInArrow(ask, asks))
    for k in range(2, order):
        answered = answered.unionByName(by_shard(dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(ask_longer(k), asks)))
    kinds = [T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *(T.StructField(c, k) for c, k in zip(names[1:], kinds, strict=True))])
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(read, schema)
