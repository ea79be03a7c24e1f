"""Token ids of whole texts from a public tokenizer file, through a cache of white-space chunks.

A tokenizer that drops white space gives a text the ids of its chunks, one after the other, so each
distinct chunk is encoded once and a text is a gather from the cache. Whether a tokenizer does so is
probed; for any other, whole texts are encoded. The cache holds a bounded number of chunks.

Chunks are made fewer first: A-Z is lower-cased where the tokenizer does that anyway, and a comma or
full stop after a letter becomes a chunk of its own. New chunks are encoded many at a time: those of
lower-case letters by the model alone, told apart by its word ends, the others parted by a special token,
which no ordinary text can merge with.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import WHITE

CACHED = 600_000
#: chunks longer than this are not remembered.
CHUNK = 256
#: UTF-8 of lower-case ASCII letters and of the lower-case letters from U+00DF to U+00FF.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_WORDS = ("a", "the", "straße", "élève", "ÿ", "xqzwv", "internationalization", "þæöø", "l" * 70)
_PROBES = ("a b", "it's  2024!\n\tÉté", "x\x0b\x0cy\r\nz", " lead and trail ", "é ́ ok", "<|endoftext|> a")


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[44, 46]] = True


def _apart(text: bytes) -> bytes:
    """A space before each comma or full stop that stands between an ASCII letter and white space or the end."""
    b = np.frombuffer(text + b" ", np.uint8)
    at = np.flatnonzero(_MARK[b[1:-1]] & _LETTER[b[:-2]] & WHITE[b[2:]]) + 1
    return np.insert(b[:-1], at, 32).tobytes() if len(at) else text


def _kept_whole(text: bytes) -> bool:
    """Combining marks could compose with a lower-cased letter, and special tokens must stay as they are."""
    return b"\xcc" in text or b"\xcd" in text or b"<|" in text


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens", [])
        plain = not any(t["lstrip"] or t["rstrip"] or len(t["content"].split()) != 1 for t in added)
        self.by_chunk = plain and all(self._ids([p])[0] == [i for x in self._ids(p.split()) for i in x] for p in _PROBES)
        part = next((t for t in added if t["special"]), None)
        self.part, self.part_id = (part["content"], part["id"]) if part else (None, None)
        self.folds = self.by_chunk and all(self._ids([p])[0] == self._ids([q])[0] for p, q in (("AbC XYZ", "abc xyz"), ("KIß'S", "kiß's")))
        self.parts_marks = self.by_chunk and all(self._ids([p])[0] == self._ids([q])[0] for p, q in (("ab, c. d", "ab , c . d"), ("x,\ny.", "x ,\ny .")))
        self._plain_words(path)
        self._clear()

    def _plain_words(self, path: str) -> None:
        """A tokenizer for chunks of lower-case Latin letters only, which need no normalising and no splitting.

        Ids that end a word are known by the model's word-end suffix. None if the model has none or if its
        ids differ on the probes.
        """
        self.words = None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model.get("end_of_word_suffix")
        if not (self.by_chunk and suffix):
            return
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        words = Tokenizer.from_file(path)
        words.normalizer = normalizers.Sequence([])
        words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        same = [words.encode(w, add_special_tokens=False).ids for w in _WORDS] == self._ids(list(_WORDS))
        one_end = all(self.ends[x].tolist() == [False] * (len(x) - 1) + [True] for x in self._ids(list(_WORDS)))
        self.words = words if same and one_end else None

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.begins = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _make_room(self) -> None:
        """Keep the half of the cache that was used most."""
        stay = np.sort(np.argsort(self.uses)[len(self.uses) // 2 :])
        chunks = list(self.index)
        sizes = self.sizes[stay]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.repeat(self.begins[stay] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.begins, self.sizes, self.uses = ends - sizes, sizes, self.uses[stay] // 2
        self.index = {chunks[i]: k for k, i in enumerate(stay.tolist())}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fewer(self, text: bytes) -> bytes:
        """The text with letters folded and marks apart, where the tokenizer allows it."""
        text = text.lower() if self.folds else text
        return _apart(text) if self.parts_marks else text

    def chunks(self, texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
        """The chunks of all texts and how many each text has."""
        texts = [t or b"" for t in texts]
        # decided text by text, so that a text has the same chunks whatever its neighbours are
        if _kept_whole(b"\n".join(texts)):
            texts = [t if _kept_whole(t) else self._fewer(t) for t in texts]
        else:
            texts = [self._fewer(t) for t in texts]
        split = [t.split() for t in texts]
        return [c for s in split for c in s], np.fromiter(map(len, split), np.int64, len(split))

    def _many(self, chunks: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Some distinct chunks in the order they were encoded, their ids one after the other, and their numbers."""
        plain = [c for c in chunks if _PLAIN.fullmatch(c)] if self.words is not None else []
        text = [c.decode() for c in plain]
        ids = [np.array(e.ids, np.uint32) for e in self.words.encode_batch_fast([" ".join(text[k : k + 200]) for k in range(0, len(text), 200)], add_special_tokens=False)] if plain else []
        sizes = [np.diff(np.flatnonzero(self.ends[np.concatenate(ids)]), prepend=-1)] if plain else []
        other = [c for c in chunks if not _PLAIN.fullmatch(c)] if self.words is not None else chunks
        text = [c.decode("utf-8", "replace") for c in other]
        if self.part is None or any(self.part in t for t in text):
            found = self._ids(text)
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter((x for y in found for x in y), np.uint32, int(sizes[-1].sum())))
        else:
            parted = np.concatenate([np.zeros(0, np.uint32), *(np.array(g, np.uint32) for g in self._ids([f" {self.part} ".join([*text[k : k + 100], ""]) for k in range(0, len(text), 100)]))])
            sizes.append(np.diff(np.flatnonzero(parted == self.part_id), prepend=-1) - 1)
            ids.append(parted[parted != self.part_id])
        return plain + other, np.concatenate(ids), np.concatenate(sizes)

    def counts(self, chunks: list[bytes]) -> np.ndarray:
        """Number of ids of each of some distinct chunks."""
        order, _, sizes = self._many(chunks)
        found = dict(zip(order, sizes.tolist(), strict=True))
        return np.fromiter(map(found.__getitem__, chunks), np.int64, len(chunks))

    def _learn(self, chunks: list[bytes]) -> None:
        order, flat, sizes = self._many(chunks)
        self.begins = np.concatenate((self.begins, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.uses = np.concatenate((self.uses, np.zeros(len(sizes), np.int64)))
        self.flat = np.concatenate((self.flat, flat))
        self.index.update(zip(order, range(len(self.index), len(self.index) + len(order)), strict=True))

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, as uint32, and the number of ids of each text. Null is empty."""
        if not self.by_chunk:
            ids = self._ids([(t or b"").decode("utf-8", "replace") for t in texts])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((x for y in ids for x in y), np.uint32, int(sizes.sum())), sizes
        chunks, n_chunks = self.chunks(texts)
        new = set(chunks) - self.index.keys()
        if len(self.index) + len(new) > CACHED:
            self._make_room()
            new = set(chunks) - self.index.keys()
        self._learn(list(new))
        at = np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))
        self.uses += np.bincount(at, minlength=len(self.uses))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.begins[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate(([0], ends))[np.cumsum(n_chunks)]
        if max(map(len, new), default=0) > CHUNK:  # rare: not worth remembering
            self._clear()
        return ids, np.diff(upto, prepend=0)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
