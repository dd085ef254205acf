"""Byte-level BPE encoding of whole corpora in numpy.

Texts are split into pre-tokens by vectorised character classes, those of a chunk are made distinct by a
64-bit hash whose groups are compared sign by sign, every distinct one is looked up by its signs, and the unknown ones are merged together in length-bucketed, padded
matrices: each round every row merges its lowest-ranked pair (leftmost first, all places of that
pair at once, which gives the same ids as one place at a time), pairs are looked up in an
open-addressing hash table, and rows are compacted after each round.

Defined cases: a null or empty text gives an empty list. Text that looks like a special token is
plain text. Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.llm.rolling import U, mix
from grainfold.plans.runtime import spread

#: Folder of the vocabulary files.
TOKENIZERS = os.environ.get("GRAINFOLD_TOKENIZERS", "/opt/tokenizers")

# Fixed values of the public split pattern: the white-space code points and the contractions.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

OTHER, LETTER, NUMBER, SPACE, END = range(5)
SENTINEL = 0x110000
CHUNK = 1 << 17
CACHE_LIMIT = 1 << 20
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))


def character_classes() -> np.ndarray:
    """Class of every code point, and of the sentinel that ends a text."""
    classes = np.zeros(SENTINEL + 1, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, SENTINEL)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m.group()[0]), ord(m.group()[-1])
            classes[a : b + 1] = kind
    classes[0xD800:0xE000] = OTHER
    classes[SPACES] = SPACE
    classes[SENTINEL] = END
    return classes


class PairTable:
    """Open-addressing hash table from a pair of ids to (rank, merged id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = int(np.ceil(np.log2(max(2, 4 * len(left)))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, np.iinfo(np.int32).max, np.int32)
        self.merged = np.full(1 << self.bits, -1, np.int32)
        keys, todo = (left.astype(np.int64) << 32) | right, np.arange(len(left))
        slot = self.slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] == -1
            first = todo[free][np.unique(slot[todo[free]], return_index=True)[1]]
            self.keys[slot[first]] = keys[first]
            self.rank[slot[first]] = first
            self.merged[slot[first]] = merged[first]
            todo = np.setdiff1d(todo, first, assume_unique=True)
            taken = todo[self.keys[slot[todo]] != -1]
            slot[taken] = (slot[taken] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(U)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self.slot(keys)
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            at = self.keys[slot[open_]]
            hit = at == keys[open_]
            found[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (at != -1)]
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
        return found


class Encoder:
    """Encoder of one vocabulary; one per Python worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        # Byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.byte_ids = np.array([vocab[sign[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int32) for k in (0, 1))
        # What each id stands for, in bytes.
        byte_of = {c: b for b, c in sign.items()}
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.pairs = PairTable(left, right, np.array([vocab["".join(p)] for p in pairs], np.int32))
        self.classes = character_classes()
        self.scrambled = mix(np.arange(1, SENTINEL + 2, dtype=U))
        self.powers = self.inverses = np.ones(1, U)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token, by rounds over padded matrices of similar lengths."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        for b in np.unique(bucket):
            every = np.flatnonzero(bucket == b)
            step = max(1, (1 << 20) >> int(b))
            for k in range(0, len(every), step):
                rows = every[k : k + step]
                width = int(lengths[rows].max())
                ids = np.full((len(rows), width), -1, np.int32)
                ids[np.arange(width) < lengths[rows, None]] = self.byte_ids[np.frombuffer(b"".join(pieces[r] for r in rows), np.uint8)]
                self.rounds(ids, rows, out)
        return out

    def rounds(self, ids: np.ndarray, rows: np.ndarray, out: list[np.ndarray]) -> None:
        top = np.iinfo(np.int32).max
        while len(rows):
            left, right = ids[:, :-1], ids[:, 1:]
            real = right >= 0
            slot = np.full(left.shape, -1, np.int64)
            slot[real] = self.pairs.find(left[real], right[real])
            rank = np.where(slot >= 0, self.pairs.rank[slot], top)
            best = rank.min(axis=1, initial=top)
            done = best == top
            for k in np.flatnonzero(done):
                out[rows[k]] = ids[k][ids[k] >= 0]
            go = ~done
            if not go.any():
                return
            ids, rows, rank, slot, best = ids[go], rows[go], rank[go], slot[go], best[go]
            place = np.arange(rank.shape[1])
            at = rank == best[:, None]
            before = np.maximum.accumulate(np.where(at, -1, place), axis=1)
            at &= (place - before) % 2 == 1  # of overlapping places every second one, from the left
            merged = ids.copy()
            merged[:, :-1][at] = self.pairs.merged[slot[at]]
            keep = ids >= 0
            keep[:, 1:] &= ~at
            length = keep.sum(axis=1)
            ids = np.full((len(rows), int(length.max())), -1, np.int32)
            ids[np.arange(ids.shape[1]) < length[:, None]] = merged[keep]

    def bounds(self, cp: np.ndarray) -> np.ndarray:
        """True where a pre-token starts; each text in ``cp`` is followed by the sentinel."""
        kind = self.classes[cp]
        before = np.empty_like(kind)
        before[0], before[1:] = END, kind[:-1]
        after = np.empty_like(kind)
        after[-1], after[:-1] = END, kind[1:]
        start = kind != before
        # The last white space before other text starts a token of its own: alone, or joined to that text if it is a blank.
        last = (kind == SPACE) & (after != SPACE) & (after != END)
        start |= last
        blank = np.flatnonzero(last & (cp == 32))
        start[blank + 1] = False
        # Contractions: an apostrophe that starts a token and has the right letters behind it.
        quote = np.flatnonzero((cp == 39) & start & (after == LETTER))
        if len(quote):
            one, two = cp[quote + 1], cp[np.minimum(quote + 2, len(cp) - 1)]
            size = np.zeros(len(quote), np.int64)
            for c in CONTRACTIONS:
                hit = (one == ord(c[1])) & ((two == ord(c[2])) if len(c) == 3 else True)
                size[hit & (size == 0)] = len(c)
            q, n = quote[size > 0], size[size > 0]
            start[q + 1] = False
            start[q + n] = True
        return start

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts: hash the pre-tokens chunk by chunk, merge the new ones together, then gather."""
        if len(self.known) > CACHE_LIMIT:
            self.forget()
        hashed, chunk, n, new, pieces = [], [], 0, {}, []
        for k, t in enumerate(texts):
            chunk.append(t or "")
            n += len(chunk[-1]) + 1
            if n >= CHUNK or k == len(texts) - 1:
                hashed.append(self.hash_chunk(chunk, new, pieces))
                chunk, n = [], 0
        if pieces:
            ids = self.merge(pieces)
            size = np.array([len(i) for i in ids], np.int64)
            at = len(self.flat) + np.cumsum(size) - size
            self.known.update({h: len(self.first) + k for k, h in enumerate(new)})
            self.flat = np.concatenate([self.flat, *ids])
            self.first, self.size = np.concatenate([self.first, at]), np.concatenate([self.size, size])
        sizes, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for distinct, place, text_of, texts_here in hashed:
            entry = np.array([self.known[h] for h in distinct], np.int64)[place]
            size, first = self.size[entry], self.first[entry]
            end = np.cumsum(size)
            values.append(self.flat[np.repeat(first - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)])
            sizes.append(np.bincount(text_of, weights=size, minlength=texts_here).astype(np.int64))
        return np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(values)

    def hash_chunk(self, chunk: list[str], new: dict[bytes, None], pieces: list[bytes]) -> tuple:
        """Distinct pre-tokens, the place of each pre-token among them and its text; unknown ones go to new and pieces."""
        lengths = np.array([len(t) for t in chunk], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1
        cp = np.full(n, SENTINEL, np.uint32)
        inside = np.ones(n, bool)
        inside[ends] = False
        cp[inside] = np.frombuffer("".join(chunk).encode("utf-32-le"), np.uint32)
        start = np.flatnonzero(self.bounds(cp))
        text_of = np.searchsorted(ends, start)
        real = cp[start] != SENTINEL
        stop = np.append(start[1:], n)[real]
        start, text_of = start[real], text_of[real]
        if len(self.powers) <= n:
            self.powers = np.concatenate([np.ones(1, U), np.cumprod(np.full(2 * n, BASE))])
            self.inverses = np.concatenate([np.ones(1, U), np.cumprod(np.full(2 * n, INVERSE))])
        sums = np.zeros(n + 1, U)
        np.cumsum(self.scrambled[cp] * self.powers[:n], out=sums[1:])
        key = mix((sums[stop] - sums[start]) * self.inverses[start] + (stop - start).astype(U))
        _, example, place = np.unique(key, return_index=True, return_inverse=True)
        if not self.same(cp, start, stop, example[place]):
            # Two pre-tokens have one hash: tell them apart by their signs.
            seen: dict[bytes, int] = {}
            place = np.array([seen.setdefault(cp[a:b].tobytes(), len(seen)) for a, b in zip(start, stop)], np.int64)
            example = np.unique(place, return_index=True)[1]
        distinct = [cp[a:b].tobytes() for a, b in zip(start[example].tolist(), stop[example].tolist())]
        for h in distinct:
            if h not in self.known and h not in new:
                new[h] = None
                pieces.append(h.decode("utf-32-le").encode())
        return distinct, place.astype(np.int32), text_of, len(chunk)

    @staticmethod
    def same(cp: np.ndarray, start: np.ndarray, stop: np.ndarray, like: np.ndarray) -> bool:
        """Whether every pre-token has the signs of the one it is taken for."""
        size = stop - start
        if (size != size[like]).any():
            return False
        end = np.cumsum(size)
        offset = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - size, size)
        return bool((cp[np.repeat(start, size) + offset] == cp[np.repeat(start[like], size) + offset]).all())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, name + ".json")


def encode_documents(df: DataFrame, key: str, text: str | Column, tokenizer: str = "byte_bpe_50k", folder: str | None = None, only_count: bool = False) -> DataFrame:
    """(key, ids array<int>) of every row, or (key, n_tokens) with ``only_count``.

    Repeated rows come out once each; columns other than ``key`` and ``text`` are not read.
    """
    path = vocabulary(tokenizer, folder)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            offsets, ids = e.encode(batch.column(1).to_pylist())
            if only_count:
                out = pa.array(np.diff(offsets), pa.int64())
            else:
                out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=[key, "n_tokens" if only_count else "ids"])

    source = df.select(F.col(key), (F.col(text) if isinstance(text, str) else text).alias("_text"))
    return spread(source).mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens bigint" if only_count else "ids array<int>"))


def decode_documents(df: DataFrame, key: str, ids: str, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, text) of every row of ids; a null list gives a null text, an empty one an empty text."""
    path = vocabulary(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = encoder(path).bytes_of
        for batch in batches:
            texts = [None if x is None else b"".join([bytes_of[i] for i in x]).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
