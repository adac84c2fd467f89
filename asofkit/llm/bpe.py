"""Byte-level BPE encoding and decoding in two tiers.

Tier 1 resolves a whole pre-token that is in the vocabulary through a minimal
perfect hash (one slot per vocabulary entry, the entry's bytes confirm a hit).
Tier 2 merges the bytes of the others: a linked list of parts and a heap of
(rank, place) pairs; stale heap entries are skipped.

Cases: a null or empty text has no ids; a very long text or pre-token is merged
in O(n log n); repeated rows give repeated rows; an empty table gives an empty
result; other columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import mix

#: Results kept per Python worker for words seen before; emptied when full.
MEMO = 300_000
#: Longer words are not kept.
MEMO_CHARS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a rank file: one base64 token and its id per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


class PerfectHash:
    """Minimal perfect hash by bucket displacement: n keys, n slots."""

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        h = self.hashes(keys)
        if len(np.unique(h)) != n:
            raise ValueError("two keys share a 64-bit hash")
        b = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        counts = np.bincount(b, minlength=self.buckets)
        starts = np.concatenate([[0], np.cumsum(counts)])
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_key = np.full(n, -1, np.int64)
        for k in np.argsort(-counts, kind="stable"):
            own = order[starts[k] : starts[k + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:  # the rest go straight to what is free
                continue
            first = 1
            while True:  # shifts are tried 64 at a time
                d = np.arange(first, first + 64)
                s = self._slots(h[own][:, None], d[None, :])
                ordered = np.sort(s, axis=0)
                fits = (self.slot_key[s] < 0).all(axis=0) & (ordered[1:] != ordered[:-1]).all(axis=0)
                if fits.any():
                    break
                first += 64
            at = int(np.argmax(fits))
            self.shift[k] = d[at]
            self.slot_key[s[:, at]] = own
        free = iter(np.flatnonzero(self.slot_key < 0).tolist())
        for k in np.flatnonzero(counts == 1):
            s = next(free)
            self.shift[k] = -s - 1
            self.slot_key[s] = order[starts[k]]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(h + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """A slot for every key; keys outside the set get some slot, too."""
        h = self.hashes(keys)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -d - 1, self._slots(h, d))


def merge_bytes(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest rank merges first, the leftmost among equals."""
    n = len(token)
    end = list(range(1, n + 1))  # end of the part that begins at i; 0: merged away
    before = list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if j == 0 or j >= n or end[j] != e:  # one of the two has changed since
            continue
        end[i], end[j] = e, 0
        if e < n:
            before[e] = i
            f = end[e]
            if (r := get(token[i:f])) is not None:
                heapq.heappush(heap, (r, i, f))
        p = before[i]
        if p >= 0 and (r := get(token[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = end[i]
    return out


class Words(dict):
    """Word after a space -> its ids as little-endian 32-bit; None if its ends are white space.

    A single space between two other characters always begins a pre-token, so
    words can be encoded apart and their ids joined.
    """

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes | None:
        out = None if not word or word[0].isspace() or word[-1].isspace() else self.encode(" " + word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = out
        return out

    def text(self, text: str) -> bytes:
        words = text.split(" ")
        first = words[0]
        if not first or first[-1].isspace():
            return self.encode(text) if text else b""
        try:
            return self.encode(first) + b"".join(map(self.__getitem__, words[1:]))
        except TypeError:
            return self.encode(text)


class Encoder:
    """Two-tier encoder and decoder for one rank table and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.slot_bytes = [keys[k] for k in self.hash.slot_key]
        self.slot_id = np.array([ranks[b] for b in self.slot_bytes], np.uint32)
        top = max(ranks.values(), default=-1) + 1
        self.by_id = [b""] * top
        for b, i in ranks.items():
            self.by_id[i] = b
        self.words = Words(self.encode_pretokens)
        self.merged: dict[bytes, bytes] = {}

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern.pattern, "hash": self.hash}

    def __setstate__(self, s) -> None:
        self.ranks, self.hash, self.pattern = s["ranks"], s["hash"], regex.compile(s["pattern"])
        keys = list(self.ranks)
        self.slot_bytes = [keys[k] for k in self.hash.slot_key]
        self.slot_id = np.array([self.ranks[b] for b in self.slot_bytes], np.uint32)
        self.by_id = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for b, i in self.ranks.items():
            self.by_id[i] = b
        self.words, self.merged = Words(self.encode_pretokens), {}

    def encode_pretokens(self, text: str) -> bytes:
        tokens = [t.encode() for t in self.pattern.findall(text)]
        slots = self.hash.slots(tokens).tolist() if len(tokens) > 8 else [self._slot(t) for t in tokens]
        held = self.slot_bytes
        return b"".join([self._id_bytes(s) if held[s] == t else self._merge(t) for s, t in zip(slots, tokens, strict=True)])

    def _slot(self, token: bytes) -> int:
        """``PerfectHash.slots`` for one token in plain integers."""
        h = xxhash.xxh3_64_intdigest(token)
        d = int(self.hash.shift[h % self.hash.buckets])
        if d < 0:
            return -d - 1
        m = 0xFFFFFFFFFFFFFFFF
        x = (h + d * 0x9E3779B97F4A7C15) & m
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
        return (x ^ (x >> 31)) % self.hash.n

    def _id_bytes(self, slot: int) -> bytes:
        return int(self.slot_id[slot]).to_bytes(4, "little")

    def _merge(self, token: bytes) -> bytes:
        out = self.merged.get(token)
        if out is None:
            out = np.array(merge_bytes(token, self.ranks), "<u4").tobytes()
            if len(token) <= MEMO_CHARS:
                if len(self.merged) >= MEMO:
                    self.merged.clear()
                self.merged[token] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.words.text(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.asarray(ids).tolist()))


def encode_column(df: DataFrame, ranks_path: str, pattern: str, keep: list[str], text: str = "text", ids: bool = False) -> DataFrame:
    """``keep`` and, per text: n_tokens, ids_sha256, decoded_sha256 (of the decoded bytes), with ``ids`` the ids too.

    The vocabulary is read on the driver and broadcast; its size is that of the
    rank file, whatever the data.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Encoder(read_ranks(ranks_path), pattern))
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    extra = ", n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value
        for b in batches:
            n, hashes, back, lists = [], [], [], []
            for t in b.column("__text"):
                raw = enc.words.text(t.as_py() or "")
                codes = np.frombuffer(raw, "<u4")
                n.append(len(codes))
                hashes.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(enc.decode(codes)).hexdigest())
                if ids:
                    lists.append(codes.astype(np.int32))
            cols = [b.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols, names = [*cols, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return source.mapInArrow(run, schema)
