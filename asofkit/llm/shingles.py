"""Words and word shingles of whole text columns as 64-bit hashes, computed on the bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from asofkit.llm.common import blocks, mix

_RNG = np.random.default_rng(20240229)
#: A random value per byte, an odd multiplier and its inverse modulo 2**64.
BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
P = np.uint64(int(_RNG.integers(0, 1 << 63)) * 2 + 1)
P_INV = np.uint64(pow(int(P), -1, 1 << 64))
STEP = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; kept for the usual block size."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(n, base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if n <= 1 << 23:
            _powers[int(base)] = held
    return held[:n]


def prefix(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of BYTE[b] * P**i: any substring's hash is a difference times P**-start."""
    c = np.zeros(len(raw) + 1, np.uint64)
    if len(raw):
        np.cumsum(BYTE[raw] * powers(P, len(raw)), out=c[1:])
    return c


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash per word, words per row) of the rows of a block."""
    if lower:
        raw = LOWER[raw]
    solid = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(raw), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    c = prefix(raw)
    h = mix((c[ends] - c[starts]) * powers(P_INV, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))
    return h, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per row: the sorted distinct hashes of its k-word shingles (fewer words: one for all of them; none: empty)."""
    for a, b in blocks(offsets):
        base = offsets[a]
        h, counts = word_hashes(raw[base : offsets[b]], offsets[a : b + 1] - base, lower=True)
        w = np.zeros(max(len(h) - k + 1, 0), np.uint64)
        for i in range(k):
            w += h[i : i + len(w)] * STEP[i]
        w = mix(w)
        at = 0
        for n in counts.tolist():
            if n >= k:
                yield np.unique(w[at : at + n - k + 1])
            elif n:
                yield mix((h[at : at + n] * STEP[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
            at += n
