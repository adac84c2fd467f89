"""Masked pseudo-likelihood of documents by a bidirectional window network.

Words and runs of signs are counted over all documents. Each that occurs often
enough (``least_count``, which grows slower than the corpus, so the vocabulary
grows with it) has an id of its own by falling count; the others share the id 0
and are spelled byte by byte, each byte given the one before, so they never take
the probability of another word. An id is three codes of the same number. The
network sees two tokens on either side of a hidden one, adds their vectors
(turned by a matrix per place), and predicts the hidden token's codes one after
the other, each given those before; each step is normalised. A document's score
is the sum of the log-probabilities of all its tokens, each from both sides.

Training is numpy in tasks: in each round every task trains on its part of the
round's share of the documents from the shared parameters and returns its own,
which are summed by blocks with the token counts as weights and averaged. The
shares come round again until the loss on texts held out of training settles.
A batch's gradients are summed by place before they are summed by id, and its
ids sorted once: their order is also that of their codes.

Cases: null and empty texts have no tokens, the sum 0 and no mean; places
beyond a text's ends have a vector of their own; very long texts are scored
whole; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.classifier import KIND
from asofkit.llm.common import blocks, mix, views, written
from asofkit.llm.shingles import P_INV, powers, prefix

#: Codes of an id in a network without a vocabulary; TOKENS stands for places beyond a text's ends.
CODES, DIMS, SIDE = 16, 16, 2
TOKENS = CODES**3
BATCH, RATE = 2048, 0.05
#: A word has its own id if it occurs so often at least (see least_count).
LEAST = 5
#: Rounds that see every text once; one text in SHARES * HELD is held out. Rounds end when the held-out loss falls by less than SETTLED of itself.
SHARES, HELD, SETTLED, MOST_ROUNDS = 4, 32, 0.005, 32
#: Places around a hidden token; exponents of sums up to this size are taken without looking for the largest first.
AROUND, SAFE = np.array([d for d in range(-SIDE, SIDE + 1) if d]), 60
#: Numbers in one row of summed parameters, and different words that a counting task holds.
PART, HELD_WORDS = 1 << 15, 1 << 19
END = 256

Parameters = dict[str, np.ndarray]
TABLES = ("vectors", "given", "pair")
TRAINED = ("base", "first", "first_base", "given", "pair", "places", "second", "second_base", "third", "third_base", "vectors")
REST = tuple(k for k in TRAINED if k not in TABLES)


def start(ids: int = TOKENS) -> Parameters:
    rng = np.random.default_rng(17)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    c = next(k for k in range(2, ids + 3) if k**3 >= ids)
    return {
        "vectors": small(ids + 1, DIMS), "places": small(2 * SIDE, DIMS, DIMS) + np.eye(DIMS, dtype=np.float32), "base": np.zeros(DIMS, np.float32),
        "given": small(c, DIMS), "pair": small(c * c, DIMS), "first": small(DIMS, c), "first_base": np.zeros(c, np.float32),
        "second": small(DIMS, c), "second_base": np.zeros(c, np.float32), "third": small(DIMS, c), "third_base": np.zeros(c, np.float32),
    }


def flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in TRAINED])


def shaped(v: np.ndarray, like: Parameters) -> Parameters:
    """``like`` with its trained parameters from ``v``."""
    out, at = dict(like), 0
    for k in TRAINED:
        out[k] = v[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def windows(tokens: np.ndarray, counts: np.ndarray, beyond: int = TOKENS) -> list[np.ndarray]:
    """Per place in the window the neighbour of every token; beyond a text's ends ``beyond``."""
    row = np.repeat(np.arange(len(counts)), counts)
    out = []
    for d in AROUND:
        n = np.full(len(tokens), beyond, np.int64)
        k = abs(d)
        same = row[k:] == row[:-k]
        if d < 0:
            n[k:][same] = tokens[:-k][same]
        else:
            n[:-k][same] = tokens[k:][same]
        out.append(n)
    return out


def lined(ids: np.ndarray, counts: np.ndarray, beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in one line, each between ``SIDE`` places beyond its ends; place of every id)."""
    counts = counts[counts > 0]
    at = np.arange(len(ids)) + SIDE * np.repeat(np.arange(1, len(counts) + 1), counts)
    line = np.full(len(ids) + SIDE * (len(counts) + 1), beyond, np.int64)
    line[at] = ids
    return line, at


def stretches(line: np.ndarray, at: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Per batch of ids (their slice, their part of ``line`` with ``SIDE`` places more on either side, their places in it less ``SIDE``)."""
    for i in range(0, len(at), BATCH):
        b = at[i : i + BATCH]
        yield slice(i, i + BATCH), line[b[0] - SIDE : b[-1] + SIDE + 1], b - b[0]


def codes(p: Parameters, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first code, first and second as one number, second code, third code)."""
    c = len(p["given"])
    pair = ids // c
    one = pair // c
    return one, pair, pair - one * c, ids - pair * c


def context(p: Parameters, near: np.ndarray) -> np.ndarray:
    """Sum of the turned vectors of every token's neighbours (tokens x neighbours x DIMS)."""
    return near.reshape(len(near), -1) @ p["places"].reshape(-1, DIMS) + p["base"]


def neighbours(p: Parameters, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Vectors around the ids of a stretch (see ``stretches``)."""
    return p["vectors"].take(line.take(at[:, None] + (SIDE + AROUND)), axis=0)


def hidden(p: Parameters, a: np.ndarray, one: np.ndarray, pair: np.ndarray) -> np.ndarray:
    h = np.empty((3, *a.shape), a.dtype)
    h[0] = a
    np.add(a, p["given"].take(one, axis=0), out=h[1])
    np.add(h[1], p["pair"].take(pair, axis=0), out=h[2])
    # the hyperbolic tangent by an exponent, which numpy takes faster; beyond the largest it is one
    h *= 2
    with np.errstate(over="ignore"):
        np.exp(h, out=h)
    h += 1
    np.divide(-2, h, out=h)
    h += 1
    return h


def step(p: Parameters, k: str, h: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(z, e, s, flat places in z of every row's code, log-probability of that code): code j of row i has the probability e[j] * z[j, i] / s[i].

    ``h`` lies between -1 and 1, so the weights bound the sums.
    """
    w, base = p[k], p[f"{k}_base"]
    z = w.T @ h.T
    most = base.max()
    if np.abs(w).sum(axis=0).max() + most - base.min() > SAFE:
        z += base[:, None]
        z -= z.max(axis=0)
        base = np.zeros_like(base)
    else:
        base = base - most
    e = np.exp(base)
    own = code * len(h) + np.arange(len(h))
    log = z.ravel().take(own) + base.take(code)
    np.exp(z, out=z)
    s = e @ z
    log -= np.log(s)
    return z, e, s, own, log


def steps(p: Parameters, a: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
    """Per code of the ids (its weights' name, hidden values, which code, ``step``)."""
    one, pair, two, three = codes(p, ids)
    for h, k, code in zip(hidden(p, a, one, pair), ("first", "second", "third"), (one, two, three), strict=True):
        yield k, h, code, step(p, k, h, code)


def of_contexts(p: Parameters, a: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids))
    for _, _, _, (*_, log) in steps(p, a, ids):
        out += log
    return out


def of_ids(p: Parameters, ids: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
    """Log-probability of every id between its neighbours."""
    out = np.zeros(len(ids))
    for i in range(0, len(ids), BATCH):
        b = slice(i, i + BATCH)
        out[b] = of_contexts(p, context(p, p["vectors"][np.stack([n[b] for n in near], axis=1)]), ids[b])
    return out


def of_texts(p: Parameters, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log-probability of every id of whole texts."""
    out = np.zeros(len(ids))
    for b, line, at in stretches(*lined(ids, counts, len(p["vectors"]) - 1)):
        out[b] = of_contexts(p, context(p, neighbours(p, line, at)), ids[b])
    return out


class Words(np.ndarray):
    """Hashes of words; slices share the block (hashes, starts, ends, bytes) that spells them."""

    def __array_finalize__(self, other) -> None:
        self.block = getattr(other, "block", None)


def places_of(words: np.ndarray) -> np.ndarray:
    """Where the sorted hashes begin that share their leading bits, for two to four such beginnings per hash."""
    bits = len(words).bit_length() + 1
    starts = np.searchsorted(words, (np.arange(1 << bits) << (62 - bits)) | (1 << 62))
    return np.append(starts, len(words)).astype(np.int32)


def known(p: Parameters, words: np.ndarray) -> np.ndarray:
    """Ids of hashed words: 0 for those outside the vocabulary, the last vector's for places beyond the ends."""
    words = np.asarray(words)
    out = np.zeros(len(words), np.int64)
    if len(p["words"]):
        bits = len(p["word_places"]).bit_length() - 1
        first = (words >> (62 - bits)) & ((1 << bits) - 1)
        at, end = p["word_places"].take(first), p["word_places"].take(first + 1)
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = p["words"].take(at) == words[left]
            out[left[hit]] = p["word_ids"].take(at[hit])
            at += 1
            more = ~hit & (at < end)
            left, at, end = left[more], at[more], end[more]
    out[words == TOKENS] = len(p["vectors"]) - 1
    return out


def spelled(p: Parameters, tokens: Words, ids: np.ndarray) -> np.ndarray:
    """Log-probability of the spelling of every word outside the vocabulary; 0 for the others."""
    out, rare = np.zeros(len(tokens)), np.flatnonzero(ids == 0)
    if len(rare):
        h, starts, ends, raw = tokens.block
        if len(tokens) == len(h):
            at = rare
        else:
            seen, first = np.unique(h, return_index=True)
            at = first[np.searchsorted(seen, np.asarray(tokens)[rare])]
        size = ends[at] - starts[at] - 1
        last = np.cumsum(size)
        i = np.repeat(starts[at] - (last - size), size) + np.arange(last[-1])  # all bytes of rare words but each one's last
        up_to = np.concatenate([[0.0], np.cumsum(p["spelling"].ravel().take(raw[i].astype(np.int64) * (END + 1) + raw[i + 1]))])
        out[rare] = p["spelling"][END, raw[starts[at]]] + up_to[last] - up_to[last - size] + p["spelling"][raw[ends[at] - 1], END]
    return out


def log_probabilities(p: Parameters, tokens: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
    if "words" not in p:
        return of_ids(p, tokens, near)
    ids = known(p, tokens)
    return of_ids(p, ids, [known(p, n) for n in near]) + spelled(p, tokens, ids)


def block_probabilities(p: Parameters, tokens: Words, counts: np.ndarray) -> np.ndarray:
    ids = known(p, tokens)
    return of_texts(p, ids, counts) + spelled(p, tokens, ids)


def head_gradients(p: Parameters, a: np.ndarray, ids: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean negative log-probability: (of the weights behind the contexts, per id of its context, of its row of given, of its row of pair); each with a row of zeros at its end."""
    g, back, ones = {}, np.zeros((3, len(ids) + 1, DIMS), a.dtype), np.ones(len(ids), a.dtype)
    for d, (k, h, code, (z, e, s, own, _)) in zip(back[:, :-1], steps(p, a, ids), strict=True):
        flat = z.ravel()
        flat[own] = flat.take(own) - s / e.take(code)
        z *= 1 / (s * len(ids))
        g[k], g[f"{k}_base"] = (z @ h).T * e, e * (z @ ones)
        np.matmul(z.T, (p[k] * e).T, out=d)
        np.multiply(h, h, out=h)
        np.subtract(1, h, out=h)
        d *= h
    b = back[1] + back[2]
    a = back[0] + b
    g["base"] = ones @ a[:-1]
    return g, a, b, back[2]


def gradients(p: Parameters, tokens: np.ndarray, near: list[np.ndarray]) -> Parameters:
    """Of the mean negative log-probability, with whole tables, neighbour by neighbour."""
    v = p["vectors"][np.stack(near, axis=1)]
    one, pair, _, _ = codes(p, tokens)
    g, *of = head_gradients(p, context(p, v), tokens)
    a, of_given, of_pair = (x[:-1] for x in of)
    g |= {k: np.zeros_like(p[k]) for k in TABLES} | {"places": np.einsum("tkd,te->kde", v, a)}
    np.add.at(g["given"], one, of_given)
    np.add.at(g["pair"], pair, of_pair)
    for n, turn in zip(near, p["places"], strict=True):
        np.add.at(g["vectors"], n, a @ turn.T)
    return g


def runs(sorted_ids: np.ndarray) -> np.ndarray:
    """Where each different id begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))


def row_sums(x: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``x``, put in ``order``, from each of ``first`` up to the next; two columns at a time, as one complex number."""
    pairs = x.view(np.result_type(x.dtype, np.complex64)).take(order, axis=0)
    return np.add.reduceat(pairs, first, axis=0).view(x.dtype)


def line_gradients(p: Parameters, line: np.ndarray, at: np.ndarray) -> dict:
    """``gradients`` of a stretch (see ``stretches``); of TABLES only the rows touched: (rows, values)."""
    near, ids, c = neighbours(p, line, at), line[SIDE + at], len(p["given"])
    g, a, of_given, of_pair = head_gradients(p, context(p, near), ids)
    g["places"] = (near.reshape(len(ids), -1).T @ a[:-1]).reshape(p["places"].shape)
    row = np.full(len(line) + 2 * SIDE, len(ids))  # per place of the line, ``SIDE`` more on either side, its row of the gradients; zeros but for the batch's ids
    row[2 * SIDE + at] = np.arange(len(ids))
    by_place = a.take(row.take(np.arange(SIDE, SIDE + len(line))[:, None] - AROUND), axis=0).reshape(len(line), -1) @ p["places"].transpose(0, 2, 1).reshape(-1, DIMS)
    key = np.sort((line << 32) | np.arange(len(line)))
    line, order = key >> 32, key & 0xFFFFFFFF
    first = runs(line)
    g["vectors"] = line[first], row_sums(by_place, order, first)
    n = np.searchsorted(line, len(p["vectors"]) - 1)  # places beyond the ends have no codes
    order, pair = row.take(order[:n] + SIDE), line[:n] // c
    for k, code, x in (("given", pair // c, of_given), ("pair", pair, of_pair)):
        first = runs(code)
        g[k] = code[first], row_sums(x, order, first)
    return g


class Trainer:
    """Adagrad over batches of tokens in the order of the documents."""

    def __init__(self, p: Parameters) -> None:
        self.p = {k: v.copy() if k in TABLES else v for k, v in p.items()}
        self.squares = {k: np.full_like(p[k], 1e-6) for k in TABLES}
        self.rest = np.concatenate([p[k].ravel() for k in REST])  # parameters without rows are views of one array
        self.rest_squares, at = np.full_like(self.rest, 1e-6), 0
        for k in REST:
            self.p[k] = self.rest[at : at + p[k].size].reshape(p[k].shape)
            at += p[k].size
        self.seen = 0

    def text(self, ids: np.ndarray, counts: np.ndarray) -> None:
        for _, line, at in stretches(*lined(ids, counts, len(self.p["vectors"]) - 1)):
            g = line_gradients(self.p, line, at)
            for k in TABLES:
                rows, v = g[k]
                s = v * v
                s += self.squares[k].take(rows, axis=0)
                self.squares[k][rows] = s
                v *= RATE
                v /= np.sqrt(s, out=s)
                self.p[k][rows] = self.p[k].take(rows, axis=0) - v
            v = np.concatenate([g[k].ravel() for k in REST])
            self.rest_squares += v * v
            self.rest -= RATE * v / np.sqrt(self.rest_squares)
        self.seen += len(ids)


def token_blocks(column: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """(first row, end row, hashed words, words per row) by blocks of whole texts: runs of letters or of signs, case kept."""
    whole, all_offsets = views(column)
    for a, b in blocks(all_offsets):
        base = all_offsets[a]
        raw, offsets = whole[base : all_offsets[b]], all_offsets[a : b + 1] - base
        kind = KIND[raw]
        cut = np.ones(len(raw) + 1, bool)
        if len(raw):
            cut[1:-1] = kind[1:] != kind[:-1]
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        word = kind[starts] > 0
        starts, ends = starts[word], ends[word]
        c = prefix(raw)
        h = mix((c[ends] - c[starts]) * powers(P_INV, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))
        h = ((h >> np.uint64(2)) | np.uint64(1 << 62)).astype(np.int64)  # far above TOKENS
        tokens = h.view(Words)
        tokens.block = (h, starts, ends, raw)
        yield a, b, tokens, np.diff(np.searchsorted(starts, offsets))


def counted(docs: DataFrame) -> DataFrame:
    """Every different word of ``docs`` with its count: hash, word, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        merged = lambda: pa.concat_tables(held).group_by(["hash", "word"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["hash", "word", "n"])
        for batch in batches:
            for _, _, tokens, _ in token_blocks(batch.column("text")):
                if not len(tokens):
                    continue
                h, starts, ends, raw = tokens.block
                seen, first, n = np.unique(h, return_index=True, return_counts=True)
                size = ends[first] - starts[first]
                at = np.concatenate([[0], np.cumsum(size)])
                data = raw[np.repeat(starts[first] - at[:-1], size) + np.arange(at[-1])]
                word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(seen), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                held.append(pa.table({"hash": pa.array(seen), "word": word, "n": pa.array(n.astype(np.int64))}))
                if sum(t.num_rows for t in held) > HELD_WORDS:
                    held[:] = [merged()]
                    if held[0].num_rows > HELD_WORDS // 2:
                        yield from held.pop().combine_chunks().to_batches(max_chunksize=1 << 14)
        if held:
            yield from merged().combine_chunks().to_batches(max_chunksize=1 << 14)

    return docs.select("text").mapInArrow(count, "hash long, word binary, n long").groupBy("hash", "word").agg(F.sum("n").alias("n"))


def least_count(total: int) -> int:
    """How often a word must occur for an id of its own among ``total`` words: as the root of the corpus, so the vocabulary grows about as the root too."""
    return max(LEAST, isqrt(total) // 100)


def sums(parts: list[int], weights: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(weights, pa.int64()), pa.array([v.astype(np.float32).tobytes() for v in values], pa.binary())], ["part", "weight", "sums"])


SUMS = "part int, weight long, sums binary"


def added(partial: DataFrame, name: str) -> list:
    """Weights and values of every part, summed over the tasks in a shuffle: one row per part."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, weight, raw in zip(batch.column("part").to_pylist(), batch.column("weight").to_pylist(), batch.column("sums"), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64)
                if part in held:
                    held[part][0] += weight
                    held[part][1] += x
                else:
                    held[part] = [weight, x]
        if held:
            yield sums(list(held), [h[0] for h in held.values()], [h[1] / h[0] for h in held.values()])

    return written(partial.repartition("part").mapInArrow(add, SUMS), name).collect()


def spelling(rare: DataFrame) -> np.ndarray:
    """Log-probabilities of a byte (or END) after another (or the start) in words outside the vocabulary, with one added to every count."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((END + 1) ** 2)
        for batch in batches:
            raw, offsets = views(batch.column("word"))
            n, size = np.asarray(batch.column("n")), np.diff(offsets)
            if len(raw):
                before = np.concatenate([[END], raw[:-1].astype(np.int64)])
                before[offsets[:-1]] = END
                total += np.bincount(before * (END + 1) + raw, np.repeat(n, size), len(total))
                total += np.bincount(raw[offsets[1:] - 1].astype(np.int64) * (END + 1) + END, n, len(total))
        t = total.reshape(END + 1, END + 1)
        some = np.flatnonzero(t.any(axis=1))
        if len(some):
            yield sums(some.tolist(), [1] * len(some), list(t[some]))

    count = np.ones((END + 1, END + 1))
    for row in added(rare.select("word", "n").mapInArrow(pairs, SUMS), "spelling"):  # END + 1 rows
        count[row.part] += np.frombuffer(row.sums, np.float32).astype(np.float64) * row.weight
    count[END, END] = 1e-9  # no word is empty
    return np.log(count / count.sum(axis=1, keepdims=True))


def with_vocabulary(docs: DataFrame) -> Parameters:
    """Parameters before training, with the vocabulary of ``docs``: the driver holds the words with an id."""
    counts = written(counted(docs), "words")
    least = least_count(counts.agg(F.sum("n")).first()[0] or 0)
    often = counts.where(F.col("n") >= least).select("hash", "n").toArrow()
    h, n = (np.asarray(often.column(c).combine_chunks(), np.int64) for c in ("hash", "n"))
    h, first = np.unique(h[np.lexsort((h, -n))], return_index=True)
    return start(len(h) + 1) | {"words": h, "word_ids": first + 1, "word_places": places_of(h), "spelling": spelling(counts.where(F.col("n") < least))}


def mean_loss(docs: DataFrame, p: Parameters) -> float | None:
    """Mean negative log-probability of a word; None without words."""
    shared = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for batch in batches:
            for _, _, tokens, counts in token_blocks(batch.column("text")):
                n += len(tokens)
                total -= block_probabilities(shared.value, tokens, counts).sum()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.float64())], ["n", "total"])

    n, total = docs.select("text").mapInArrow(run, "n long, total double").agg(F.sum("n"), F.sum("total")).first()
    shared.unpersist()
    return total / n if n else None


def one_round(docs: DataFrame, p: Parameters) -> Parameters:
    """The average of what every task makes of ``p`` by its part of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(p)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Trainer(shared.value)
        for batch in batches:
            for _, _, tokens, counts in token_blocks(batch.column("text")):
                t.text(known(t.p, tokens), counts)
        if t.seen:
            v = flat(t.p).astype(np.float64) * t.seen
            for part, i in enumerate(range(0, len(v), PART)):
                yield sums([part], [t.seen], [v[i : i + PART]])

    averaged = added(docs.select("text").mapInArrow(train, SUMS), "parameters")
    shared.unpersist()
    if not averaged:
        return p
    v = flat(p)
    for row in averaged:
        v[row.part * PART : (row.part + 1) * PART] = np.frombuffer(row.sums, np.float32)
    return shaped(v, p)


def trained(docs: DataFrame) -> Parameters:
    """Parameters from ``docs``: the driver holds one set of them."""
    p = with_vocabulary(docs)
    share = F.pmod(F.xxhash64("text"), F.lit(SHARES * HELD))
    held, rest = written(docs.where(share == 0).select("text"), "held"), docs.where(share != 0)  # read once a round
    old = mean_loss(held, p)
    if old is None:  # too few texts to hold any out
        held, rest = docs, docs
        old = mean_loss(held, p)
    for r in range(MOST_ROUNDS if old is not None else 0):
        p = one_round(rest.where(F.pmod(share, F.lit(SHARES)) == r % SHARES), p)
        new = mean_loss(held, p)
        if r + 1 >= SHARES and old - new < SETTLED * old:
            break
        old = new
    return p


def scored(docs: DataFrame, p: Parameters, keep: list[str]) -> DataFrame:
    """``keep``, n_tokens, log_likelihood (the sum over all tokens) and its mean per token."""
    shared = docs.sparkSession.sparkContext.broadcast(p)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep] + ["n_tokens long, log_likelihood double, mean_log_likelihood double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b, tokens, counts in token_blocks(batch.column("__text")):
                n[a:b] = counts
                if len(tokens):
                    lp = block_probabilities(shared.value, tokens, counts)
                    some = np.flatnonzero(counts)
                    total[a + some] = np.add.reduceat(lp, (np.cumsum(counts) - counts)[some])
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(n), pa.array(total), mean], [*keep, "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return source.mapInArrow(run, schema)
