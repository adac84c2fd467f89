"""Removal of byte strings that repeat anywhere in the corpus, by run-compressed BWT indexes.

Every window of LENGTH bytes is keyed by its minimiser: the k-gram in it with
the smallest hash. Equal windows have equal minimisers at equal places, so all
occurrences of a window meet under one key. Neighbouring windows with the same
minimiser form a segment; only keys and hashes of segments are shuffled:

* a key that occurs once has no repeats;
* a segment that occurs twice or more is repeated whole;
* a single segment whose key has others is repeated in part. Its bytes, and one
  copy of each other segment of the key, go to a task, where segments are
  indexed together: suffixes sorted by prefix doubling, the Burrows-Wheeler
  transform cut into runs, and at both ends of each run the text position and
  its match with the neighbouring suffix kept as samples. Between samples match
  lengths fall by one per position, so one pass over the text streams the
  matching statistics against all other suffixes from the samples alone.
  Windows with a match of LENGTH are marked.

A window lies in exactly one segment, so a match within the index is another
place of the corpus, never the same one. A key with more than GROUP_SEGMENTS
different segments is settled by fingerprints of its windows, which Spark
aggregates before the shuffle.

Cases: null and empty texts have no bytes; texts shorter than LENGTH keep all;
very long texts are cut into no pieces (their segments are); repeated rows
repeat each other whole; runs of one byte repeat themselves; an empty table
gives an empty result; other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import blocks, fresh, mix, row_keyed, slices, views, written
from asofkit.llm.shingles import BYTE, P, P_INV, powers

LENGTH, GRAM = 200, 32
GROUP_SEGMENTS = 50_000
#: Bytes of segments indexed together; a larger key stands alone.
INDEX_BYTES = 1 << 20
_RNG = np.random.default_rng(991)
BYTE_2 = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
P_2 = np.uint64(int(_RNG.integers(0, 1 << 63)) * 2 + 1)
P_2_INV = np.uint64(pow(int(P_2), -1, 1 << 64))


#: Low bits of a gram's rank that hold its place (64 GB of bytes in a block); the rest are of its hash. The width is the
#: same in every block, so equal windows break ties alike (by place) whatever block they lie in.
PLACE_BITS = 36


def sums(raw: np.ndarray, of_byte: np.ndarray, base: np.uint64) -> np.ndarray:
    c = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(of_byte[raw] * powers(base, len(raw)), out=c[1:])
    return c


def between(c: np.ndarray, inverse: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((c[e] - c[a]) * inverse[a] + (e - a).astype(np.uint64))


def segments(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, key, hash 1, hash 2) of the segments of a block; places count from the row's start."""
    n, width = len(raw), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    c, inv = sums(raw, BYTE, P), powers(P_INV, n + 1)
    v = mix((c[gram:] - c[:-gram]) * inv[: n - gram + 1])
    bits = np.uint64(PLACE_BITS)
    v = (v >> bits << bits) | np.arange(len(v), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[: len(v) - span], v[span:])
        span *= 2
    if span < width:
        v = np.minimum(v[: len(v) - (width - span)], v[width - span :])
    at = (v & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of window s, for all s
    del v
    row = np.searchsorted(offsets, np.arange(len(at)), side="right") - 1 if len(offsets) < 3 else np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    inside = np.arange(len(at)) + length <= offsets[row + 1]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none, none, none, none, none, none
    stop = np.flatnonzero(new | ~inside)  # a segment ends before the next start or the first window outside
    last = np.append(stop, len(at))[np.searchsorted(stop, first, side="right")] - 1
    key = between(c, inv, at[first], at[first] + gram)
    one = between(c, inv, first, last + length)
    two = between(sums(raw, BYTE_2, P_2), powers(P_2_INV, n + 1), first, last + length)
    start = offsets[row[first]]
    return row[first], first - start, last - start, key.view(np.int64), one.view(np.int64), two.view(np.int64)


class RunIndex:
    """Run-compressed BWT of a collection of byte strings, with samples at run ends.

    ``sample_at``: text positions of the first and last suffix of each run;
    ``sample_len``: their match with the suffix before resp. after them.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, most: int) -> None:
        count = len(offsets) - 1
        sizes = np.diff(offsets)
        self.starts = offsets[:-1] + np.arange(count)  # in the text with an end sign after each string
        n = len(raw) + count
        text = np.zeros(n, np.int64)
        keep = np.ones(n, bool)
        ends = self.starts + sizes
        keep[ends] = False
        text[keep] = raw.astype(np.int64) + 1
        self.left = np.repeat(ends, sizes + 1) - np.arange(n)  # bytes before the end sign
        order = self._sorted(text, int(sizes.max(initial=0)))
        before = text[order - 1]  # the transform; position 0 follows the last end sign
        edge = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1  # end signs differ from each other
        self.runs = len(edge) + 1
        # a run's head matches upwards as its upper neighbour, the end of the run before, matches downwards
        up, down = order[edge], order[edge - 1]
        common = self._common(text, up, down, most)
        self.head_at, self.head_len = np.append(up, order[0]), np.append(common, 0)
        self.tail_at, self.tail_len = np.append(down, order[-1]), np.append(common, 0)
        self.n = n

    def _sorted(self, text: np.ndarray, longest: int) -> np.ndarray:
        """Suffix order; end signs differ, the earlier is the smaller."""
        n = len(text)
        wide = np.concatenate([text, np.zeros(7, np.int64)])
        key = np.zeros(n, np.int64)
        for i in range(7):
            key = (key << 9) | np.where(self.left >= i, wide[i : n + i], 0)
        order = np.argsort(key, kind="stable")
        s = key[order]
        fresh = np.ones(n, bool)
        fresh[1:] = (s[1:] != s[:-1]) | (self.left[order[1:]] < 7)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        step = 7
        while step <= longest and not fresh.all():
            tied = np.zeros(n, bool)  # only suffixes that share their rank are sorted again
            same = ~fresh
            tied[1:] |= same[1:]
            tied[:-1] |= same[1:]
            where = np.flatnonzero(tied)
            sub = order[where]
            nxt = rank[np.minimum(sub + step, n - 1)]
            k = rank[sub] * np.int64(n) + nxt
            o = np.argsort(k, kind="stable")
            order[where] = sub[o]
            k = k[o]
            f = np.ones(len(k), bool)
            f[1:] = k[1:] != k[:-1]
            fresh[where] = f
            # ranks are places of the first of equals, so untouched ranks stay
            at = np.where(fresh, np.arange(n), 0)
            rank[order] = np.maximum.accumulate(at)
            step *= 2
        return order

    def _common(self, text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Common bytes of the suffixes at a and b, up to ``most`` or a little more; end signs match nothing."""
        room = np.minimum(self.left[a], self.left[b])
        n = len(text)
        wide = np.concatenate([text, np.zeros(7, np.int64)])
        word = np.zeros(n, np.int64)
        for i in range(7):
            word = (word << 9) | wide[i : n + i]
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(room > 0)
        while len(live):
            x = word[np.minimum(a[live] + out[live], n - 1)] ^ word[np.minimum(b[live] + out[live], n - 1)]
            whole = x == 0
            # leading equal symbols of 7 nine-bit ones
            part = np.zeros(len(live), np.int64)
            for i in range(1, 7):
                part += (x >> (9 * (7 - i))) == 0
            out[live] += np.where(whole, 7, part)
            live = live[whole & (out[live] < np.minimum(room[live], most))]
        return np.minimum(out, room)

    def statistics(self) -> np.ndarray:
        """Per text position the longest match with another suffix (exact below ``most``), streamed from the samples."""
        best = np.zeros(self.n, np.int64)
        for at, length in ((self.head_at, self.head_len), (self.tail_at, self.tail_len)):
            reach = np.full(self.n, -1, np.int64)
            reach[at] = length + at  # positions up to the next sample end their match there
            where = np.full(self.n, -1, np.int64)
            where[at] = at
            where = np.maximum.accumulate(where)
            got = np.where(where >= 0, reach[where] - np.arange(self.n), 0)
            best = np.maximum(best, got)
        return best

    def matched(self, length: int) -> np.ndarray:
        return (self.statistics() >= length) & (self.left >= length)


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Starts of the windows of every string that occur elsewhere in the strings."""
    sizes = np.array([len(s) for s in strings], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    index = RunIndex(np.frombuffer(b"".join(strings), np.uint8), offsets, int(sizes.max(initial=0)) + 1)
    hit = index.matched(length)
    return [np.flatnonzero(hit[a : a + n]) for a, n in zip(index.starts.tolist(), sizes.tolist(), strict=True)]


def intervals(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by windows at sorted ``starts``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    firsts, lasts = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]
    return list(zip(firsts.tolist(), (lasts + length).tolist(), strict=True))


ANCHOR = "file long, pos long, a long, b long, h long, s1 long, s2 long"


def anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = views(batch.column("text"))
            for x, y in blocks(offsets):
                base = offsets[x]
                row, a, b, h, s1, s2 = segments(raw[base : offsets[y]], offsets[x : y + 1] - base, length)
                at = pa.array(row + x)
                yield pa.RecordBatch.from_arrays([batch.column("file").take(at), batch.column("pos").take(at), *[pa.array(c, pa.int64()) for c in (a, b, h, s1, s2)]], ["file", "pos", "a", "b", "h", "s1", "s2"])

    return docs.select("file", "pos", "text").mapInArrow(run, ANCHOR)


def shipped(texts: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted segments of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            raw, offsets = views(batch.column("text"))
            out, held = [], 0
            for k, (file, pos, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "pos", "wanted")), strict=True)):
                for w in own:
                    piece = raw[offsets[k] + w["a"] : offsets[k] + w["b"] + length].tobytes()
                    out.append((w["h"], w["n"], w["d"], file, pos, w["a"], piece))
                    held += len(piece)
                if held > 8 << 20:
                    yield rows(out)
                    out, held = [], 0
            yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 7, kinds, strict=True)], ["h", "n", "d", "file", "pos", "a", "bytes"])

    return texts.mapInArrow(run, "h long, n long, d long, file long, pos long, a long, bytes binary")


SPAN = "file long, pos long, a long, e long"


def indexed(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated byte ranges (file, pos, a, e) of single segments, key by key through run indexes."""

    def close(held: list[tuple]) -> list[tuple]:
        found = []
        if len(held) > 1:
            for (_, n, file, pos, a, _), starts in zip(held, repeated_windows([x[5] for x in held], length), strict=True):
                if n == 1:
                    found += [(file, pos, a + x, a + y) for x, y in intervals(starts, length)]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in (x for b in batches for x in slices(b, 4096)):
            found: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "n", "file", "pos", "a", "bytes")), strict=True):
                if size >= INDEX_BYTES and row[0] != held[-1][0]:
                    found += close(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
            yield rows(found)
        yield rows(close(held))

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(4)], ["file", "pos", "a", "e"])

    return pieces.select("h", "n", "file", "pos", "a", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(run, SPAN)


def fingerprinted(pieces: DataFrame, length: int) -> DataFrame:
    """The same ranges for keys with very many segments: windows are counted by their fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, file, pos, a, raw in zip(*(batch.column(c).to_pylist() for c in ("n", "file", "pos", "a", "bytes")), strict=True):
                r = np.frombuffer(raw, np.uint8)
                s = np.arange(len(r) - length + 1)
                cols = [pa.array(np.full(len(s), x)) for x in (n, file, pos)] + [pa.array(s + a)]
                for of_byte, base, inverse in ((BYTE, P, P_INV), (BYTE_2, P_2, P_2_INV)):
                    cols.append(pa.array(between(sums(r, of_byte, base), powers(inverse, len(r) + 1), s, s + length).view(np.int64)))
                yield pa.RecordBatch.from_arrays(cols, ["n", "file", "pos", "a", "f1", "f2"])

    windows = pieces.select("n", "file", "pos", "a", "bytes").mapInArrow(run, "n long, file long, pos long, a long, f1 long, f2 long")
    often = windows.groupBy("f1", "f2").agg(F.sum("n").alias("times")).where("times > 1")
    return windows.where("n = 1").join(often, ["f1", "f2"], "left_semi").select("file", "pos", "a", (F.col("a") + length).alias("e"))


def repeated(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(file, pos, spans) of all rows with repeats, and (file, pos, text) of rows that may have some.

    ``docs``: file, pos, text. spans: byte ranges that cover every repeated window.
    """
    found = written(anchors(docs, length), "anchors")
    # written, so that the join below is between two plain exchanges, which Spark can split where a key is hot
    often = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h"), "often")
    found = written(found.join(often, "h", "left_semi"), "shared")
    kinds = found.groupBy("h", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "pos", "a", "b")).alias("at"))
    kinds = written(kinds, "kinds")
    whole = found.join(kinds.where("n > 1").select("h", "s1", "s2"), ["h", "s1", "s2"], "left_semi").select("file", "pos", "a", (F.col("b") + length).alias("e"))
    keys = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("d"), F.min("n").alias("fewest")).where("d > 1 and fewest = 1").select("h", "d")
    keys = written(keys, "keys")
    wanted = kinds.join(keys, "h").select("at.*", "h", "n", "d")
    wanted = wanted.groupBy("file", "pos").agg(F.collect_list(F.struct("a", "b", "h", "n", "d")).alias("wanted"))
    rows = found.select("file", "pos").distinct().join(wanted, ["file", "pos"], "left")
    texts = written(docs.join(rows, ["file", "pos"]).select("file", "pos", "text", "wanted"), "texts")
    pieces = shipped(texts.where("wanted is not null"), length)
    hot = keys.where(F.col("d") > GROUP_SEGMENTS).limit(1).count() > 0  # both ways give the same ranges
    parts = indexed(pieces.where(F.col("d") <= GROUP_SEGMENTS), length)
    if hot:
        parts = parts.union(fingerprinted(pieces.where(F.col("d") > GROUP_SEGMENTS), length))
    spans = whole.union(parts).groupBy("file", "pos").agg(F.collect_list(F.struct("a", "e")).alias("spans"))
    return spans, texts.select("file", "pos", "text")


def union_of(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal byte ranges; touching ones are one."""
    out: list[list[int]] = []
    for s in sorted((x["a"], x["e"]) for x in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows with repeats only: file, pos, n_removed, n_spans, kept_sha256 and the kept bytes."""
    spans, texts = repeated(docs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            out = []
            for t, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes()
                cut = union_of(spans)
                ends = [0, *[x for s in cut for x in s], len(raw)]
                kept = b"".join(raw[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2))
                out.append((len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("pos"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["file", "pos", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    return texts.join(spans, ["file", "pos"]).mapInArrow(run, "file long, pos long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (file, pos, doc_id, text)."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    whole = docs.select("file", "pos", "doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"))
    part = cleaned(docs.select("file", "pos", "text"), length).drop("kept_bytes")
    both = whole.join(part, ["file", "pos"], "left")
    zero = F.lit(0).cast("long")
    return both.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated passages cut out; characters that a cut breaks go, too. Columns of any names stay."""
    file, pos, left = (fresh(n, docs.columns) for n in ("file", "pos", "left"))
    keyed = row_keyed(docs, file, pos)
    part = cleaned(keyed.select(F.col(file).alias("file"), F.col(pos).alias("pos"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("pos"), pa.array([x.as_buffer().to_pybytes().decode(errors="ignore") for x in b.column("kept_bytes")], pa.string())], [file, pos, left])

    cut = written(part.select("file", "pos", "kept_bytes").mapInArrow(run, f"`{file}` long, `{pos}` long, `{left}` string"), "cut")
    text = next(c for c in docs.columns if c.lower() == "text")
    joined = keyed.join(cut, [file, pos], "left").withColumn(text, F.coalesce(left, text))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
