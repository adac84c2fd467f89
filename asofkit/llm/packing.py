"""Packing of tokenised documents into sequences by swap-based local search.

Documents become pieces of at most ``capacity`` tokens. Full pieces are
sequences of their own; the others are dealt into groups of bounded size, each
packed best-fit decreasing and then improved by exchanges between underfull
bins: move one document, one for one, or two for one, always from a bin to one
at least as full, so the sum of squared fills rises and bins run empty. The
least filled bins of all groups are packed again, in fewer groups, until one
group is left: the loss of a group is a fraction of its bins, whatever the
number of groups.

Cases: a null or empty text is the end token alone; texts longer than a
sequence are cut and only they; repeated rows are packed as often as they
occur; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.bpe import Words
from asofkit.llm.common import written

CAPACITY = 2048
#: Pieces of a group that one task packs.
GROUP = 20_000
#: Share of a group's bins, the least filled, that go into the next round.
AGAIN = 0.1
#: Exchanges tried per piece at most; the search is only a search, every packing it leaves is valid.
EFFORT = 20


class Tokens:
    """Ids of a tokenizer file (byte-level BPE) as little-endian 32-bit, ``end`` not added."""

    def __init__(self, path: str, pattern: str) -> None:
        spec = json.loads(Path(path).read_text())
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            if spec["model"]["vocab"][a + b] != 256 + i:
                raise ValueError("merges are not in the order of ids")
        self.coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words = Words(lambda s: array("I", self.coder.encode_ordinary(s)).tobytes())

    def ids(self, text: str) -> bytes:
        for name, i in self.special.items():
            if name in text:
                return array("I", [i]).tobytes().join(self.ids(part) if part else b"" for part in text.split(name))
        return self.words.text(text)


def pieces(df: DataFrame, path: str, pattern: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Rows of doc_id, piece, start, length, ids_crc32 from doc_id and text; the first piece of a cut text is the short one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path, pattern)
        tail = end.to_bytes(4, "little")
        for b in batches:
            which, rows = [], []
            for k, t in enumerate(b.column("text")):
                raw = tokens.ids(t.as_py() or "") + tail
                n, at, piece = len(raw) // 4, 0, 0
                while at < n:
                    size = n % capacity or capacity if piece == 0 else capacity
                    which.append(k)
                    rows.append((piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
                    at, piece = at + size, piece + 1
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("row").take(pa.array(which, pa.int64())), b.column("doc_id").take(pa.array(which, pa.int64())), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                ["row", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    source = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = df.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[list[list[int]], list[int]]:
    """Best-fit decreasing: bins of item numbers and their fills."""
    bins: list[list[int]] = []
    fill: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit s: some bin has space s
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fit = spaces >> size
        if fit:
            s = size + (fit & -fit).bit_length() - 1
            b = by_space[s].pop()
            if not by_space[s]:
                spaces &= ~(1 << s)
            bins[b].append(k)
            fill[b] += size
        else:
            b = len(bins)
            bins.append([k])
            fill.append(size)
        s = capacity - fill[b]
        by_space[s].append(b)
        spaces |= 1 << s
    return bins, fill


def exchange(sizes: np.ndarray, bins: list[list[int]], fill: list[int], capacity: int) -> None:
    """Raise the sum of squared fills by exchanges until no bin can give more, in place."""
    total = int(sizes.sum())
    least = -(-total // capacity)
    owner = np.empty(len(sizes), np.int64)
    for b, items in enumerate(bins):
        owner[items] = b
    full = np.array(fill, np.int64)

    def shift(giver: int, out: list[int], taker: int, back: list[int]) -> None:
        for k in out:
            bins[giver].remove(k)
            bins[taker].append(k)
            owner[k] = taker
        for k in back:
            bins[taker].remove(k)
            bins[giver].append(k)
            owner[k] = giver
        d = int(sizes[out].sum() - sizes[back].sum())
        full[giver] -= d
        full[taker] += d

    def give(v: int) -> bool:
        """One improving exchange out of bin v."""
        space = np.where((full >= full[v]) & (full < capacity), capacity - full, -1)
        space[v] = -1
        if space.max() <= 0:
            return False
        for k in sorted(bins[v], key=lambda k: -sizes[k]):
            a = int(sizes[k])
            ok = np.flatnonzero(space >= a)
            if len(ok):  # move
                shift(v, [k], int(ok[np.argmin(space[ok])]), [])
                return True
        for k in sorted(bins[v], key=lambda k: -sizes[k]):
            a = int(sizes[k])
            room = space[owner]
            ok = np.flatnonzero((sizes < a) & (room > 0) & (a - sizes <= room))
            if len(ok):  # one for one
                j = int(ok[np.argmin(sizes[ok])])
                shift(v, [k], int(owner[j]), [j])
                return True
        for k in sorted(bins[v], key=lambda k: -sizes[k]):
            a = int(sizes[k])
            for t in np.flatnonzero((space > 0) & (full >= a - space)).tolist():
                held: dict[int, list[int]] = {}  # at most 63 sizes differ: their sum is bounded
                for j in bins[t]:
                    if sizes[j] < a:
                        held.setdefault(int(sizes[j]), []).append(j)
                for x in held:
                    for y in range(max(x, a - int(space[t]) - x), a - x):
                        if y in held and (y != x or len(held[x]) > 1):  # two for one
                            shift(v, [k], t, [held[x][0], held[y][1 if x == y else 0]])
                            return True
        return False

    left = EFFORT * len(sizes)
    better = True
    while better and left > 0:
        better = False
        for v in np.argsort(full, kind="stable").tolist():
            if int((full > 0).sum()) <= least:
                better = False
                break
            while full[v] and left > 0 and give(v):
                left -= 1
                better = True
    fill[:] = full.tolist()


def pack_group(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, fill of it) per item; bins are numbered from 0 without gaps."""
    bins, fill = best_fit(sizes, capacity)
    exchange(sizes, bins, fill, capacity)
    where, offset, filled = (np.zeros(len(sizes), np.int64) for _ in range(3))
    n = 0
    for items in bins:
        if items:
            s = sizes[items]
            where[items], offset[items], filled[items] = n, np.cumsum(s) - s, s.sum()
            n += 1
    return where, offset, filled


def packer(names: list[str], capacity: int, level: int, last: bool):
    """Packs one group; unless it is the last round, the least filled bins are marked to be packed again."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        where, offset, filled = pack_group(pdf["length"].to_numpy(), capacity)
        bins = np.zeros(where.max() + 1, np.int64)
        bins[where] = filled
        again = np.zeros(len(bins), bool)
        if not last:
            low = np.argsort(bins, kind="stable")[: max(1, int(AGAIN * len(bins)))]
            again[low] = bins[low] < capacity
        pdf["sequence_id"] = (level << 56) + (pdf["grp"].to_numpy().astype(np.int64) << 20) + where
        pdf["offset"], pdf["again"] = offset, again[where]
        return pdf[[*names, "sequence_id", "offset", "again"]]

    return pack


def packed(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces with sequence_id and offset. ``cut``: a written table with row, piece and length."""
    names = cut.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    level = 0
    whole = cut.where(F.col("length") == capacity)
    done = [whole.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))]
    rest = cut.where(F.col("length") < capacity)
    while True:
        n = rest.count()
        groups = max(1, -(-n // group))
        last = groups == 1
        level += 1
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64("row", "piece", F.lit(level)), F.lit(groups)))
        out = written(dealt.groupBy("grp").applyInPandas(packer(names, capacity, level, last), kinds + ", sequence_id long, offset long, again boolean"), "packed")
        done.append(out.where("not again").drop("again"))
        if last:
            break
        rest = out.where("again").select(*names)
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def pack_documents(docs: DataFrame, path: str, pattern: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    cut = written(pieces(docs, path, pattern, end, capacity), "pieces")
    return packed(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of what the stages before have left."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
