"""Near-duplicates by MinHash with tensored banding, confirmed on full shingle sets.

A document has two small collections of M band hashes each, A and B, of ROWS
minhashes. The M * M tables are keyed by the pairs (A_i, B_j), so 2 * M * ROWS
minhashes serve as many tables as M * M * 2 * ROWS would with independent
bands. Two sets of similarity s share a table with probability
(1 - (1 - s**ROWS)**M)**2: 0.998 at 0.8.

Equal sets are folded first. What shares A_i meets in one task, in blocks of
bounded size (a large group is cut into block pairs, so no task holds it
whole); there the pairs that share some B_j, too, and no earlier A, are counted
on their full sets. Only spanning links leave the task, never all pairs.

Cases: a text without words, or null, has an empty set and links with nothing;
fewer than ``k`` words are one shingle; repeated rows share a set and so a
component; null ids take part and a component's id is the smallest that is not
null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import fresh, mix, row_keyed, slices, views, written
from asofkit.llm.components import Forest, components
from asofkit.llm.shingles import shingle_sets

M, ROWS = 7, 2
#: Members of a group that one side of a task holds.
BLOCK_ROWS = 512
_RNG = np.random.default_rng(77)
MULT = _RNG.integers(0, 1 << 63, 2 * M * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 1 << 64, 2 * M * ROWS, dtype=np.uint64)


def bands(s: np.ndarray) -> np.ndarray:
    """The 2 * M band hashes of a set: A first, then B."""
    low = np.empty(len(MULT), np.uint64)
    for t in range(len(MULT)):
        low[t] = (s * MULT[t] + ADD[t]).min()
    low = mix(low.reshape(2 * M, ROWS))
    return mix(low[:, 0] * np.uint64(0x9E3779B97F4A7C15) + low[:, 1]).view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """file, pos, doc_id, n_shingles, class hashes c1, c2 and the bands of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, c1, c2, keys = [], [], [], []
            for s in shingle_sets(*views(b.column("text")), k):
                n.append(len(s))
                c1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                c2.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                keys.append(bands(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("file"), b.column("pos"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["file", "pos", "doc_id", "n_shingles", "c1", "c2", "bands"],
            )

    return docs.select("file", "pos", "doc_id", "text").mapInArrow(run, f"file long, pos long, doc_id {kind}, n_shingles long, c1 long, c2 long, bands array<long>")


def groups(classes: DataFrame) -> DataFrame:
    """Per class that shares some A_i: the places (i, A_i, block pair) where it must be."""
    rows = classes.select("rep", F.posexplode(F.slice("bands", 1, M)).alias("i", "key"))
    sizes = rows.groupBy("i", "key").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    sizes = written(sizes, "sizes")  # a join between two plain exchanges can be split where a key is hot
    met = rows.join(sizes, ["i", "key"])
    blocks = F.ceil(F.col("g") / BLOCK_ROWS)
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    met = met.withColumn("own", own).select("rep", "i", "key", "own", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("other"))
    place = F.struct("i", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own")
    return met.groupBy("rep").agg(F.collect_list(place).alias("places"))


PLACED = "rep long, i int, key long, p int, q int, own int, bands binary, shingles binary"


def place_sets(rows: DataFrame, k: int) -> DataFrame:
    """One row per class and place with its full shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch)):
            places, reps = b.column("places").to_pylist(), b.column("rep").to_pylist()
            keys = b.column("bands").to_pylist()
            out: list[tuple] = []
            held = 0
            for rep, own, key, s in zip(reps, places, keys, shingle_sets(*views(b.column("text")), k), strict=True):
                raw, band = s.tobytes(), np.array(key, np.int64).tobytes()
                for x in own:
                    out.append((rep, x["i"], x["key"], x["p"], x["q"], x["own"], band, raw))
                    held += len(raw)
                if held > 4 << 20:
                    yield placed(out)
                    out, held = [], 0
            if out:
                yield placed(out)

    def placed(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["rep", "i", "key", "p", "q", "own", "bands", "shingles"])

    return rows.select("rep", "places", "bands", "text").mapInArrow(run, PLACED)


def linked(i: int, p: int, q: int, members: list[tuple], share: int) -> list[tuple[int, int]]:
    """Spanning links of one block pair: pairs whose first common A is A_i, that share some B and pass on full sets.

    members: (rep, own block, bands, set). With p = q all pairs, else those across.
    """
    n = len(members)
    bands = np.stack([m[2] for m in members])
    size = np.array([len(m[3]) for m in members])
    block = np.array([m[1] for m in members])
    token, where = np.unique(np.concatenate([m[3] for m in members]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(where, kind="stable")  # postings by token
    holder = np.repeat(np.arange(n), size)[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(token)))])
    out, f = [], Forest()
    for x in range(n - 1):
        later = np.arange(n) > x
        ok = later & (bands[:, M:] == bands[x, M:]).any(axis=1)
        if i:
            ok &= ~(bands[:, :i] == bands[x, :i]).any(axis=1)
        if p != q:
            ok &= block != block[x]
        ok &= (100 * np.minimum(size, size[x]) >= share * np.maximum(size, size[x]))
        if not ok.any():
            continue
        t = where[starts[x] : starts[x + 1]]
        a, b = begin[t], begin[t + 1]
        span = b - a
        at = np.repeat(a - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        common = np.bincount(holder[at], minlength=n)
        union = size + size[x] - common
        for y in np.flatnonzero(ok & (100 * common >= share * union)).tolist():
            if f.join(x, y):
                out.append((members[x][0], members[y][0]))
    return out


def verified(placed: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, []

        def close() -> list[tuple[int, int]]:
            return linked(at[0], at[2], at[3], members, share) if len(members) > 1 else []

        for b in (x for batch in batches for x in slices(batch)):
            found: list[tuple[int, int]] = []
            c = b.to_pydict()
            for rep, i, key, p, q, own, band, raw in zip(*(c[x] for x in ("rep", "i", "key", "p", "q", "own", "bands", "shingles")), strict=True):
                if (i, key, p, q) != at:
                    found += close()
                    at, members = (i, key, p, q), []
                members.append((rep, own, np.frombuffer(band, np.int64), np.frombuffer(raw, np.uint64)))
            yield pairs(found)
        yield pairs(close())

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    by = ["i", "key", "p", "q"]
    return placed.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, k: int = 4, share: int = 80) -> DataFrame:
    """file, pos, doc_id, n_shingles, component_id, kept (one row of each component) for every row of ``docs``.

    ``docs``: doc_id and text with the row key of ``row_keyed``.
    """
    signed = written(signatures(docs, k), "signatures")
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("c1", "c2", "n_shingles").agg(F.first("bands").alias("bands"), F.min(F.struct("file", "pos")).alias("at"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "file", "pos")).alias("least"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    met = groups(classes).join(classes.select("rep", "bands", F.col("at.file").alias("file"), F.col("at.pos").alias("pos")), "rep")
    texts = docs.select("file", "pos", "text").join(met, ["file", "pos"])
    links = verified(place_sets(texts, k), share)
    roots = components(links)
    rooted = classes.join(roots, classes["rep"] == roots["node"], "left").select("c1", "c2", "n_shingles", "least", F.coalesce("root", "rep").alias("root"))
    rooted = written(rooted, "rooted")
    chosen = rooted.groupBy("root").agg(F.min("least").alias("chosen"))
    named = rooted.join(chosen, "root").select("c1", "c2", "n_shingles", "chosen")
    out = signed.select("file", "pos", "doc_id", "n_shingles", "c1", "c2").join(named, ["c1", "c2", "n_shingles"], "left")
    alone = F.col("chosen").isNull()
    return out.select(
        "file", "pos", "doc_id", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("chosen.doc_id")).alias("component_id"),
        (alone | ((F.col("chosen.file") == F.col("file")) & (F.col("chosen.pos") == F.col("pos")))).alias("kept"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five words, 0.8); documents without words stay. Columns of any names stay."""
    file, pos = fresh("file", docs.columns), fresh("pos", docs.columns)
    keyed = row_keyed(docs, file, pos)
    kept = grouped(keyed.select(F.col(file).alias("file"), F.col(pos).alias("pos"), "doc_id", "text"), 5)
    dropped = written(kept.where(~F.col("kept")).select(F.col("file").alias(file), F.col("pos").alias(pos)), "dropped")
    return keyed.join(dropped, [file, pos], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
