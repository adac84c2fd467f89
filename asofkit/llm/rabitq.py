"""Embedding near-duplicates by one-bit codes with correction factors.

A vector is scaled to length one and turned by a random rotation; its code is
the signs, its correction factor f the inner product with its own code. For two
vectors x, y the product of x with y's code over f(y) is an unbiased estimate
of their cosine, with an error of about sqrt(1 / f**2 - 1) / sqrt(D - 1). Where
the estimate plus EPS such errors reaches the threshold, both ways, the
cosine is computed again in double precision; only that decides.

Codes, factors and the turned vector in bytes (for the side that meets the
code; the bound takes in its rounding) are computed and stored once. Equal
vectors are folded into one with a weight. Pairs to estimate come from hash
tables of random hyperplanes. Bits per table grow with the logarithm of the
number of vectors and the number of tables so that a pair at the threshold
meets with probability RECALL. A bucket is cut into blocks of bounded size and
tasks take block pairs; codes alone travel there. Members with an open pair then
fetch their full vectors and meet again in the same block pair. Each pair counts
in the first table that it shares. Tasks give link counts and spanning links only.

Cases: null vectors, zero vectors and such with null or non-finite components
link with nothing; vectors of different lengths never link; repeated rows link
like any others; null ids take part; an empty table gives an empty result; other
columns of any name are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import slices, written
from asofkit.llm.components import Forest, components

RECALL = 0.997
#: Vectors that a bucket has on average.
BUCKET = 160
BLOCK_ROWS = 2048
#: Width of the confidence bound in standard errors.
EPS = 4.5


def tables_for(n: int, least: float) -> tuple[int, int]:
    """(bits, tables): a pair of cosine ``least`` shares a bucket with probability RECALL."""
    bits = max(1, round(math.log2(max(n, 2) / BUCKET))) if n > BUCKET else 1
    agree = 1 - math.acos(least) / math.pi
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree**bits)))


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def planes(dims: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(10_000 + dims).normal(size=(dims, tables * bits))


def signed(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """What is stored of every vector: rid, vec_id, dims (null: links with nothing), keys (one per table), their bits
    packed (``sides``), code, factor, the turned vector in bytes (``turned`` times ``step``), the vector in double
    precision and a digest of it."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    types = {"dims": "int", "keys": "array<long>", "sides": "binary", "code": "binary", "factor": "double", "turned": "binary", "step": "double", "vector": "binary", "same": "binary"}
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def stored(v: np.ndarray) -> list[tuple]:
        dims = v.shape[1]
        if dims not in held:
            held[dims] = planes(dims, bits, tables), rotation(dims)
        side = v @ held[dims][0] > 0
        keys = (side.reshape(-1, tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
        turned = (v / np.linalg.norm(v, axis=1)[:, None]) @ held[dims][1]
        positive = turned > 0
        factor = np.abs(turned).sum(axis=1) / math.sqrt(dims)
        step = np.abs(turned).max(axis=1) / 127
        small = np.rint(turned / step[:, None]).astype(np.int8)
        packed, codes = np.packbits(side, axis=1), np.packbits(positive, axis=1)
        return [(dims, keys[i].tolist(), packed[i].tobytes(), codes[i].tobytes(), float(factor[i]), small[i].tobytes(), float(step[i]), v[i].tobytes(), hashlib.blake2b(v[i].tobytes(), digest_size=16).digest()) for i in range(len(v))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch)):
            rows = [None if v is None or any(x is None for x in v) else np.array(v, np.float64) for v in b.column("embedding").to_pylist()]
            out: list[tuple] = [(None,) * len(types)] * len(rows)
            by: dict[int, list[int]] = {}
            for i, v in enumerate(rows):
                if v is not None and len(v) and np.isfinite(v).all() and v.any():
                    by.setdefault(len(v), []).append(i)
            for at in by.values():
                for i, one in zip(at, stored(np.stack([rows[i] / np.abs(rows[i]).max() for i in at])), strict=True):  # no overflow, the same direction
                    out[i] = one
            arrow = [pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.float64(), pa.binary(), pa.binary()]
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("vec_id"), *cols], ["rid", "vec_id", *types])

    source = vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "embedding")
    return source.mapInArrow(run, f"rid long, vec_id {kind}, " + ", ".join(f"{n} {t}" for n, t in types.items()))


AT = ["dims", "t", "key"]
PAIR = [*AT, "p", "q"]


def placed(codes: DataFrame) -> DataFrame:
    """Every code at each of its buckets: table, key, block pair and its own block. Only large buckets are cut."""
    rows = codes.select("rid", "dims", "sides", "code", "factor", "turned", "step", F.posexplode("keys").alias("t", "key"))
    large = rows.groupBy(*AT).agg(F.count(F.lit(1)).alias("g")).where(F.col("g") > BLOCK_ROWS)
    blocks = F.coalesce(F.ceil(F.col("g") / BLOCK_ROWS), F.lit(1)).cast("int")
    met = rows.join(large, AT, "left").withColumn("own", F.pmod(F.xxhash64("rid"), blocks).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return met.select(*AT, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "rid", "own", "sides", "code", "factor", "turned", "step")


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1, count=width)


def met_before(sides: np.ndarray, i: np.ndarray, j: np.ndarray, t: int, bits: int) -> np.ndarray:
    """Do the pairs share the key of a table before ``t``?"""
    if not t or not len(i):
        return np.zeros(len(i), bool)
    early = sides[:, : t * bits].reshape(len(sides), t, bits)
    return (early[i] == early[j]).all(axis=2).any(axis=1)


def by_pairs(places: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``work(block pair, members)`` over the members (``columns``) of every block pair; it gives rows of ``schema``."""
    names = [f.split()[0] for f in schema.split(", ")]
    ints = {"int": pa.int32(), "long": pa.int64()}
    kinds = [ints[f.split()[1]] for f in schema.split(", ")]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, []
        for b in (x for batch in batches for x in slices(batch)):
            found: list[tuple] = []
            c = b.to_pydict()
            for row in zip(*(c[x] for x in [*PAIR, *columns]), strict=True):
                if row[:5] != at:
                    if len(members) > 1:
                        found += work(at, members)
                    at, members = row[:5], []
                members.append(row[5:])
            yield rows(found)
        yield rows(work(at, members) if len(members) > 1 else [])

    return places.select(*PAIR, *columns).repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(run, schema)


def halves(at: tuple, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members on either side of a block pair."""
    left = np.flatnonzero(own == at[3])
    return left, left if at[3] == at[4] else np.flatnonzero(own == at[4])


def opened(places: DataFrame, least: float, bits: int) -> DataFrame:
    """Members of block pairs that have a pair whose bounds reach ``least``."""

    def work(at: tuple, members: list[tuple]) -> list[tuple]:
        dims, t, _, p, q = at
        rid, own, sides, code, factor, turned, step = (list(c) for c in zip(*members, strict=True))
        own, f, step = np.array(own), np.array(factor), np.array(step)
        sides = unpacked(sides, 8 * len(sides[0]))
        signs = unpacked(code, dims).astype(np.float32) * 2 - 1
        small = np.frombuffer(b"".join(turned), np.int8).reshape(len(members), dims).astype(np.float32)
        root = math.sqrt(dims)
        slack = EPS * np.sqrt(np.maximum(1 / f**2 - 1, 0)) / math.sqrt(max(dims - 1, 1))  # of the estimate by one's own code
        rounding = step * root / 2  # of one's own turned vector
        left, right = halves(at, own)
        hit = np.zeros(len(members), bool)
        for a in range(0, len(left), 512):
            x = left[a : a + 512]
            one = ((small[x] @ signs[right].T) * (step[x] / root)[:, None] + rounding[x, None]) / f[right] + slack[right]
            maybe = one >= least
            two = ((signs[x] @ small[right].T) * (step[right] / root) + rounding[right]) / f[x, None] + slack[x, None]
            i, j = np.nonzero(maybe & (two >= least))
            i, j = x[i], right[j]
            if p == q:
                i, j = i[i < j], j[i < j]
            for c in range(0, len(i), 1 << 17):
                ii, jj = i[c : c + (1 << 17)], j[c : c + (1 << 17)]
                new = ~met_before(sides, ii, jj, t, bits)
                hit[ii[new]] = hit[jj[new]] = True
        return [(*at, int(own[k]), rid[k]) for k in np.flatnonzero(hit)]

    return by_pairs(places, ["rid", "own", "sides", "code", "factor", "turned", "step"], work, "dims int, t int, key long, p int, q int, own int, rid long")


def near(x: np.ndarray, y: np.ndarray, turn: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of x, j of y) with cosine >= least, confirmed in double precision. Rows have any length but zero."""
    d = x.shape[1]
    xl, yl = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    xr, yr = (x / xl[:, None]) @ turn, (y / yl[:, None]) @ turn
    xs, ys = np.where(xr > 0, 1.0, -1.0) / math.sqrt(d), np.where(yr > 0, 1.0, -1.0) / math.sqrt(d)
    fx, fy = (xr * xs).sum(axis=1), (yr * ys).sum(axis=1)
    ex, ey = (EPS * np.sqrt(np.maximum(1 / f**2 - 1, 0)) / math.sqrt(max(d - 1, 1)) for f in (fx, fy))
    for a in range(0, len(x), 512):
        b = slice(a, a + 512)
        maybe = (xr[b] @ ys.T) / fy + ey >= least
        maybe &= (xs[b] @ yr.T) / fx[b, None] + ex[b, None] >= least
        i, j = np.nonzero(maybe)
        for c in range(0, len(i), 1 << 17):
            ii, jj = i[c : c + (1 << 17)] + a, j[c : c + (1 << 17)]
            good = np.einsum("ij,ij->i", x[ii], y[jj]) / (xl[ii] * yl[jj]) >= least
            yield ii[good], jj[good]


def linked(places: DataFrame, least: float, bits: int) -> DataFrame:
    """Rows (a, b, n): with b null, n further links of a (by the others' weights); else a spanning link."""
    turns: dict[int, np.ndarray] = {}

    def work(at: tuple, members: list[tuple]) -> list[tuple]:
        dims, t, _, p, q = at
        if dims not in turns:
            turns[dims] = rotation(dims)
        rid, own, sides, weight, vector = (list(c) for c in zip(*members, strict=True))
        sides, weight = unpacked(sides, 8 * len(sides[0])), np.array(weight, np.int64)
        left, right = halves(at, np.array(own))
        v = np.frombuffer(b"".join(vector)).reshape(len(members), dims)
        count, f, out = np.zeros(len(members), np.int64), Forest(), []
        for i, j in near(v[left], v[right], turns[dims], least):
            i, j = left[i], right[j]
            if p == q:
                i, j = i[i < j], j[i < j]
            new = ~met_before(sides, i, j, t, bits)
            i, j = i[new], j[new]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if f.join(x, y):
                    out.append((rid[x], rid[y], 0))
        out += [(rid[k], None, int(count[k])) for k in np.flatnonzero(count)]
        return out

    return by_pairs(places, ["rid", "own", "sides", "weight", "vector"], work, "a long, b long, n long")


def near_copies(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    bits, tables = tables_for(vectors.count(), least)
    codes = written(signed(vectors, bits, tables), "codes")
    classes = codes.where("dims is not null").groupBy("dims", "same").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("weight"))
    members = codes.select("rid", "vec_id", "dims", "same").join(classes, ["dims", "same"], "left")
    members = written(members.select("rid", "vec_id", F.coalesce("rep", "rid").alias("rep"), F.coalesce("weight", F.lit(1)).alias("weight")), "members")
    first = members.where("rid = rep").select("rid", "weight")
    distinct = codes.where("dims is not null").join(first, "rid")
    open_ = written(opened(placed(distinct), least, bits), "open")
    links = written(linked(open_.join(distinct.select("rid", "sides", "weight", "vector"), "rid"), least, bits), "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(links.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    rows = members.join(counts, "rep", "left").join(roots, "rep", "left")
    rows = written(rows.select("rid", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "rooted")
    least_id = rows.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = rows.join(least_id, "root")
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
