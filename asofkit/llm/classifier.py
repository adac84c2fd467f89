"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word (hashed to a bucket of a documented number) has a fixed sparse
random index vector; its word vector is the sum of the index vectors of its
neighbours over the whole corpus, summed per task and then per block of
buckets. A document is the mean and the spread of its words' vectors. A network
with one hidden layer is trained in numpy on a bounded sample of labelled rows;
a temperature fitted on rows held back from training calibrates it.

Cases: a null or empty text has the zero vector and a score; very long texts are
pooled whole; repeated rows get equal scores; no labels, or one class only, give
every row that share as its score; an empty table gives an empty result; labels,
lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import blocks, mix, slices, table, views, written
from asofkit.llm.shingles import P_INV, powers, prefix

BUCKETS, DIMS, BLOCK_BUCKETS = 1 << 15, 32, 1 << 10
#: Nonzero entries of an index vector.
NONZERO = 6
#: Labelled rows that the network sees at most: those with the smallest hashed ids.
SAMPLE_ROWS = 40_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-5
THRESHOLD = 0.3

KIND = np.full(256, 1, np.uint8)  # letters, digits and all bytes of longer characters
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(5)
    r = np.zeros((BUCKETS, DIMS), np.int32)
    at = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    np.put_along_axis(r, at, rng.choice(np.array([-1, 1], np.int32), (BUCKETS, NONZERO)), axis=1)
    return r


def buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket per word, words per row): runs of letters or of signs, case kept."""
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
    return (h % np.uint64(BUCKETS)).astype(np.uint16), np.diff(np.searchsorted(starts, offsets))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all buckets from all of ``docs``; the driver holds BUCKETS * DIMS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, r = np.zeros((BUCKETS, DIMS), np.int64), index_vectors()
        for batch in batches:
            raw, offsets = views(batch.column("text"))
            for a, b in blocks(offsets):
                base = offsets[a]
                w, n = buckets(raw[base : offsets[b]], offsets[a : b + 1] - base)
                row = np.repeat(np.arange(len(n)), n)
                near = row[1:] == row[:-1]
                for centre, other in ((w[:-1][near], w[1:][near]), (w[1:][near], w[:-1][near])):
                    if len(centre):
                        order = np.argsort(centre, kind="stable")
                        s = centre[order]
                        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                        total[s[first]] += np.add.reduceat(r[other[order]], first, axis=0)
        parts = range(BUCKETS // BLOCK_BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([total[i * BLOCK_BUCKETS : (i + 1) * BLOCK_BUCKETS].astype(np.int64).tobytes() for i in parts], pa.binary())], ["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("sums"), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.int64)
                held[part] = held[part] + x if part in held else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "sums"])

    schema = "part int, sums binary"
    counted = docs.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema)
    total = np.zeros((BUCKETS // BLOCK_BUCKETS, BLOCK_BUCKETS * DIMS))
    for part, sums in written(counted, "vectors").collect():  # one row per block of buckets
        total[part] += np.frombuffer(sums, np.int64)
    v = total.reshape(BUCKETS, DIMS)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return v.astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of every text."""
    raw, offsets = views(column)
    out = np.zeros((len(column), 2 * DIMS), np.float32)
    for a, b in blocks(offsets):
        base = offsets[a]
        w, n = buckets(raw[base : offsets[b]], offsets[a : b + 1] - base)
        some = np.flatnonzero(n)
        if len(some):
            first = (np.cumsum(n) - n)[some]
            v = vectors[w]
            mean = np.add.reduceat(v, first, axis=0) / n[some, None]
            square = np.add.reduceat(v * v, first, axis=0) / n[some, None]
            out[a + some] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))])
    return out


class Network:
    """Two layers with a temperature."""

    def __init__(self, share: float) -> None:
        share = min(max(share, 1e-4), 1 - 1e-4)
        self.mean, self.scale = np.zeros(2 * DIMS, np.float32), np.ones(2 * DIMS, np.float32)
        self.w = [np.zeros((2 * DIMS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array(np.log(share / (1 - share)))]
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> None:
        """Adam on the rows not ``held``, then the temperature on those held."""
        rng = np.random.default_rng(11)
        train, y = np.flatnonzero(~held), y.astype(np.float64)
        self.mean, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
        self.w[0], self.w[2] = rng.normal(0, 0.1, self.w[0].shape), rng.normal(0, 0.1, HIDDEN)
        z = (x - self.mean) / self.scale
        m, s, step = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(train)
            for at in range(0, len(order), BATCH):
                k = order[at : at + BATCH]
                h = np.tanh(z[k] @ self.w[0] + self.w[1])
                e = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -40, 40))) - y[k]) / len(k)
                d = np.outer(e, self.w[2]) * (1 - h * h)
                step += 1
                for i, g in enumerate((z[k].T @ d + DECAY * self.w[0], d.sum(axis=0), h.T @ e, e.sum())):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    rate = RATE * (1 - epoch / EPOCHS)
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        if held.any():
            logit, truth = self.logits(x[held]), y[held]
            grid = np.exp(np.linspace(-1.5, 3, 91))
            loss = [np.mean(np.logaddexp(0, logit / t) - truth * logit / t) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors of all ``docs`` and a network fitted on at most SAMPLE_ROWS labelled rows that are not held out."""
    vectors = word_vectors(docs)
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    sample = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pooled(b.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__label"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "x"])

    known = F.broadcast(sample.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__label")))  # SAMPLE_ROWS at most
    texts = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("__id")).select("__id", "__label", "text")
    kind = labels.schema["doc_id"].dataType.simpleString()
    rows = written(texts.mapInArrow(features, f"id {kind}, label int, x binary").dropDuplicates(["id"]), "features").orderBy("id").collect()
    y = np.array([r.label for r in rows], np.int64)
    net = Network(float(y.mean()) if len(y) else 0.5)
    if len(set(y.tolist())) == 2:
        x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(len(rows), 2 * DIMS)
        held = mix(np.arange(len(y), dtype=np.uint64)) % np.uint64(8) == 0
        if len(set(y[~held].tolist())) == 2:
            net.fit(x, y, held)
    return vectors, net


def scored(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(net.score(pooled(b.column("__text"), vectors)), pa.float64())], [*keep, "score"])

    return source.mapInArrow(run, schema)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored THRESHOLD or better; one pass, no join."""
    shared = spark.sparkContext.broadcast(fitted(docs, table(spark, sf_dir, "labels")))
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for b in (x for batch in batches for x in slices(batch, 1024)):
            yield b.filter(pa.array(net.score(pooled(b.column(at), vectors)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
