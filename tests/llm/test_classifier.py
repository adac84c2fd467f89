import re
from zlib import crc32

import numpy as np
import pyarrow as pa

from asofkit.llm import classifier
from asofkit.llm.common import views
from asofkit.llm.queries import op8_quality_classifier


def test_buckets_follow_words():
    texts = ["Ab cd!! ab", "", "cd|Ab", "é1 x%%% x", "a\nb"]
    w, n = classifier.buckets(*views(pa.array(texts)))
    plain = [re.findall(r"[^\W_]+|[^\w\s]+", t) for t in texts]
    assert n.tolist() == [len(p) for p in plain]
    of = {}
    for b, t in zip(w.tolist(), [t for p in plain for t in p]):
        assert of.setdefault(t, b) == b
    assert len(set(of.values())) == len(of)


def test_word_vectors_by_hand(spark):
    texts = ["a b a", "b c", None, ""]
    v = classifier.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    b = {t: int(classifier.buckets(*views(pa.array([t])))[0][0]) for t in "abc"}
    r = classifier.index_vectors().astype(float)
    want = {"a": 2 * r[b["b"]], "b": 2 * r[b["a"]] + r[b["c"]], "c": r[b["b"]]}
    for t in "abc":
        assert np.allclose(v[b[t]], want[t] / np.linalg.norm(want[t]), atol=1e-6)


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op8_quality_classifier(spark, sf).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    s, y = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    assert auc(s, y) > 0.9 and (s[y == 1] >= 0.3).mean() > 0.97


def test_cases(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "word " * 9000, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = classifier.scored(docs, labels, ["doc_id"]).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    none = classifier.scored(docs, labels.limit(0), ["doc_id"]).collect()
    assert {r.score for r in none} == {0.5}
    assert classifier.scored(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_stage_keeps_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as score")
    got = classifier.stage(spark, docs, sf)
    assert got.columns == docs.columns and 0 < got.count() <= docs.count()
