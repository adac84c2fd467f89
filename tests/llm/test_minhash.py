import random
import re

import numpy as np
import pytest

from asofkit.llm import minhash
from asofkit.llm.common import row_keyed
from asofkit.llm.components import components
from asofkit.llm.queries import op10_tensored_minhash
from asofkit.llm.shingles import shingle_sets


def plain_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def brute(texts, k=4, share=80):
    """component per row number by all pairs."""
    sets = [plain_set(t, k) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))], sets


def test_shingles_match_words():
    texts = ["a b c d e f a b c d", "A b\tC d", "x", "", "  ", "a b c d e", "É é É é", "n " * 50, "ab c", "a bc"]
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = list(shingle_sets(np.frombuffer(raw, np.uint8), offsets, 4))
    assert [len(s) for s in got] == [len(plain_set(t, 4)) for t in texts]
    assert set(got[1]) <= set(got[0]) and set(got[5]) <= set(got[0])
    assert not set(got[8]) & set(got[9])


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    texts = [None, "", "one", "ONE", "two words", "two  words"]
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(8, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    return texts + texts[10:40]


@pytest.mark.parametrize("block", [1024, 7])
def test_against_all_pairs(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    texts = corpus()
    base = [f"h{i}" for i in range(120)]
    rng = random.Random(5)
    for _ in range(60):  # a large group of near-copies of one text
        copy = list(base)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    want, sets = brute(texts)
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rep string").repartition(3).write.parquet(path)
    docs = row_keyed(spark.read.parquet(path), "file", "pos")
    got = {r.doc_id: r for r in minhash.grouped(docs).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_cases_and_stage(spark):
    rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 2), (7, "a b c d e f", 3), (7, "a b c d e f", 3), (8, None, 4), (9, "", 5), (10, "q r s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file int").selectExpr("*", "'k' as kept", "1 as pos", "'r' as rep")
    left = minhash.stage(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [7, 8, 9, 10]
    assert minhash.stage(spark, docs.limit(0), "").count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: root(x) for e in edges for x in e if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want, sets = brute([t for _, t in docs])
    got = {r.doc_id: r for r in op10_tensored_minhash(spark, sf).collect()}
    for i, (d, _) in enumerate(docs):
        assert (got[d].component_id, got[d].n_shingles) == (docs[want[i]][0], len(sets[i]))
