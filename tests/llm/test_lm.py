import random
import time

import numpy as np
import pytest

from asofkit.llm import lm
from asofkit.llm.queries import op2_masked_pseudo_likelihood


def some(n=40):
    rng = np.random.default_rng(0)
    return rng.integers(0, lm.TOKENS, n), np.array([n // 2, 0, n - n // 2])


def test_windows():
    near = lm.windows(np.array([5, 6, 7, 8]), np.array([3, 1]))
    t = lm.TOKENS
    assert [n.tolist() for n in near] == [[t, t, 5, t], [t, 5, 6, t], [6, 7, t, t], [7, t, t, t]]


def test_probabilities_sum_to_one():
    p = lm.start()
    near = [np.full(lm.TOKENS, k) for k in (3, 9, lm.TOKENS, 77)]
    assert np.exp(lm.log_probabilities(p, np.arange(lm.TOKENS), near)).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_by_difference():
    p = {k: v.astype(np.float64) for k, v in lm.start().items()}
    tokens, counts = some()
    near = lm.windows(tokens, counts)
    g = lm.gradients(p, tokens, near)
    rng = np.random.default_rng(1)
    for k in p:
        flat = p[k].reshape(-1)
        touched = np.flatnonzero(g[k].reshape(-1)) if k == "places" else np.arange(flat.size)
        for i in rng.choice(touched, 5):
            old, loss = flat[i], []
            for d in (1e-5, -1e-5):
                flat[i] = old + d
                loss.append(-lm.log_probabilities(p, tokens, near).mean())
            flat[i] = old
            assert g[k].reshape(-1)[i] == pytest.approx((loss[0] - loss[1]) / 2e-5, rel=1e-3, abs=1e-7)


def test_order_matters_after_training(spark):
    """Held-out texts of a language with order score better than the same words shuffled."""
    rng = random.Random(2)
    follow = {f"w{i}": [f"w{(7 * i + k) % 50}" for k in (1, 2)] for i in range(50)}

    def text():
        w = [f"w{rng.randrange(50)}"]
        while len(w) < 300:
            w.append(rng.choice(follow[w[-1]]))
        return w

    train = [(i, " ".join(text())) for i in range(300)]
    held = []
    for i in range(20):
        w = text()
        held += [(i, " ".join(w)), (100 + i, " ".join(rng.sample(w, len(w))))]
    p = lm.trained(spark.createDataFrame(train, "doc_id long, text string").repartition(2))
    got = {r.doc_id: r.mean_log_likelihood for r in lm.scored(spark.createDataFrame(held, "doc_id long, text string"), p, ["doc_id"]).collect()}
    assert sum(got[i] > got[100 + i] + 0.3 for i in range(20)) >= 19


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, "word", 2), (3, "word", 2), (4, "a b " * 40000, 2), (None, "x!", 1)], "doc_id long, text string, n_tokens int")
    p = lm.trained(docs)
    got = lm.scored(docs, p, ["doc_id"]).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].n_tokens == 0 and by[1].log_likelihood == 0 and by[1].mean_log_likelihood is None
    assert by[4].n_tokens == 80000 and by[None].n_tokens == 2 and by[3].log_likelihood < 0
    empty = docs.limit(0)
    assert lm.scored(empty, lm.trained(empty), ["doc_id"]).count() == 0


def test_query_against_plain_sum(spark):
    """The query's sums are those of a token-by-token walk with the trained network."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    p = lm.trained(docs)
    got = {r.doc_id: r for r in op2_masked_pseudo_likelihood(spark, sf).collect()}
    import pyarrow as pa

    for r in docs.orderBy("doc_id").limit(3).collect():
        (_, _, tokens, counts), = lm.token_blocks(pa.array([r.text]))
        want = 0.0
        for i in range(len(tokens)):
            near = [np.array([tokens[i + d] if 0 <= i + d < len(tokens) else lm.TOKENS]) for d in (-2, -1, 1, 2)]
            want += float(lm.log_probabilities(p, tokens[i : i + 1], near)[0])
        assert got[r.doc_id].log_likelihood == pytest.approx(want, rel=1e-4)
    assert len(got) == 200


def test_rare_words_take_no_frequent_words_probability(spark):
    """Made-up words, any of whose hashed ids would fall on a trained word, score far below clean text; the vocabulary grows with the corpus."""
    rng = random.Random(5)
    clean = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    train = [(i, clean(300)) for i in range(200)]
    docs = spark.createDataFrame(train, "doc_id long, text string").repartition(2)
    p = lm.trained(docs)
    half = lm.with_vocabulary(spark.createDataFrame([(i, t.replace("w2", "v")) for i, t in train[:20]], "doc_id long, text string"))
    assert len(p["words"]) > 2 * len(half["words"]) > 0 and len(p["vectors"]) == len(p["words"]) + 2
    junk = lambda n: " ".join("".join(rng.choice("bcdfgqxz") for _ in range(7)) for _ in range(n))
    held = [(i, clean(100) if i % 2 else junk(100)) for i in range(20)]
    got = {r.doc_id: r.mean_log_likelihood for r in lm.scored(spark.createDataFrame(held, "doc_id long, text string"), p, ["doc_id"]).collect()}
    assert max(got[i] for i in range(0, 20, 2)) + 5 < min(got[i] for i in range(1, 20, 2))


def zipf_texts(n=60_000, ids=80_000):
    rng = np.random.default_rng(4)
    tokens = np.minimum((rng.pareto(0.6, n) * 3).astype(np.int64), ids - 1)
    cuts = np.sort(rng.integers(0, n, 90))
    return tokens, np.diff(np.concatenate([[0], cuts, [n]]))


def test_stretches_have_the_gradients_of_single_places():
    """Sums by place and by one order of the ids are those of every neighbour added on its own; scores too."""
    ids = 700
    p = {k: v.astype(np.float64) for k, v in lm.start(ids).items()}
    tokens, _ = zipf_texts(5000, ids)
    counts = np.array([0, 1, 2, 0, 0, 2500, 3, 1494, 1000, 0])
    near = lm.windows(tokens, counts, ids)
    seen = 0
    for b, line, at in lm.stretches(*lm.lined(tokens, counts, ids)):
        got, want = lm.line_gradients(p, line, at), lm.gradients(p, tokens[b], [n[b] for n in near])
        assert set(got) == set(want)
        for k in got:
            whole = got[k]
            if k in lm.TABLES:
                whole = np.zeros_like(p[k])
                whole[got[k][0]] = got[k][1]
            assert whole == pytest.approx(want[k], rel=1e-9, abs=1e-15), k
        seen += len(at)
    assert seen == len(tokens)
    assert lm.of_texts(p, tokens, counts) == pytest.approx(lm.of_ids(p, tokens, near), rel=1e-12)


def test_large_weights_stay_finite():
    """Weights whose exponents leave the numbers' range: sums to one, and gradients, as with the largest taken off."""
    p = lm.start()
    for k in ("first", "second", "third"):
        p[k] *= 3000
        p[f"{k}_base"] += np.linspace(-200, 200, lm.CODES, dtype=np.float32)
    near = [np.full(lm.TOKENS, k) for k in (3, 9, lm.TOKENS, 77)]
    assert np.exp(lm.log_probabilities(p, np.arange(lm.TOKENS), near)).sum() == pytest.approx(1, abs=1e-3)
    assert all(np.isfinite(v).all() for v in lm.gradients(p, np.arange(lm.TOKENS), near).values())


def test_words_are_found_among_equal_leading_bits():
    rng = np.random.default_rng(3)
    top = np.int64(1 << 62)
    for n in (0, 1, 2, 500):
        words = np.unique(np.concatenate([top | rng.integers(0, 1 << 62, n), top + np.arange(n), np.int64((1 << 63) - 1) - np.arange(n)]).astype(np.int64))
        p = {"words": words, "word_ids": rng.permutation(len(words)) + 1, "word_places": lm.places_of(words), "vectors": np.zeros((len(words) + 2, 1))}
        asked = np.concatenate([words, words[:-1] + 1, [top, lm.TOKENS]]).astype(np.int64)
        ids = dict(zip(words.tolist(), p["word_ids"].tolist(), strict=True)) | {lm.TOKENS: len(words) + 1}
        assert lm.known(p, asked).tolist() == [ids.get(w, 0) for w in asked.tolist()]


def test_training_costs_little_more_than_its_products():
    """CPU time of training against that of the matrix products and exponents which no order of the work can spare."""
    ids = 80_000
    p, (tokens, counts) = lm.start(ids), zipf_texts(ids=ids)
    c, rng = len(p["given"]), np.random.default_rng(0)
    h, w = rng.normal(size=(lm.BATCH, lm.DIMS)).astype(np.float32), rng.normal(size=(lm.DIMS, c)).astype(np.float32)

    def spent(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    def least():
        for _ in range(3 * len(tokens) // lm.BATCH):
            z = w.T @ h.T
            np.exp(z, out=z)
            (z @ h, z.T @ w.T)

    both = [(spent(lambda: lm.Trainer(p).text(tokens, counts)), spent(least)) for _ in range(5)]
    train, products = map(min, zip(*both, strict=True))
    assert train < 4 * products
