import numpy as np
import pytest

from asofkit.llm import rabitq
from asofkit.llm.queries import op9_binary_code_near_dedup


def brute(ids, vectors, least):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n, up = [0] * len(ids), list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    n[i] += 1
                    n[j] += 1
                    x, y = root(i), root(j)
                    up[max(x, y)] = min(x, y)
    low = {}
    for i in range(len(ids)):
        low[root(i)] = min([x for x in (low.get(root(i)), ids[i]) if x is not None], default=None)
    return [(ids[i], n[i], low[root(i)]) for i in range(len(ids))]


def sample():
    rng = np.random.default_rng(4)
    out = []
    for _ in range(60):
        c = rng.normal(size=32)
        out += [list(map(float, c * rng.uniform(0.5, 3) + rng.normal(size=32) * s)) for s in (0, 0.1, 0.2, 0.3)]
    hot = rng.normal(size=32)
    out += [list(map(float, hot + rng.normal(size=32) * 0.15)) for _ in range(80)]
    return out + out[:3]


@pytest.mark.parametrize("block", [2048, 9])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(rabitq, "BLOCK_ROWS", block)
    monkeypatch.setattr(rabitq, "BUCKET", 20)
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, [float("inf")] + [0.0] * 31, [1.0, 2.0], [2.0, 4.0], [1e300] + [1e299] * 31, [1e-300] + [1e-301] * 31]
    vectors = sample() + odd
    ids = list(range(len(vectors) - 1)) + [None]
    df = spark.createDataFrame(list(zip(ids, vectors, [1] * len(ids))), "vec_id long, embedding array<double>, n int").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in rabitq.near_copies(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    with np.errstate(all="ignore"):
        vectors = [v if v is None or not v or None in v else [x / max(map(abs, v)) if max(map(abs, v)) not in (0.0, float("inf")) else x for x in v] for v in vectors]
    want = brute(ids, vectors, 0.9)
    wanted, found = sum(w[1] for w in want), sum(g[1] for g in got)
    assert found <= wanted and found >= 0.99 * wanted
    assert sum(g == w for g, w in zip(got, want)) >= 0.98 * len(want)
    assert rabitq.near_copies(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    d, turn = 64, rabitq.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(d))
    x = rng.normal(size=(400, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[:200] * 0.9 + x[200:] * 0.436
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    yr = y @ turn
    s = np.where(yr > 0, 1, -1) / np.sqrt(d)
    f = (yr * s).sum(axis=1)
    estimate = ((x[:200] @ turn) * s).sum(axis=1) / f
    error = estimate - (x[:200] * y).sum(axis=1)
    bound = np.sqrt(1 / f**2 - 1) / np.sqrt(d - 1)
    assert abs(error.mean()) < 0.02 and (np.abs(error) < rabitq.EPS * bound).all()


def test_tables_grow_slowly():
    assert rabitq.tables_for(10, 0.9)[0] == 1
    b1, t1 = rabitq.tables_for(10**5, 0.9)
    b2, t2 = rabitq.tables_for(10**9, 0.9)
    assert b2 - b1 == pytest.approx(13, abs=1) and t2 < 10 * t1


def test_query_recall(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = [r.vec_id for r in rows]
    want = {w[0]: w for w in brute(ids, [r.embedding for r in rows], 0.9)}
    got = op9_binary_code_near_dedup(spark, sf).collect()
    assert len(got) == len(ids)
    assert sum(r.n_links for r in got) >= 0.99 * sum(w[1] for w in want.values())
    assert all(r.n_links <= want[r.vec_id][1] and r.kept == (r.vec_id == r.component_id) for r in got)


def test_equal_vectors_fold(spark):
    rng = np.random.default_rng(6)
    c = rng.normal(size=32)
    vectors = [list(map(float, c))] * 1500 + [list(map(float, c * 2))] * 500 + [list(map(float, c + rng.normal(size=32) * 0.1))] + [list(map(float, rng.normal(size=32)))] * 2
    df = spark.createDataFrame([(i, v, "x", 0.5) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, same string, code double").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rabitq.near_copies(df).collect()}
    assert all(got[i] == (2000, 0, i == 0) for i in range(2001))
    assert got[2001] == (1, 2001, True) and got[2002] == (1, 2001, False)


def test_codes_open_every_pair_that_links(spark):
    """The bound from codes and bytes alone never closes a pair at the threshold."""
    df = spark.createDataFrame(list(enumerate(sample())), "vec_id long, embedding array<double>")
    codes = rabitq.signed(df, 1, 1)
    rows = codes.collect()
    v = {r.rid: np.frombuffer(r.vector) for r in rows}
    unit = {k: x / np.linalg.norm(x) for k, x in v.items()}
    open_ = {r.rid for r in rabitq.opened(rabitq.placed(codes), 0.9, 1).collect()}
    key = {r.rid: r["keys"][0] for r in rows}
    for a in v:
        for b in v:
            if a < b and key[a] == key[b] and unit[a] @ unit[b] >= 0.9:
                assert a in open_ and b in open_
    r = rows[0]
    turned = unit[r.rid] @ rabitq.rotation(32)
    assert np.abs(np.frombuffer(r.turned, np.int8) * r.step - turned).max() <= r.step / 2 + 1e-12
    assert r.factor == pytest.approx(np.abs(turned).sum() / 32**0.5)
