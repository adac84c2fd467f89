import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from asofkit.llm import suffix
from asofkit.llm.common import row_keyed
from asofkit.llm.queries import op5_run_index_dedup


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] += 1
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=30), min_size=1, max_size=8), st.integers(1, 9))
def test_index_streams_matches(strings, length):
    raw = [s.encode() for s in strings]
    got = suffix.repeated_windows(raw, length)
    seen = defaultdict(int)
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] += 1
    for r, g in zip(raw, got):
        assert g.tolist() == [i for i in range(len(r) - length + 1) if seen[r[i : i + length]] > 1]


def test_transform_is_run_compressed():
    one = bytes(np.random.default_rng(1).integers(0, 4, 300, dtype=np.uint8))
    strings = [one] * 40
    offsets = np.arange(41) * 300
    index = suffix.RunIndex(np.frombuffer(b"".join(strings), np.uint8), offsets, 301)
    assert index.runs < 0.05 * index.n
    assert (index.statistics()[: 300] == 300 - np.arange(300)).all()


def test_every_window_is_in_one_segment():
    rng = np.random.default_rng(3)
    for sizes in ([500, 10, 0, 40, 700], [39], [64], [1000]):
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        raw = rng.integers(97, 100, offsets[-1], dtype=np.uint8)
        row, a, b, *_ = suffix.segments(raw, offsets, 64, 16)
        got = sorted((r, s) for r, x, y in zip(row.tolist(), a.tolist(), b.tolist()) for s in range(x, y + 1))
        assert got == [(r, s) for r, n in enumerate(sizes) for s in range(n - 63)]


def corpus(seed, length):
    rng = random.Random(seed)
    letters = "abcdefgh é"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, line = text(length + 40), text(length)
    docs = [None, "", text(10), "z" * (3 * length), "z" * (length + 1), passage, text(50) + passage + text(30), passage[:-1], text(400), line + text(5) + line]
    docs += [text(rng.randrange(5, 90)) + passage[rng.randrange(30) :] + text(20) for _ in range(25)]
    long = text(900)
    docs += [long, long, long[:450] + "#" + long[450:], "x" + long[100:], ("ab" * 300), long[300:300 + length], long[300:299 + length]]
    return docs


@pytest.mark.parametrize("hot", [50_000, 3])
def test_against_brute_force(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(suffix, "GROUP_SEGMENTS", hot)
    monkeypatch.setattr(suffix, "INDEX_BYTES", 2000)
    texts = corpus(hot, 64)
    path = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    docs = row_keyed(spark.read.parquet(path), "file", "pos")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(docs, 64).collect()}
    want = brute(texts, 64)
    assert [got[i] for i in range(len(texts))] == want


def test_stage(spark):
    p = "0123456789é" * 40
    docs = spark.createDataFrame([(1, "own words " + p, 1), (2, p + " more", 2), (2, "short", 3), (2, "short", 3), (None, None, 4)], "doc_id long, text string, a long").selectExpr("*", "'f' as file")
    got = suffix.stage(spark, docs, "")
    assert got.columns == docs.columns
    texts = sorted((r.text or "") for r in got.collect())
    assert texts[:1] == [""] and "short" in texts and len(texts) == 5 and all(len(t) < 60 for t in texts)
    assert suffix.stage(spark, docs.limit(0), "").count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = brute([t for _, t in docs], 200)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_run_index_dedup(spark, sf).collect()}
    assert [got[d] for d, _ in docs] == want


def test_equal_windows_have_equal_segments_in_blocks_of_any_length(monkeypatch):
    """Ties between grams must fall alike in a short and a long block, also when hashes differ in their low bits only."""
    from asofkit.llm import suffix

    mix = suffix.mix
    monkeypatch.setattr(suffix, "mix", lambda x: mix(x) & np.uint64(0x3FFFFF))
    rng = np.random.default_rng(8)
    text, rest = rng.integers(97, 123, 900).astype(np.uint8), rng.integers(97, 123, 300_000).astype(np.uint8)
    short = suffix.segments(text, np.array([0, len(text)]))
    long = suffix.segments(np.concatenate([text, rest]), np.array([0, len(text), len(text) + len(rest)]))
    mine = long[0] == 0
    assert len(short[0]) == mine.sum() > 0
    assert all((a == b[mine]).all() for a, b in zip(short, long, strict=True))
