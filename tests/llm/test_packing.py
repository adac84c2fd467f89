from zlib import crc32

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from asofkit.llm import packing
from asofkit.llm.queries import op6_swap_packing

PATH = P.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
OURS = packing.Tokens(PATH, P.PATTERN)


def ids(text):
    return THEIRS.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n'sd")), max_size=50))
def test_ids(text):
    assert np.frombuffer(OURS.ids(text), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|>x", "<|endoftext|", "a  b\n\n c ", ""])
def test_odd_ids(text):
    assert np.frombuffer(OURS.ids(text), "<u4").tolist() == ids(text)


def squares(fill):
    return sum(f * f for f in fill)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=120))
def test_exchange_raises_squares_and_keeps_items(sizes):
    s = np.array(sizes)
    bins, fill = packing.best_fit(s, 100)
    before, n = squares(fill), sum(1 for f in fill if f)
    packing.exchange(s, bins, fill, 100)
    assert sorted(k for b in bins for k in b) == list(range(len(s)))
    assert all(s[b].sum() == f <= 100 for b, f in zip(bins, fill))
    assert squares(fill) >= before and sum(1 for f in fill if f) <= n


@pytest.mark.parametrize("sizes, bins, least", [([60, 50, 40, 30, 20], [[0, 3], [1, 2], [4]], 2), ([55, 50, 45, 50], [[0], [1, 2], [3]], 2), ([40, 30, 25, 60, 30, 15], [[3, 4], [0, 1, 5], [2]], 2)])
def test_exchanges_empty_a_bin(sizes, bins, least):
    s = np.array(sizes)
    fill = [int(s[b].sum()) for b in bins]
    packing.exchange(s, bins, fill, 100)
    assert sum(1 for f in fill if f) == least


def checked(rows, texts, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, got in by_doc.items():
        want = [*ids(texts[d] or ""), 0]
        got.sort(key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(want) // capacity)))
        for r in got:
            assert r.ids_crc32 == crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in got) == len(want) and all(r.length == capacity for r in got[1:])
    for got in by_seq.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), sum(r.length for r in rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n, total = checked(op6_swap_packing(spark, sf).collect(), texts, 2048)
    assert n <= -(-total // 2048) + 1


def test_cases_and_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 40)), "x") for i in range(300)] + [(900, None, "x"), (901, "", "x"), (902, "long " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    cut = packing.written(packing.pieces(docs, PATH, P.PATTERN, 0, 64), "pieces")
    n, total = checked(packing.packed(cut, 64, group=50).collect(), {r[0]: r[1] for r in rows}, 64)
    assert n <= -(-total // 64) * 1.02 + 2
    assert packing.pack_documents(docs.limit(0), PATH, P.PATTERN).count() == 0
    twice = packing.pack_documents(docs.where("doc_id = 901").union(docs.where("doc_id = 901")), PATH, P.PATTERN).collect()
    assert [r.offset for r in sorted(twice, key=lambda r: r.offset)] == [0, 1]
