import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from asofkit.llm.bpe import Encoder, PerfectHash, encode_column, merge_bytes, read_ranks
from asofkit.llm.queries import op1_byte_bpe

RANKS = read_ranks(P.path("byte_bpe_50k.tiktoken"))
OURS = Encoder(RANKS, P.PATTERN)
THEIRS = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_perfect_hash_is_minimal_and_perfect():
    keys = list(RANKS)
    slots = PerfectHash(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert [OURS._slot(k) for k in keys[:500]] == slots[:500].tolist()
    assert PerfectHash([b"a"]).slots([b"a", b"zz"]).tolist() == [0, 0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sd  \x1f")), max_size=60))
def test_as_the_library_encodes(text):
    ids = OURS.encode(text).tolist()
    assert ids == THEIRS.encode_ordinary(text)
    assert OURS.decode(np.array(ids, np.uint32)) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b", "a \n b", "it's we'll I'D", "x" * 20000, " " * 3000 + "end", "12 345\n\n", "<|endoftext|>", "a　b c"])
def test_odd_texts(text):
    assert OURS.encode(text).tolist() == THEIRS.encode_ordinary(text)


def test_merge_of_a_long_run():
    assert merge_bytes(b"ab" * 5000, RANKS) == THEIRS._core_bpe.encode_single_piece(b"ab" * 5000)


def test_column_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "the cat's", None), (2, "", "x"), (5, "y" * 5000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = encode_column(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["doc_id"], ids=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 5 and sum(r.decoded_sha256 == empty for r in got) == 3
    assert next(r.ids for r in got if r.doc_id is None) == THEIRS.encode_ordinary("the cat's")
    assert encode_column(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["doc_id"]).count() == 0


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op1_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(THEIRS.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
