"""Ids against the plain library call, and the exact round trip."""

import base64
import hashlib

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from codelake.llm import byte_bpe as B

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "\n\n", "a", "  two  blanks ", "é ü ß", "tab\tand\u00a0hard\u2003blank x", "it's 12ab 3'll", "x" * 70000, "ab " * 40000, "12ab" * 20000,
         "\u0085 y", "a\u0085 b", "日本 語 ", "😀 😀", "end \n", "\r\n x", "q <|endoftext|> q", "\x1c a\x1d b"]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def own():
    return B.codec(open(RANKS, "rb").read(), P.PATTERN)


def test_digests_and_round_trip(spark, plain):
    rows = list(enumerate(TEXTS * 2))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'old' AS n_tokens")
    got = {r.doc_id: r for r in B.round_trip(df, RANKS, P.PATTERN).collect()}
    for k, t in rows:
        ids = plain.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert B.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_encode_then_decode_columns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    back = B.decode(B.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1 '\n\t.é\u00a0\u0085\u2003日s"))), max_size=4))
def test_any_text(texts):
    bpe = own()
    ids, _ = B.encode_texts(bpe, pa.array(texts, pa.string()))
    assert [x.tolist() for x in ids] == [bpe.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1 '\n.é\u00a0")), max_size=60), st.integers(1, 9))
def test_pieces_join_to_the_ids_of_the_whole(text, size):
    bpe = own()
    assert [x for p in B.pieces(text, size) for x in bpe.encode_ordinary(p)] == bpe.encode_ordinary(text)
