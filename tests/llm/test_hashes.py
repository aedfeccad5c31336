"""Hashes of byte ranges: equal for equal ranges alone, on strings that one polynomial can't tell apart."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

from codelake.llm import byte_bpe, minhash_forest, ngram_join, quality_rules
from codelake.llm.common import hash_segments


def twins(n, a="a", b="b"):
    """A Thue-Morse string of two letters, and the same with both exchanged."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("n", [8, 31, 32, 33, 64, 1024, 2048, 1 << 15])
def test_exchanged_letters_have_another_hash(n):
    x, y = twins(n)
    data = np.frombuffer((x + y + x).encode(), np.uint8)
    h = hash_segments(data, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert h[0] == h[2] != h[1]
    assert bin(int(h[0] ^ h[1])).count("1") > 12


def test_equal_hashes_are_equal_ranges():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 20000).astype(np.uint8)
    starts = rng.integers(0, 19000, 5000)
    ends = starts + rng.integers(1, 300, 5000)
    seen = {}
    for a, b, h in zip(starts, ends, hash_segments(data, starts, ends).tolist(), strict=True):
        assert seen.setdefault(h, data[a:b].tobytes()) == data[a:b].tobytes()


def test_operators_on_twins(spark):
    x, y = twins(2048)
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"{x}\n{y}"), (4, x)], "doc_id bigint, text string")
    for module in (ngram_join, minhash_forest):
        assert {r.doc_id: r.component_id for r in module.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    assert {r.doc_id: r.n_dup_lines for r in quality_rules.ledger(docs).collect()}[3] == 0
    bpe = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.decoded_sha256 for r in bpe} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in ((1, x), (2, y), (3, f"{x}\n{y}"), (4, x))}
