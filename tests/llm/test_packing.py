"""Best fit against a slow bin-by-bin search, and what every packing must hold."""

import random

import pytest

from codelake.llm import packing as K


def slow(lengths, capacities, cost):
    bins, out = [], []
    for n in lengths:
        fits = [(room - n, -used_at, b) for b, (room, used_at) in enumerate((size - used, opened) for size, used, opened in bins) if room >= n]
        best = min(fits)[0] if fits else None
        out.append(best)
        if best is None:
            size = min((c for c in capacities if c >= n), key=lambda c: (cost(c) / c, c))
            bins.append([size, n, len(bins)])
        else:
            b = min(fits)[2]
            bins[b][1] += n
    return out, sorted((next(c for c in sorted(capacities) if c >= used), used) for _, used, _ in bins)


@pytest.mark.parametrize("seed", range(6))
def test_same_fits_as_a_slow_search(seed):
    random.seed(seed)
    caps = (16, 32, 64)
    lengths = sorted((random.randrange(1, 65) for _ in range(200)), reverse=True)
    placed = K.best_fit(lengths, caps, K.sequence_cost)
    used = {}
    for (b, offset, cap), n in zip(placed, lengths, strict=True):
        assert offset == used.setdefault(b, [cap, 0])[1]
        used[b][1] += n
    assert sorted(map(tuple, used.values())) == slow(lengths, caps, K.sequence_cost)[1]


def test_whole_rows_and_no_overlap(spark):
    random.seed(9)
    rows = [(k, random.randrange(0, 60)) for k in range(400)] + [(7, 30), (7, 30), (None, 200), (None, None), (900, 1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").selectExpr("*", "'old' AS bin_id")
    got = K.pack(df, "n_tokens", (16, 32, 64), pieces_per_shard=50).collect()
    assert sum(r.piece_len for r in got) == sum(n or 0 for _, n in rows)
    assert sum(r.piece_start == 0 for r in got) == len(rows)
    bins = {}
    for r in got:
        if r.bin_id is None:
            assert (r.piece_len, r.capacity) == (0, 0)
        else:
            bins.setdefault(r.bin_id, []).append((r.bin_offset, r.piece_len, r.capacity))
    for parts in bins.values():
        at = 0
        for offset, n, cap in sorted(parts):
            assert offset == at
            at += n
        assert at <= cap and cap == min(c for c in (16, 32, 64) if c >= at) and len({p[2] for p in parts}) == 1
    assert K.pack(df.limit(0), "n_tokens").count() == 0


def test_a_piece_that_fits_nowhere_is_refused():
    with pytest.raises(ValueError):
        K.best_fit([9], (4, 8))


def test_word_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a  b\tc\n"), (4, "é " * 50000)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in K.word_counts(df).collect()} == {1: 0, 2: 0, 3: 3, 4: 50000}
