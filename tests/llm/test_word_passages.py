"""Passages that documents share against a plain count of all their runs of words."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from codelake.llm import word_passages as W
from codelake.llm.suffix_dedup import op3, remove_repeats


def plain(docs, over_words):
    """(id, passages, bytes) by every run of words and the rows that hold it."""
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t in docs]
    holders = defaultdict(set)
    runs = []
    for k, (_, t) in enumerate(docs):
        words = [(t or "").encode()[a:b] for a, b in spans[k]]
        runs.append([tuple(words[i : i + over_words + 1]) for i in range(len(words) - over_words)])
        for r in runs[-1]:
            holders[r].add(k)
    out = []
    for k, (i, _) in enumerate(docs):
        found = []
        for at, r in enumerate(runs[k]):
            if len(holders[r]) > 1:
                a, b = spans[k][at][0], spans[k][at + over_words][1]
                if found and a <= found[-1][1]:
                    found[-1][1] = b
                else:
                    found.append([a, b])
        out.append((i, len(found), sum(b - a for a, b in found)))
    return sorted(out)


@pytest.mark.parametrize("seed, over_words, compared", [(0, 6, 2_000_000), (1, 6, 50), (2, 1, 2_000_000), (3, 50, 2_000_000)])
def test_shared_passages(spark, monkeypatch, seed, over_words, compared):
    monkeypatch.setattr(W, "COMPARED", compared)
    random.seed(seed)
    letters = [f"é{k}" if k % 3 == 0 else f"w{k}" for k in range(3 if seed == 1 else 40)]
    prose = lambda n: random.choice([" ", "\n", " \t"]).join(random.choice(letters) for _ in range(n))
    passages = [prose(n) for n in (over_words, over_words + 1, over_words + 2, 3 * over_words)]
    docs = [(k, " ".join([prose(random.randrange(40)), random.choice([*passages, ""]), prose(random.randrange(2, 25)), random.choice([*passages, "", ""])])) for k in range(90)]
    own = prose(over_words + 3)
    docs += [(200, None), (201, ""), (202, docs[0][1]), (203, docs[0][1]), (203, docs[0][1]), (204, "a " * 3000), (205, "b " * 300), (206, "b " * 200 + "c"), (207, f"{own} x {own}"), (208, prose(over_words)), (209, " \n ")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = remove_repeats(df, with_text=False, shared_words=over_words).collect()
    assert sorted((r.doc_id, r.n_passages, r.n_passage_bytes) for r in got) == plain(docs, over_words)


def test_short_words_in_the_query(spark, tmp_path):
    """51 short words that two documents share are found, though they have fewer than 400 bytes; 50 aren't, nor what one text repeats in itself."""
    short = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    docs = [(1, f"one {short('a', 51)} two"), (2, f"three\n{short('a', 51)} four"), (3, f"five {short('b', 50)} six"), (4, f"seven {short('b', 50)} eight"), (5, f"{short('c', 51)} x {short('c', 51)}"), (6, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_passages, r.n_passage_bytes) for r in op3(spark, str(tmp_path)).collect()}
    size = len(short("a", 51))
    assert size < 200
    assert got == {1: (0, 1, size), 2: (0, 1, size), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 0, 0), 6: (0, 0, 0)}


def test_empty_table_and_old_names(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, n_passages string, wants int, size int, h int")
    out = remove_repeats(df, with_text=False, shared_words=50)
    assert out.count() == 0 and dict(out.dtypes)["n_passages"] == "bigint" and {"wants", "size", "h"} <= set(out.columns)


def test_chained_hashes_tell_order_and_width():
    h = np.random.default_rng(1).integers(0, 1 << 63, 200, dtype=np.uint64)
    for width in (1, 2, 3, 16, 17, 51):
        got = W.chained(np.concatenate([h, h[::-1], h]), width)
        assert len(got) == 600 - width + 1
        assert (got[: 200 - width + 1] == got[400 : 600 - width + 1]).all()
        assert len(np.unique(got[: 400 - width + 1])) == (200 if width == 1 else 400 - width + 1)
