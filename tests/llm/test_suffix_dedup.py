"""Suffix arrays and common prefixes against sorting, removal against a count of all strings."""

import functools
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codelake.llm import suffix_dedup as D
from codelake.llm.suffix_array import closed, permuted_common_prefixes, suffix_array


def sorted_suffixes(strings):
    text = [x for k, s in enumerate(strings) for x in [*((1, b) for b in s), (0, k)]]
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0] * len(text)
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        shared[b] = n
    return order, shared


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array_and_common_prefixes(seed):
    random.seed(seed)
    for letters in (1, 2, 3, 250):
        strings = [bytes(random.randrange(letters) for _ in range(random.randrange(1, 40))) for _ in range(random.randrange(1, 9))]
        strings += [strings[0], strings[0] + b"x"]
        text = closed(strings)
        order = suffix_array(text)
        want, shared = sorted_suffixes(strings)
        assert order.tolist() == want
        assert permuted_common_prefixes(text, order).tolist() == shared


def plain(docs, span):
    count = Counter()
    data = [(t or "").encode() for _, t in docs]
    for d in data:
        count.update(d[k : k + span] for k in range(len(d) - span + 1))
    out = []
    for d in data:
        covered = bytearray(len(d))
        for k in range(len(d) - span + 1):
            if count[d[k : k + span]] > 1:
                covered[k : k + span] = b"\x01" * span
        runs = sum(bool(covered[k]) and (k == 0 or not covered[k - 1]) for k in range(len(d)))
        out.append((len(d), sum(covered), runs, hashlib.sha256(bytes(b for b, c in zip(d, covered) if not c)).hexdigest()))
    return sorted((i, *x) for (i, _), x in zip(docs, out))


def docs_of(seed):
    random.seed(seed)
    words = [f"é{k}" if k % 3 == 0 else f"w{k}" for k in range(30 if seed else 5)]
    prose = lambda n: " ".join(random.choice(words) for _ in range(n))
    passages = [prose(14) for _ in range(5)]
    docs = [(k, prose(random.randrange(40)) + random.choice([*passages, ""]) + prose(random.randrange(25)) + random.choice([*passages, "", ""]) + "a" * random.choice([0, 0, 0, 60])) for k in range(90)]
    return [*docs, (200, None), (201, ""), (202, docs[0][1]), (203, docs[0][1]), (203, docs[0][1]), (204, "a" * 3000), (205, "short")]


@pytest.mark.parametrize("seed, per_shard", [(0, 2500), (1, 2500), (1, 4)])
def test_removal(spark, monkeypatch, seed, per_shard):
    """With four places in a shard almost every anchor is dealt out."""
    monkeypatch.setattr(D, "repeated_ranges", functools.partial(D.repeated_ranges, per_shard=per_shard))
    docs = docs_of(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("K1", F.lit("old"))
    got = D.remove_repeats(df, span=40, with_text=False).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain(docs, 40)


def test_kept_text_and_null_ids(spark):
    docs = [(None, "é" * 60 + "tail"), (2, "head" + "é" * 60), (3, None), (4, "untouched text")]
    got = {r.doc_id: r for r in D.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), span=40).collect()}
    assert got[3].text is None and got[4].text == "untouched text" and got[4].n_removed == 0
    assert got[None].text == "tail" and got[2].text == "head"
    assert D.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string"), span=40).count() == 0


def test_merged_runs_and_characters():
    assert D.merged([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]
    data = "aéb".encode()
    assert D._whole_characters(data, [(2, 4)]) == [(3, 4)] and D._whole_characters(data, [(2, 3)]) == []


def test_passages_of_over_fifty_short_words(spark):
    """51 short words go, 50 stay, and so do two passages of 30 that only meet; 400 bytes go however few their words."""
    short = lambda tag, n: " ".join(f"{tag}{k:02d}" for k in range(n))
    long_one, even, first, second, wide = short("a", 51), short("b", 50), short("c", 30), short("d", 30), " ".join("é" * 10 for _ in range(1, 21))
    assert len(long_one) < 210 and len(wide.encode()) > 400
    docs = [(1, f"one {long_one} two"), (2, f"three {long_one} four"), (3, f"five {even} six"), (4, f"seven {even} eight"), (5, f"{first} {second} nine"), (6, f"{first} ten"), (7, f"eleven {second} nine"), (8, f"x {wide}"), (9, f"y {wide}"), (10, None), (11, short("e", 51)), (11, short("e", 51)), (12, short("f", 49)), (12, short("f", 49))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = [(r.doc_id, r.text) for r in D.remove_repeats(df, over_words=50).orderBy("doc_id").collect()]
    gone = {1: "one  two", 2: "three  four", 8: "x", 9: "y", 11: ""}
    assert [(k, t and t.strip()) for k, t in got] == [(k, gone.get(k, t)) for k, t in docs]
    assert all(r.text == dict(docs)[r.doc_id] for r in D.remove_repeats(df).collect() if r.doc_id < 8)
