"""Components against all pairs, and T-occurrence search against counting."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.llm import ngram_join as N

WORD = re.compile("[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, percent=80):
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = root(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, len(sets[k]), least[root(k)] if sets[k] else i) for k, (i, _) in enumerate(docs)), key=str)


def docs_of(seed):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(2000)]
    base = [[random.choice(vocabulary) for _ in range(random.randrange(3, 120))] for _ in range(10)]
    docs = []
    for k in range(220):
        w = list(random.choice(base))
        for _ in range(random.randrange(5)):
            w[random.randrange(len(w))] = random.choice(vocabulary)
        if random.random() < 0.2:
            w += random.choice(base)[:20]
        docs.append((k, " ".join(w).upper() if k % 7 == 0 else " ".join(w)))
    long = " ".join(random.choice(vocabulary) for _ in range(20000))
    return [*docs, (400, None), (401, ""), (402, " \t"), (403, docs[5][1]), (403, docs[5][1]), (None, docs[5][1]), (None, "all alone in this place here"),
            (404, "one two"), (405, "ONE  two"), (406, "two one"), (407, long), (408, long + " more"), (409, "É x"), (410, "é x")]


@pytest.mark.parametrize("seed, sizes", [(3, {}), (3, {"index_shingles": 300, "query_shingles": 500})])
def test_components(spark, seed, sizes):
    """With few shingles in an index almost every cluster is searched in slices."""
    docs = docs_of(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("K1", F.lit("old"))
    got = N.near_duplicates(df, **sizes).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain(docs)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_what_counting_finds(seed):
    rng = np.random.default_rng(seed)
    core = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(core, rng.integers(1, 60), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 8), dtype=np.uint64)])) for _ in range(60)]
    yes = np.ones(len(sets), bool)
    groups = N.Groups(len(sets))
    for a, b in N.search(np.arange(len(sets)), sets, yes, yes, 80):
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
        groups.join(a, b)
    want = N.Groups(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])):
                want.join(a, b)
    assert groups.roots(np.arange(len(sets))).tolist() == want.roots(np.arange(len(sets))).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_similar_sets_share_enough_of_their_openings(seed):
    rng = np.random.default_rng(seed)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        x = np.unique(rng.integers(0, 1 << 40, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.93], rng.integers(0, 1 << 40, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if both and 100 * both >= 80 * (len(x) + len(y) - both):
            shared = len(np.intersect1d(x[: N.opening(len(x), 80)], y[: N.opening(len(y), 80)]))
            assert shared >= max(N.required(len(x), 80), N.required(len(y), 80))
