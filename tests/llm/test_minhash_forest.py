"""The forest against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ngram_join import docs_of, plain

from codelake.llm import linking as L
from codelake.llm import minhash_forest as M
from codelake.llm.ngram_join import shingle_sets


def expected(docs):
    return sorted(((i, n, c, i == c) for i, n, c in plain(docs, 85)), key=str)


def star(leaves=150, words=400):
    """One text and many that each differ from it by an edit or two, and more from each other."""
    rng = random.Random(1)
    base = [f"b{k}" for k in range(words)]
    docs = [(1000, " ".join(base))]
    for k in range(leaves):
        w = list(base)
        for at in rng.sample(range(0, words, 6), 6):
            w[at] = f"x{rng.random()}"
        docs.append((1001 + k, " ".join(w)))
    return docs


CLASHES = ["row", "k1", "signature", "component", "copies", "least", "KEPT", "_heavy", "m", "w"]


@pytest.mark.parametrize("sizes", [{}, {"block": 64, "region": 16, "nearest": 4, "shingles": 3000}])
def test_components(spark, sizes):
    """Small sizes part orders into many blocks and clusters into slices."""
    docs = docs_of(3) + star()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for c in CLASHES:
        df = df.withColumn(c, F.lit("old"))
    done = M.near_duplicates(df, **sizes)
    assert done.columns == ["doc_id", *[c for c in CLASHES if c != "KEPT"], "n_shingles", "component_id", "kept"]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in done.collect()), key=str) == expected(docs)


def test_given_documents_and_empty_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in M.op13(spark, "/root/testdata/sf0.001").collect()), key=str) == expected(docs)
    assert M.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_candidates_hold_every_pair_of_a_small_region(seed):
    rng = np.random.default_rng(seed)
    minima = rng.integers(0, 3, (400, 6)).astype(">u4")
    minima = minima[np.lexsort(minima.T[::-1])]
    sketches = rng.integers(0, 2, (400, M.SKETCH)).astype(np.uint8)
    p = L.labels(400, *M.candidates(minima, sketches, 36, region=16, nearest=3))
    for depth in range(3, 7):
        for a in range(400):
            for b in range(a):
                same = (minima[:, :depth] == minima[a, :depth]).all(axis=1)
                if same[b] and (same.sum() <= 16 and (sketches[a] == sketches[b]).sum() >= 36 or depth == 6 and same.sum() > 16):
                    assert p[a] == p[b]


def test_minima_agree_as_often_as_sets_do():
    import pyarrow as pa

    words = [f"w{k}" for k in range(600)]
    x, y = shingle_sets(pa.array([" ".join(words[:500]), " ".join(words[40:540])]))
    same = (M.signatures([x, y])[0] == M.signatures([x, y])[1]).mean()
    assert abs(same - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.12


@pytest.mark.parametrize("held", [3, 1000])
def test_components_of_links(spark, held):
    rng = random.Random(held)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(60)]
    want = L.labels(2000, *(np.array(links).T))
    df = L.contracted(spark.createDataFrame(links, "src bigint, dst bigint"), held)
    got = {r.node: r.component for r in L.components(df).collect()}
    assert got == {k: int(want[k]) for pair in links for k in pair if want[k] != k or (want == k).sum() > 1}
