"""The stages on a small corpus with known rows, each against what it must do."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as C
from codelake.llm import packing
from conftest import SMALL


def prose(seed, n=120):
    random.seed(seed)
    return " ".join("".join(random.choice(["ba", "ki", "lo", "mu", "te", "ra"]) for _ in range(random.randrange(1, 5))) for _ in range(n))


def fixture(spark):
    passage = prose(999, 90)
    rows = [(k, prose(k), "xx", "s", len(prose(k))) for k in range(40)]
    rows += [(100, prose(1), "xx", "s", 1), (101, prose(1), "xx", "t", 1), (101, prose(1), "xx", "t", 1)]  # exact copies of 1, one twice
    rows += [(102, prose(2) + " extra", "xx", "s", 1)]  # near copy of 2
    rows += [(103, prose(50) + " " + passage + " " + prose(51), "xx", "s", 1), (104, prose(52) + " " + passage + " " + prose(53), None, None, None)]
    rows += [(105, prose(54) + " ask me@corp.example now", "xx", "s", 1), (106, None, "xx", "s", 0), (107, "12 34", "xx", "s", 5), (None, prose(60), "xx", "s", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), passage


def test_stages(spark):
    docs, passage = fixture(spark)
    at = {}
    for name, stage in C.STAGES:
        before = docs
        docs = C.saved(stage(spark, docs, SMALL), until_end=True)
        at[name] = docs.collect()
        if name != C.STAGES[-1][0]:
            assert docs.columns == before.columns
    kept = [r.doc_id for r in at["language_id"]]
    assert 106 not in kept and 107 not in kept and len(kept) == 48
    single = [r.doc_id for r in at["ngram_jaccard_join"]]
    assert sorted(x for x in single if x is not None) == sorted([*range(40), 103, 104, 105]) and single.count(None) == 1
    text = {r.doc_id: r for r in at["suffix_dedup"]}
    assert len(text) == len(single)
    for k in (103, 104):
        assert passage[5:-5] not in text[k].text and text[k].n_chars == len(text[k].text)
    assert all(text[k].text == prose(k) for k in range(40))
    clean = {r.doc_id: r.text for r in at["pii"]}
    assert "me@corp.example" not in clean[105] and "[EMAIL]" in clean[105] and clean[7] == prose(7)
    pieces = at["best_fit_packing"]
    counted = {r.doc_id: len(r.text.split()) for r in at["pii"]}
    assert {r.doc_id: r.piece_len for r in pieces} == counted and max(r.capacity for r in pieces) in packing.CAPACITIES


def test_empty_table(spark):
    docs = fixture(spark)[0].limit(0)
    for _, stage in C.STAGES:
        docs = C.saved(stage(spark, docs, SMALL), until_end=True)
    assert docs.count() == 0


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in C.STAGES:
        docs = C.saved(stage(spark, docs, SMALL), until_end=True)
    same = ["doc_id", "n_tokens", "piece_start", "piece_len"]
    got, want = C.run(spark, SMALL).select(*same), docs.select(*same)
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.filter(F.col("piece_len") > 0).count() > 0


def test_a_passage_of_51_short_words_goes(spark):
    passage = prose(998, 51)
    assert len(passage) < 400
    rows = [(1, prose(70) + " " + passage + " " + prose(71)), (2, prose(72) + " " + passage + " " + prose(73)), (3, prose(74))]
    docs = spark.createDataFrame([(k, t, "xx", "s", len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in C.saved(C.unrepeated(spark, docs, SMALL), until_end=True).collect()}
    assert got[3].text == rows[2][1] and all(passage not in got[k].text and got[k].n_chars == len(got[k].text) for k in (1, 2))


def test_columns_with_inner_names_pass_all_stages(spark):
    names = ["k1", "k2", "kept", "_k", "_terms", "group_key", "rejected", "n_removed", "base", "spans", "score", "_n"]
    docs = fixture(spark)[0]
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    for _, stage in C.STAGES[:-1]:
        before, docs = docs.columns, C.saved(stage(spark, docs, SMALL), until_end=True)
        assert docs.columns == before
    rows = docs.collect()
    assert len(rows) == 44 and all(r[c] == f"{c}{'' if r.doc_id is None else r.doc_id}" for r in rows for c in names)
