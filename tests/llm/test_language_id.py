"""Held-out accuracy, rejection and the inputs a prediction may not use."""

import random

from pyspark.sql import functions as F

from codelake.llm import language_id as L
from conftest import SMALL


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    got = L.identify(docs).select("doc_id", "held_out", "lang", "lang_pred", "rejected")
    held = got.filter("held_out AND lang IS NOT NULL").collect()
    assert len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in held) / len(held) < 0.02


def test_only_text_decides(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = L.train(docs.select("lang", "text"), F.xxhash64("text"))
    a = L.predict(docs.select("text"), model).select("lang_pred", "score").collect()
    b = L.predict(docs.select("text", F.lit("fr").alias("lang"), F.lit("x").alias("score")), model).select("lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


def test_edges(spark):
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["größe", "straße", "über", "zürich"]}
    random.seed(1)
    rows = [(k, x, " ".join(random.choice(words[x]) for _ in range(30))) for k in range(80) for x in words]
    rows += [(None, "aa", "lorem"), (900, None, "lorem ipsum"), (901, "aa", None), (902, "aa", ""), (903, "bb", "12 34 ..."), (904, "bb", "über " * 20000), (904, "bb", "über " * 20000), (905, None, "ü")]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    got = {(r.doc_id, r.text and r.text[:20]): r for r in L.identify(df).collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
    for key in [(901, None), (902, ""), (903, "12 34 ...")]:
        assert (got[key].lang_pred, got[key].score, got[key].rejected) == ("und", 0.0, True)
    assert got[904, "über über über über "].lang_pred == "bb" and got[905, "ü"].lang_pred in words
    assert got[None, "lorem"].held_out is False and got[None, "lorem"].lang_pred == "aa"
    assert L.identify(df).count() == len(rows)
    assert L.identify(df.limit(0)).count() == 0
    unlabelled = L.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
