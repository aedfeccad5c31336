"""From raw documents to packed sequences: five stages, each over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes
and reads again as the next one's ``docs``.  A stage's own intermediate tables go when the
next stage begins.  All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelake.llm import language_id, ngram_join, packing, pii, suffix_dedup
from codelake.llm.common import apart, release, saved, small_batches, table, text_key
from codelake.llm.registry import query


def begin(spark: SparkSession) -> None:
    """Free what the stage before has written for itself, and send texts to Python in batches of few bytes."""
    release(spark)
    small_batches(spark)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the model rejects go, null and letterless texts among them."""
    begin(spark)
    rows, restored = apart(docs, ["doc_id", "text", "lang"])
    return restored(language_id.identify(rows).filter(~F.col("rejected")).select(*rows.columns))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id, and of equal ids the first by its other columns.

    Texts without words are in no group and all stay.
    """
    begin(spark)
    docs, restored = apart(docs, ["doc_id", "text"])
    keyed = docs.withColumn("_k", text_key(F.col("text"))).select("*", "_k.k1", "_k.k2").drop("_k")
    light = saved(ngram_join.near_duplicates(keyed.select("doc_id", "text", F.col("k1").alias("t1"), F.col("k2").alias("t2"))))
    groups = light.filter("group_key IS NOT NULL").groupBy("group_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group_key")
    grouped = saved(light.join(groups, "group_key").select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), "group_key").distinct())
    # texts outside of every group pass without a shuffle
    words = suffix_dedup.key_filter(grouped.select("k1"))
    single = suffix_dedup.filtered(keyed, words, keep=False)
    met = suffix_dedup.filtered(keyed, words).join(grouped, ["k1", "k2"], "left")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy("group_key").orderBy(F.col("doc_id").asc_nulls_last(), "k1", "k2", *others)
    chosen = met.filter("group_key IS NOT NULL").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    parts = (single, met.filter("group_key IS NULL"), chosen)
    single, alone, chosen = (p.select(*docs.columns) for p in parts)
    return restored(single.unionByName(alone).unionByName(chosen))


#: A repeated passage of more words goes, however short they are.
PASSAGE_WORDS = 50


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words (or of 400 bytes) that repeat; all documents stay, an emptied one too."""
    begin(spark)
    rows, restored = apart(docs, ["text", "n_chars"])
    done = suffix_dedup.remove_repeats(rows, over_words=PASSAGE_WORDS)
    return restored(_recounted(done, F.col("n_removed") > 0).select(*rows.columns))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and disclosing terms replaced; all documents stay."""
    begin(spark)
    rows, restored = apart(docs, ["text", "n_chars"])
    found = pii.find_pii(rows).withColumn("text", pii.sanitised(F.col("text"), F.col("spans")))
    return restored(_recounted(found, F.size("spans") > 0).select(*rows.columns))


def _recounted(docs: DataFrame, changed) -> DataFrame:
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words go: bin, place in it and the bin's size; a wordless document is in none."""
    begin(spark)
    return packing.pack(packing.word_counts(docs.select("doc_id", "text")), "n_tokens")


STAGES = [
    ("language_id", identified),
    ("ngram_jaccard_join", deduplicated),
    ("suffix_dedup", unrepeated),
    ("pii", sanitised),
    ("best_fit_packing", packed),
]

#: The stages fit a model, sort suffixes and pack bins, which SQL can't express.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), until_end=True)
    return STAGES[-1][1](spark, docs, sf_dir)
