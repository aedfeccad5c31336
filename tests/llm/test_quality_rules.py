"""Measurements against a word-by-word count, and policies over the ledger."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from codelake.llm import quality_rules as Q

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def texts():
    random.seed(4)
    made = ["".join(random.choice(["a ", "b ", "ab ", "\n", "é", "#", "😀 ", "\t", "a b a b a\n", "\u00a0"]) for _ in range(random.randrange(0, 120))) for _ in range(300)]
    return [*made, *made[:9], None, "", " \n ", "x" * 60000, "w " * 30000, "same line\n" * 2000, "a\x0bb\x0cc\rd"]


def test_measurements(spark):
    given = texts()
    df = spark.createDataFrame(list(enumerate(given)), "doc_id bigint, text string").selectExpr("*", "'old' AS N_Words")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.ledger(df).collect()}
    assert got == {k: plain(t) for k, t in enumerate(given)}
    assert Q.ledger(df.limit(0)).count() == 0


def test_policies_and_ablation(spark):
    book = Q.ledger(spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string")).cache()
    rows = book.collect()
    for r in rows:
        base = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert bool(r.failed & Q.mask(*Q.BASE_POLICY)) == base
    seen = {(r.policy, r.rule): (r.n_kept, r.n_without, r.n_alone) for r in Q.ablation(book).collect()}
    for policy, names in Q.POLICIES.items():
        m = Q.mask(*names)
        for name in names:
            bit = Q.mask(name)
            kept = sum(not r.failed & m for r in rows)
            without = sum(not r.failed & m & ~bit for r in rows)
            assert seen[policy, name] == (kept, without, without - kept)


def test_masks_only_use_known_bits(spark):
    assert len({r.bit for r in Q.rules()}) == len(Q.rules())
    assert spark.range(1).select(Q.passes(F.lit(0).cast("bigint"), Q.PRODUCTION)).collect()[0][0]
