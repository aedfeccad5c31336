"""Quality rules: a ledger of rule bits and measurements, read by versioned policies.

Every rule is evaluated once.  The ledger keeps its failure bit and the measurements.  A
policy is a mask; judging, comparing policies and ablating rules are bit operations
over the ledger and never read a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import SPACE, extended, flat, hash_segments, mix, output, segments, slices, spread, table, unclashed, windows
from codelake.llm.registry import query

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "longest_word"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LINE_BREAK = np.zeros(256, bool)
_LINE_BREAK[0x0A] = True


def _prefix(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _distinct(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each text."""
    _, first = np.unique(mix(values + mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)
    return spread(doc[first], n)


def measure_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text, over the whole text; a null text has none of anything."""
    data, offsets = flat(texts)
    n = len(offsets) - 1
    starts, ends, doc = segments(data, offsets, SPACE)
    begins = _prefix((data & 0xC0) != 0x80)  # code points begin at bytes that continue none
    chars = begins[ends] - begins[starts]
    out = {"n_words": spread(doc, n), "word_chars": np.bincount(doc, chars, n).astype(np.int64)}
    out["n_symbols"] = np.diff(_prefix(_SYMBOL[data])[offsets])

    line_start, line_end, line_doc = segments(data, offsets, _LINE_BREAK)
    words = _prefix(~SPACE[data])
    full = words[line_end] > words[line_start]
    line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
    out["n_lines"] = spread(line_doc, n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(hash_segments(data, line_start, line_end), line_doc, n)

    hashes, first = windows(hash_segments(data, starts, ends), doc, 5)
    keyed = mix(hashes + mix(doc[first].astype(np.uint64) + np.uint64(1)))
    _, back, count = np.unique(keyed, return_inverse=True, return_counts=True)
    again = first[count[back] > 1]
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 5, -1)
    out["n_repeat_words"] = spread(doc[np.cumsum(cover[:-1]) > 0], n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, chars)
    return out | {"longest_word": longest}


@dataclass(frozen=True)
class Rule:
    """``fails`` is a boolean column over the measurements; ``bit`` never changes once it's in a ledger."""

    bit: int
    name: str
    fails: Column


def rules() -> list[Rule]:
    c = F.col
    return [
        Rule(0, "few_words", c("n_words") < 10),
        Rule(1, "repeated_windows", 100 * c("n_repeat_words") > 20 * c("n_words")),
        Rule(2, "symbols", 10 * c("n_symbols") > c("n_words")),
        Rule(3, "duplicate_lines", (100 * c("n_dup_lines") > 30 * c("n_lines")) & (c("n_lines") > 1)),
        Rule(4, "short_words", c("word_chars") < 2 * c("n_words")),
        Rule(5, "long_words", c("word_chars") > 20 * c("n_words")),
        Rule(6, "endless_word", c("longest_word") > 1000),
        Rule(7, "many_words", c("n_words") > 1_000_000),
    ]


def mask(*names: str) -> int:
    bits = {r.name: r.bit for r in rules()}
    return sum(1 << bits[n] for n in names)


#: Versions only grow: a policy that has been used keeps its name and mask.
BASE_POLICY = ("few_words", "repeated_windows")
POLICIES = {
    "base-1": BASE_POLICY,
    "clean-1": (*BASE_POLICY, "symbols", "duplicate_lines"),
    "clean-2": (*BASE_POLICY, "symbols", "duplicate_lines", "short_words", "long_words", "endless_word"),
}
PRODUCTION = "clean-2"


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """All rows with the measurements; columns of their names are replaced."""
    frame = unclashed(df, MEASURES)
    schema = extended(frame, ", ".join(f"{m} bigint" for m in MEASURES))

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                found = measure_texts(part.column(text))
                yield output(part, part.schema.names, **{m: found[m] for m in MEASURES})

    return frame.mapInArrow(run, schema)


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """All rows, the text left out, with the measurements and ``failed``: bit k is set where rule k fails.

    A null or empty text has zero of everything and fails ``few_words`` only.  Repeated
    rows are judged one by one and stay.  Words are compared by 64-bit hashes.
    """
    bits = F.lit(0).cast("bigint")
    for rule in rules():
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << rule.bit)).otherwise(0).cast("bigint"))
    return unclashed(measured(df, text), ["failed", text]).withColumn("failed", bits)


def passes(failed: Column, policy: str) -> Column:
    return failed.bitwiseAND(F.lit(mask(*POLICIES[policy]))) == 0


def ablation(book: DataFrame) -> DataFrame:
    """(policy, rule, n_kept, n_without, n_alone): rows the policy keeps, keeps without the rule, and loses by the rule alone.

    Rows with the same bits are counted once, so what is shuffled has one row for each
    combination of bits that occurs in a task.
    """
    counted = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    entries = [(p, r.name, mask(*names), 1 << r.bit) for p, names in POLICIES.items() for r in rules() if r.name in names]
    plan = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("bigint").alias("m"), F.lit(b).cast("bigint").alias("b")) for p, r, m, b in entries]))
    seen = F.col("failed").bitwiseAND(F.col("m"))
    others = seen.bitwiseAND(F.bitwise_not("b"))
    return (
        counted.select("failed", "n", plan.alias("e")).select("failed", "n", "e.*")
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(seen == 0, F.col("n")).otherwise(0)).alias("n_kept"),
            F.sum(F.when(others == 0, F.col("n")).otherwise(0)).alias("n_without"),
            F.sum(F.when(seen == F.col("b"), F.col("n")).otherwise(0)).alias("n_alone"),
        )
    )


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(F.col("failed"), "base-1")).alias("base_failed"), passes(F.col("failed"), PRODUCTION).alias("kept"), "failed",
    )
