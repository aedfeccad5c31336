"""Corpus pipeline: chunking, ingest planning, incremental embedding, full-text search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.text import html_to_text, java_trim, sha256_hex
from codelake.operators.filters import allowed_urls
from codelake.session import small_batches


def chunk_texts(text: Column, max_chars: int = 800, separator: str = "\n{2,}") -> Column:
    """Greedy paragraph chunks of a text.

    A chunk is flushed before the paragraph that would push it past the limit; a
    long paragraph stays whole.  Trailing empty paragraphs do not count.
    """
    parts = F.split(F.regexp_replace(text, f"(?:{separator})+$", ""), separator, -1)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc, p):
        full = (F.length(acc["buf"]) + F.length(p) > max_chars) & (acc["buf"] != "")
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(java_trim(acc["buf"])))).otherwise(acc["done"]).alias("done"),
            F.concat(F.when(full, F.lit("")).otherwise(acc["buf"]), p, F.lit("\n\n")).alias("buf"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.concat(acc["done"], F.array(java_trim(acc["buf"]))))


def chunk(df: DataFrame, text: str = "text", max_chars: int = 800, separator: str = "\n{2,}") -> DataFrame:
    """One row per chunk with its 0-based index, text and hash; blank texts give none."""
    rows = df.filter(java_trim(F.col(text)) != "")
    keep = [c for c in df.columns if c != text]
    return rows.select(*keep, F.posexplode(chunk_texts(F.col(text), max_chars, separator)).alias("chunk_index", "chunk_text")).withColumn(
        "content_hash", sha256_hex(F.col("chunk_text"))
    )


def ingest_plan(pages: DataFrame, index: DataFrame, allow: DataFrame) -> DataFrame:
    """Status of every page (key, url, html): disallowed, indexed, empty or ingest."""
    allowed = allowed_urls(pages.select("key", "url"), allow).select("key").withColumn("_a", F.lit(True))
    known = index.select("key").distinct().withColumn("_k", F.lit(True))
    text = html_to_text(F.col("html"))
    status = (
        F.when(F.col("_a").isNull(), "disallowed")
        .when(F.col("_k").isNotNull(), "indexed")
        .when(text == "", "empty")
        .otherwise("ingest")
    )
    return pages.join(allowed, "key", "left").join(known, "key", "left").withColumn("status", status).drop("_a", "_k")


def ingest_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def to_embed(chunks: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks whose key and hash are not in the index yet."""
    return chunks.join(index.select(*keys, "content_hash").distinct(), [*keys, "content_hash"], "left_anti")


def hash_embedding(texts: pd.Series, dim: int = 64) -> list[np.ndarray]:
    """Stand-in embedding for tests: signed token hashing, no model."""
    out = []
    for text in texts:
        v = np.zeros(dim, dtype=np.float32)
        for token in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1.0 if (h >> 32) & 1 else -1.0
        out.append(v)
    return out


def embed(chunks: DataFrame, fn: Callable[[pd.Series], list] = hash_embedding, text: str = "chunk_text") -> DataFrame:
    """Add ``embedding`` by an injected batch function (text series to vectors)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(embedding=fn(pdf[text]))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInPandas(run, f"{columns}, embedding array<float>")


# Fixed word list: English stop words of the full-text search configuration.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
]

WORD_BREAK = "[^\\p{L}\\p{N}]+"


def words(text: Column) -> Column:
    """Lowercase word tokens in order."""
    return F.filter(F.split(F.lower(text), WORD_BREAK, -1), lambda w: w != "")


def terms(text: Column) -> Column:
    return F.filter(words(text), lambda w: ~w.isin(STOP_WORDS))


def build_index(df: DataFrame, keys: Sequence[str], text: str = "content") -> DataFrame:
    """Inverted index (term, keys, tf).  Write it bucketed by term for repeated searches."""
    return (
        df.select(*keys, F.explode(terms(F.col(text))).alias("term"))
        .groupBy("term", *keys)
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def query_terms(text: str) -> list[str]:
    import re

    found = [w for w in re.split(r"[^\w]+|_", text.lower()) if w and w not in STOP_WORDS]
    return list(dict.fromkeys(found))


def search(index: DataFrame, n_docs: int | Column, text: str, keys: Sequence[str], newest: str,
           page: int = 0, size: int = 20) -> DataFrame:
    """Documents that hold every query term, best tf-idf first, then newest.

    Only the postings of the query's terms are read.  ``size`` is clamped to 1..100;
    a blank query gives nothing.  ``total`` is the number of matches on all pages.
    """
    wanted = query_terms(text)
    size = min(100, max(1, size))
    postings = index.filter(F.col("term").isin(wanted) if wanted else F.lit(False))
    total_docs = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    freq = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.col("_docs").cast("double") / F.col("df"))
    matches = (
        postings.join(F.broadcast(freq), "term")  # one row per query term
        .withColumn("_docs", total_docs)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.round(F.sum(F.col("tf") * idf), 6).alias("rank"))
        .filter(F.col("_n") == len(wanted))
        .drop("_n")
    )
    total = matches.agg(F.count(F.lit(1))).scalar()
    others = [k for k in keys if k != newest]
    return (
        matches.orderBy(F.desc("rank"), F.desc(newest), *others)
        .offset(page * size).limit(size)
        .withColumn("total", total)
    )


def headline(df: DataFrame, query: str, text: str = "content", words_max: int = 20, fragments: int = 2) -> DataFrame:
    """Up to two fragments of at most 20 words around hits, hits in ``<b>``."""
    wanted = query_terms(query)
    tokens = F.split(F.col(text), "\\s+", -1)
    bare = lambda w: F.regexp_replace(F.lower(w), "[^\\p{L}\\p{N}]", "")
    hits = F.filter(F.transform(tokens, lambda w, i: F.when(bare(w).isin(wanted), i)), lambda i: i.isNotNull())
    half = words_max // 2
    df = df.withColumn("_t", tokens).withColumn("_h", hits)
    first = F.greatest(F.element_at("_h", 1) - half, F.lit(0))
    later = F.filter("_h", lambda i: i >= first + words_max)
    second = F.greatest(F.element_at(later, 1) - half, first + words_max)
    starts = F.when(F.size("_h") == 0, F.array().cast("array<int>")).when(
        F.size(later) == 0, F.array(first.cast("int"))
    ).otherwise(F.array(first.cast("int"), second.cast("int")))
    mark = lambda w: F.when(bare(w).isin(wanted), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)
    pieces = F.transform(
        F.slice(starts, 1, fragments),
        lambda s: F.array_join(F.transform(F.slice(F.col("_t"), s + 1, F.lit(words_max)), mark), " "),
    )
    return df.withColumn("headline", F.array_join(pieces, " ... ")).drop("_t", "_h")


# ---- token budgets -------------------------------------------------------------------

def word_count(text: Column) -> Column:
    """Token estimate of a text: its white-space separated words."""
    return F.size(F.filter(F.split(text, "\\s+", -1), lambda w: w != ""))


def keyword_counts(df: DataFrame, text: str) -> DataFrame:
    """Frequent identifiers: file names, dotted paths and camel case, at least twice."""
    # Fixed patterns.
    token, boilerplate = "[A-Za-z_][A-Za-z0-9_.]{3,}", "(?i)^(org\\.apache\\.maven|INFO|ERROR|WARNING)"
    interesting = (
        F.endswith(F.col("token"), F.lit(".java"))
        | F.col("token").rlike("^[a-z]+(\\.[a-z0-9]+){2,}")
        | F.col("token").rlike("[a-z][A-Z]")
    )
    return (
        df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(token), 0)).alias("token"))
        .filter(interesting & ~F.col("token").rlike(boilerplate))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= 2)
    )


def log_keywords(df: DataFrame, text: str, limit: int = 12) -> DataFrame:
    return keyword_counts(df, text).orderBy(F.desc("n"), "token").limit(limit)


def budget_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], cost: str, budget: int,
                  slice_by: Column) -> DataFrame:
    """Greedy prefix per key: rows in order until one does not fit, then none.

    Costs are not negative, so the kept rows are those whose running cost fits.
    """
    from codelake.operators import slices

    return slices.running_sum(df, keys, order, cost, "used", slice_by).filter(F.col("used") <= budget)


# Fixed texts and limits of the retry context.
RETRY_HEADER = "PREVIOUS ATTEMPT FAILED. Fix these specific issues:\n\n"
MAX_FAILURES, MAX_CHARS, TOKEN_BUDGET = 5, 200, 2000


def retry_context(findings: DataFrame, order: Sequence[str], budget: int = TOKEN_BUDGET, max_failures: int = MAX_FAILURES,
                  max_chars: int = MAX_CHARS, counter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Prompt text per project from its first failures; projects without errors give ''.

    ``counter`` gives the cost of a text column: words by default, or any column function,
    such as a pandas UDF over a tokenizer.  The rank filter lets Spark keep
    ``max_failures`` rows per project before the shuffle; the number of failures comes from
    a partial count.
    """
    counter = counter or word_count
    errors = findings.filter(F.col("severity") == "ERROR")
    n_fail = findings.groupBy("project_id").agg(F.count_if(F.col("severity") == "ERROR").alias("n"))
    by = Window.partitionBy("project_id").orderBy(*order)
    first = errors.withColumn("i", F.row_number().over(by)).filter(F.col("i") <= max_failures)
    cut = F.when(F.length("message") > max_chars, F.concat(F.substring("message", 1, max_chars), F.lit("…"))).otherwise(F.col("message"))
    entry = F.concat(F.col("i").cast("string"), F.lit(". "), cut, F.lit("\n"))
    lines = first.select("project_id", "i", entry.alias("entry")).withColumn("cost", counter(F.col("entry")))
    used = F.sum("cost").over(Window.partitionBy("project_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    kept = lines.withColumn("used", used).filter(F.col("used") <= F.lit(budget) - counter(F.lit(RETRY_HEADER)))
    body = kept.groupBy("project_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "entry"))), lambda x: x["entry"]), "").alias("body"),
        F.count(F.lit(1)).alias("included"),
    )
    more = F.col("n") - F.coalesce("included", F.lit(0))
    text = F.concat(
        F.lit(RETRY_HEADER), F.coalesce("body", F.lit("")),
        F.when(more > 0, F.concat(F.lit("… and "), more.cast("string"), F.lit(" more issue(s).\n"))).otherwise(""),
    )
    return n_fail.join(body, "project_id", "left").select(
        "project_id", F.when(F.col("n") == 0, "").otherwise(text).alias("context")
    )


# ---- projects as file sets -----------------------------------------------------------

def _flat_digests(records: DataFrame) -> DataFrame:
    """SHA-256 of each project's records in the order of their paths.

    A hash takes its bytes one after the other, so a project is one task; the rows stream
    through it from Spark's sort and none are held.
    """
    small_batches(records.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None

        def out(name, done):
            columns = [pa.array([name], names.type), pa.array([done.hexdigest() if done else None], pa.string()), pa.array(["flat"], pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["project_id", "digest", "layout"])

        project, done = None, None
        for batch in batches:
            for name, rec in zip(batch.column("project_id"), batch.column("rec").to_pylist()):
                if names is None:
                    names, project = batch.column("project_id"), name
                elif name != project:
                    yield out(project.as_py(), done)
                    project, done = name, None
                if rec is not None:
                    done = done or hashlib.sha256()
                    done.update(rec)
        if names is not None:
            yield out(project.as_py(), done)

    kind = records.schema["project_id"].dataType.simpleString()
    # the records themselves are the second sort key, for paths found twice
    ordered = records.repartition("project_id").sortWithinPartitions("project_id", "path", "rec")
    return ordered.select("project_id", F.col("rec").cast("binary").alias("rec")).mapInArrow(digest, f"project_id {kind}, digest string, layout string")


def fingerprint(files: DataFrame, flat_limit: int | None = None, fanout: int = 3) -> DataFrame:
    """SHA-256 of each project's file set.

    A project's hash is over its path-sorted ``path:content\\n`` records (layout
    ``flat``), whatever its size.  With ``flat_limit``, a project of more characters gets
    a digest of digests over path-hash buckets (layout ``tree``), which is equal exactly
    when the file sets are equal and which tasks share.
    """
    record = F.concat("path", F.lit(":"), "content", F.lit("\n"))
    if flat_limit is None:
        return _flat_digests(files.select("project_id", "path", record.alias("rec")))
    sized = files.groupBy("project_id").agg(F.sum(F.length("path") + F.length("content") + 2).alias("_size"))
    tagged = files.join(sized, "project_id")
    flat = _flat_digests(tagged.filter(F.col("_size") <= flat_limit).select("project_id", "path", record.alias("rec")))
    leaf = F.struct("path", F.sha2(record, 256).alias("h"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["h"]), ""), 256)
    tree = (
        tagged.filter(F.col("_size") > flat_limit)
        .groupBy("project_id", F.substring(F.sha2("path", 256), 1, fanout).alias("bucket"))
        .agg(joined(leaf).alias("h"))
        .groupBy("project_id")
        .agg(joined(F.struct("bucket", "h")).alias("digest"))
        .withColumn("layout", F.lit("tree"))
    )
    return flat.unionByName(tree)


def common_prefix(df: DataFrame, by: Sequence[str], col: str, fallback: bool = False) -> DataFrame:
    """Longest common dot-segment prefix per group.

    The common prefix of a set of arrays is that of its smallest and largest member,
    so two partial aggregates suffice.  ``fallback`` gives the smallest value when
    nothing is common.
    """
    segs = F.split(F.col(col), "\\.", -1)
    ends = df.groupBy(*by).agg(F.min(segs).alias("lo"), F.max(segs).alias("hi"), F.min(col).alias("first"))
    same = F.zip_with("lo", "hi", lambda a, b: F.coalesce(a == b, F.lit(False)))
    stop = F.array_position(same, False)
    n = F.when(stop == 0, F.size("lo")).otherwise(stop - 1).cast("int")
    prefix = F.array_join(F.slice("lo", F.lit(1), n), ".")
    if fallback:
        prefix = F.when(n == 0, F.col("first")).otherwise(prefix)
    return ends.select(*by, prefix.alias("prefix"))


def golden_score(cand: DataFrame, by: Sequence[str], n_ref: Column, residue: str, idiom: str, suffix: str = ".java") -> DataFrame:
    """Cleanliness, structure and adoption of candidate file sets, weighted 40/30/30."""
    from codelake.functions.numbers import round_half_up

    java = cand.filter(F.lower("path").endswith(suffix))
    counts = java.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("content").rlike(residue)).alias("residue"),
        F.count_if(F.col("content").rlike(idiom)).alias("idiom"),
    ).withColumn("ref", n_ref)
    zero = lambda guard, value: F.when(guard == 0, F.lit(0.0)).otherwise(value)
    clean = zero(F.col("n"), F.lit(1.0) - F.col("residue") / F.col("n"))
    adopt = zero(F.col("n"), F.col("idiom") / F.col("n"))
    struct_ = zero(F.col("ref"), F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col("n") - F.col("ref")) / F.col("ref")))
    overall = 0.40 * clean + 0.30 * struct_ + 0.30 * adopt
    return counts.select(
        *by, "n", "residue", "idiom",
        round_half_up(clean).alias("cleanliness"), round_half_up(struct_).alias("structural"),
        round_half_up(adopt).alias("adoption"), (round_half_up(overall) * 100).alias("overall"),
    )
