"""Predicates and routing over files, URLs and log lines."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.functions.text import alternation, has_marker, is_migratable


def filter_files(df: DataFrame, exts: Sequence[str], skip: Sequence[str], cap: int | None = None) -> DataFrame:
    """Keep target suffixes and build files, drop paths with a skip fragment.

    ``cap`` cuts contents to that many characters; None keeps them whole.
    """
    lower = F.lower("path")
    keep = lower.rlike(f"({alternation([*exts, 'pom.xml'])})$")
    if skip:
        keep = keep & ~lower.rlike(alternation(skip))
    df = df.filter(keep)
    return df if cap is None else df.withColumn("content", F.substring("content", 1, cap))


def summary_view(df: DataFrame, heavy: Sequence[str] = ("content",)) -> DataFrame:
    """List projection without the heavy columns; the scan never reads them."""
    return df.select(*[c for c in df.columns if c not in heavy])


# Fixed routing reasons.
NOT_MIGRATABLE = "Not a migratable file type"
NO_MARKER = "No marker detected"


def triage(df: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Route every file: unchanged with a reason, or to be migrated."""
    ok, hit = is_migratable(F.col("path")), has_marker(F.col("content"), markers)
    return df.withColumn(
        "route", F.when(ok & hit, "TO_MIGRATE").otherwise("UNCHANGED")
    ).withColumn("reason", F.when(~ok, NOT_MIGRATABLE).when(~hit, NO_MARKER))


def allowed_urls(df: DataFrame, allow: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL host is allowed, under one of the host's path prefixes.

    ``allow`` has (host, prefix), one row per prefix, null prefix for a whole host.
    """
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    path = F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit(""))
    parsed = df.withColumn("_host", host).withColumn("_path", path).filter(F.trim("_host") != "")
    hit = (F.col("_host") == F.col("host")) & (F.col("prefix").isNull() | F.startswith("_path", "prefix"))
    return parsed.join(allow, hit, "left_semi").drop("_host", "_path")


LOG_TOKEN = re.compile(r'(-?)"([^"]+)"|(\S+)')


def parse_log_query(text: str) -> tuple[list[str], list[str]]:
    """Search box text to (must contain, must not contain), both lowercase."""
    want, avoid = [], []
    for dash, phrase, word in LOG_TOKEN.findall(text):
        if phrase:
            (avoid if dash else want).append(phrase.lower())
        elif word.startswith("-") and len(word) > 1:
            avoid.append(word[1:].lower())
        else:
            want.append(word.lower())
    return want, avoid


def log_filter(df: DataFrame, text: str, col: str = "line") -> DataFrame:
    """Words and quoted phrases must occur, ``-`` terms must not; empty keeps all."""
    want, avoid = parse_log_query(text)
    lower = F.lower(col)
    preds = [lower.contains(w) for w in want] + [~lower.contains(a) for a in avoid]
    return df.filter(reduce(Column.__and__, preds)) if preds else df


# Fixed substrings per level.
LEVELS = {
    "error": ["[ERROR]", "ERROR ", " ERROR"],
    "warn": ["[WARN", "WARNING", " WARN"],
    "info": ["[INFO]", " INFO"],
}


def level(df: DataFrame, name: str, col: str = "line") -> DataFrame:
    """Log lines of a level; any other level name keeps all."""
    if name not in LEVELS:
        return df
    return df.filter(F.upper(col).rlike(alternation(LEVELS[name])))


def prune_corpus(chunks: DataFrame, keep: DataFrame) -> DataFrame:
    """Delete shared documentation whose path is not in ``keep``; an empty set deletes nothing."""
    if keep.isEmpty():
        return chunks
    shared = (F.col("doc_type") == "DOCUMENTATION") & F.col("project_id").isNull()
    kept = chunks.filter(shared).join(keep.select("path").distinct(), "path", "left_semi")
    return chunks.filter(~shared).unionByName(kept)
