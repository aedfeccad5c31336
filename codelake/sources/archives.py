"""ZIP archives to file rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from codelake.session import small_batches

# Fixed suffix and path-fragment lists.
TARGET_SUFFIXES = [".java", ".kt", ".yml", ".yaml", ".properties", ".gradle", ".kts"]
SKIP_FRAGMENTS = [
    "/.idea/", "/out/", "/build/", "/.gradle/", "/test/", "/gradlew", "gradlew.bat", "gradle-wrapper.jar",
    "gradle-wrapper.properties",
]
# Limits of an interactive upload; batch readers leave them off.
BATCH_ROWS, BATCH_CHARS = 1024, 8 * 1024 * 1024


def open_archives(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """(archive, content) of every ZIP under a folder, one row per archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.selectExpr("path AS archive", "content")


def _entries(blob: bytes, suffixes, skip, max_files, cap, only_text) -> Iterator[tuple[str, str]]:
    kept = 0
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        for info in z.infolist():
            lower = info.filename.lower()
            if info.is_dir() or any(s in lower for s in skip):
                continue
            if suffixes is not None and not (lower.endswith("pom.xml") or lower.endswith(suffixes)):
                continue
            if max_files is not None and kept >= max_files:
                return
            with z.open(info) as f:
                text = f.read(cap if cap is not None else -1).decode("utf-8", errors="replace")
            if only_text and not text.strip():
                continue
            kept += 1
            yield info.filename, text


def read_archives(archives: DataFrame, mode: str = "source", suffixes: Sequence[str] = TARGET_SUFFIXES,
                  skip: Sequence[str] = SKIP_FRAGMENTS, max_files: int | None = None, cap: int | None = None) -> DataFrame:
    """(archive, path, content) rows of the archives' files.

    ``source`` keeps target suffixes and build files; ``all`` keeps every non-blank file.
    ``max_files`` stops an archive after that many files and ``cap`` reads that many
    bytes of each; both are off unless asked for.
    """
    if mode not in ("source", "all"):
        raise ValueError(mode)
    small_batches(archives.sparkSession)  # an archive is large: many of them in one batch would fill a worker
    wanted = tuple(suffixes) if mode == "source" else None
    skipped = tuple(skip)

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in batches:
            for archive, blob in zip(pdf["archive"], pdf["content"]):
                for path, text in _entries(blob, wanted, skipped, max_files, cap, mode == "all"):
                    rows.append((archive, path, text))
                    size += len(text)
                    if len(rows) >= BATCH_ROWS or size >= BATCH_CHARS:
                        yield pd.DataFrame(rows, columns=["archive", "path", "content"])
                        rows, size = [], 0
        yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    return archives.select("archive", "content").mapInPandas(unzip, "archive string, path string, content string")


def list_paths(archives: DataFrame) -> DataFrame:
    """(archive, path) of every file; only the archives' directories are read."""
    small_batches(archives.sparkSession)

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for archive, blob in zip(pdf["archive"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    rows += [(archive, i.filename) for i in z.infolist() if not i.is_dir()]
            yield pd.DataFrame(rows, columns=["archive", "path"])

    return archives.select("archive", "content").mapInPandas(names, "archive string, path string")
