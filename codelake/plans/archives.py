"""Queries of the archive reader, on archives that Spark packs from the documents."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelake.plans.registry import query
from codelake.sources.archives import list_paths, read_archives


@F.pandas_udf(T.BinaryType())
def _pack(doc_id: pd.Series, text: pd.Series) -> pd.Series:
    def one(i, body):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.mkdir("p")
            z.writestr("p/blank.yml", "  \n")
            z.writestr(f"p/src/{i}.java", body)
            z.writestr("p/build/gen.java", "skipped")
            z.writestr("p/README.md", f"readme {i}")
        return out.getvalue()

    return pd.Series([one(i, b) for i, b in zip(doc_id, text)])


def archives(t):
    return t.documents.select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("archive"), _pack("doc_id", "text").alias("content"))


@query("src1_read_archives", """
    SELECT 'a' || doc_id AS archive, 'p/src/' || doc_id || '.java' AS path, text AS content FROM documents
    UNION ALL SELECT 'a' || doc_id, 'p/blank.yml', '  ' || chr(10) FROM documents""")
def _(t):
    return read_archives(archives(t))


@query("src2_read_all", """
    SELECT 'a' || doc_id AS archive, 'p/src/' || doc_id || '.java' AS path, text AS content FROM documents WHERE trim(text) <> ''
    UNION ALL SELECT 'a' || doc_id, 'p/README.md', 'readme ' || doc_id FROM documents""")
def _(t):
    return read_archives(archives(t), mode="all")


@query("src3_list_paths", """
    SELECT 'a' || doc_id AS archive, p AS path FROM documents, (VALUES ('p/blank.yml'), ('p/src/@.java'), ('p/build/gen.java'), ('p/README.md')) AS v(p0),
    LATERAL (SELECT replace(p0, '@', CAST(doc_id AS VARCHAR)) AS p)""")
def _(t):
    return list_paths(archives(t))
