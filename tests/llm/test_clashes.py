"""Input columns may have any name that an operator uses inside; all come back as they were."""

import pytest
from pyspark.sql import functions as F

from codelake.llm import minhash_forest, ngram_join, pii, suffix_dedup

INNER = ["k1", "k2", "t1", "t2", "_k", "_n", "kept", "component", "found", "group_key", "least", "_terms", "_row", "_whole", "row", "n", "w", "m", "way", "ranges", "starts", "term", "action", "a b", "_heavy"]


@pytest.mark.parametrize("operator, new", [
    (ngram_join.near_duplicates, ["n_shingles", "component_id", "group_key"]), (minhash_forest.near_duplicates, ["n_shingles", "component_id", "kept"]),
    (suffix_dedup.remove_repeats, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]), (pii.find_pii, ["base", "spans"])])
def test_inner_names(spark, operator, new):
    same = "one two three four five six seven eight " * 12
    df = spark.createDataFrame([(1, same + "x"), (2, same + "y a@b.cd"), (3, None), (4, "short")], "doc_id bigint, text string")
    for c in INNER:
        df = df.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    out = operator(df)
    kept = [c for c in INNER if c not in new]
    assert set(out.columns) == {"doc_id", *kept, *new} | ({"text"} if "text" in out.columns else set())
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4]
    for r in rows:
        assert all(r[c] == f"{c}{r.doc_id}" for c in kept)
