"""Sinks: upserts, versioned appends, CSV and patch export, delivery audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.functions.text import csv_cell
from codelake.operators import slices


def upsert_chunks(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Target after the batch, keyed by (project_id, path, chunk_index).

    An unchanged hash keeps the stored row; otherwise the batch row replaces it.
    ``action`` tells which happened.  Null project ids (shared rows) match each other.
    """
    keys = ["project_id", "path", "chunk_index"]
    rest = [c for c in target.columns if c not in keys]
    shared = F.lit("\u0000")
    t = target.select(*[F.coalesce(F.col(k), shared).alias(k) if k == "project_id" else F.col(k) for k in keys],
                      F.struct(*rest).alias("_t"))
    b = batch.select(*[F.coalesce(F.col(k), shared).alias(k) if k == "project_id" else F.col(k) for k in keys],
                     F.struct(*rest).alias("_b"))
    action = (
        F.when(F.col("_b").isNull(), "kept")
        .when(F.col("_t").isNull(), "inserted")
        .when(F.col("_t.content_hash") == F.col("_b.content_hash"), "unchanged")
        .otherwise("updated")
    )
    joined = t.join(b, keys, "full_outer").withColumn("action", action)
    row = F.when(F.col("action").isin("kept", "unchanged"), F.col("_t")).otherwise(F.col("_b"))
    return joined.withColumn("_r", row).select(
        F.nullif(F.col("project_id"), shared).alias("project_id"), "path", "chunk_index",
        *[F.col(f"_r.{c}").alias(c) for c in rest], "action",
    )


def upsert_latest(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Overwrite on key: the newest row of target and batch survives."""
    both = target.unionByName(batch)
    rest = [c for c in both.columns if c not in keys]
    return (
        both.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def append_versions(target: DataFrame, batch: DataFrame, order: str, slice_by: Column) -> DataFrame:
    """Batch rows with ``version`` continuing each session's highest stored version."""
    newest = target.groupBy("session_id").agg(F.max("version").alias("_max"))
    numbered = slices.row_numbers(batch, ["session_id"], [order], "_n", slice_by)
    return (
        numbered.join(newest, "session_id", "left")
        .withColumn("version", F.coalesce("_max", F.lit(0)) + F.col("_n"))
        .drop("_max", "_n")
    )


CSV_HEADER = "agent,provider,callCount,inputTokens,outputTokens,totalCostUsd"


def usage_csv_lines(df: DataFrame) -> DataFrame:
    """One CSV line per usage row; cost with six decimals."""
    return df.select(
        F.concat_ws(
            ",", csv_cell(F.col("agent")), csv_cell(F.col("provider")), F.col("calls").cast("string"),
            F.col("input_tokens").cast("string"), F.col("output_tokens").cast("string"),
            F.col("cost_usd").cast("decimal(18,6)").cast("string"),
        ).alias("line")
    )


def export_usage_csv(df: DataFrame, path: str) -> None:
    """Write the usage report as CSV part files, each with the header."""
    df.select(
        "agent", "provider", F.col("calls").alias("callCount"), F.col("input_tokens").alias("inputTokens"),
        F.col("output_tokens").alias("outputTokens"), F.col("cost_usd").cast("decimal(18,6)").alias("totalCostUsd"),
    ).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def to_patch(df: DataFrame) -> DataFrame:
    """(original_path, new_path, change_type, content) to one unified-diff block per file.

    The old side is unknown, so every line is an addition (a deletion for DELETED).
    """
    kind = F.upper(F.coalesce("change_type", F.lit("")))
    side = lambda c, p: F.when(
        F.trim(F.coalesce(c, F.lit(""))) == "", "/dev/null").otherwise(F.concat(F.lit(p), F.col(c)))
    old, new = side("original_path", "a/"), side("new_path", "b/")
    lines = F.split(F.coalesce("content", F.lit("")), "\n", -1)
    mark = F.when(kind == "DELETED", "-").otherwise("+")
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.col("_mark"), x)), "\n")
    return df.withColumn("_mark", mark).withColumn(
        "patch",
        F.concat(
            F.lit("diff --git "), old, F.lit(" "), new, F.lit("\n--- "),
            F.when(kind == "CREATED", "/dev/null").otherwise(old), F.lit("\n+++ "),
            F.when(kind == "DELETED", "/dev/null").otherwise(new),
            F.lit("\n@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"), body, F.lit("\n\n"),
        ),
    ).drop("_mark")


def write_patches(df: DataFrame, path: str) -> None:
    to_patch(df).select("patch").write.mode("overwrite").text(path)


# Fixed message texts of the delivery audit.
BAD_SIGNATURE = "Invalid or missing X-Hub-Signature-256"
UNSUPPORTED = "Event type not supported: "


def audit_deliveries(df: DataFrame, supported: Sequence[str]) -> DataFrame:
    """Audit row per received delivery."""
    known = F.coalesce(F.col("event_type").isin(list(supported)), F.lit(False))
    status = F.when(~F.col("signature_valid"), "FAILED").when(~known, "SKIPPED").otherwise("ACCEPTED")
    error = F.when(~F.col("signature_valid"), BAD_SIGNATURE).when(
        ~known, F.concat(F.lit(UNSUPPORTED), F.coalesce("event_type", F.lit("null")))
    )
    return df.select(
        "id",
        F.coalesce("delivery_id", F.lit("unknown")).alias("delivery_id"),
        F.coalesce("event_type", F.lit("unknown")).alias("event_type"),
        "signature_valid", status.alias("status"), error.alias("error"), "payload", "received_at",
        F.when(status == "ACCEPTED", F.col("received_at")).alias("processed_at"),
        F.lit(None).cast("string").alias("replay_of"),
    )


def replay(audited: DataFrame, now) -> DataFrame:
    """Replay rows for every delivery that was not accepted."""
    millis = int(now.timestamp() * 1000)
    at = F.lit(now).cast(audited.schema["received_at"].dataType)
    return audited.filter(F.col("status") != "ACCEPTED").select(
        F.concat(F.col("delivery_id"), F.lit(f"-replay-{millis}")).alias("delivery_id"),
        "event_type", F.lit(True).alias("signature_valid"), F.lit("ACCEPTED").alias("status"),
        "payload", F.lit(None).cast("string").alias("error"), at.alias("received_at"), at.alias("processed_at"),
        F.col("id").alias("replay_of"),
    )
