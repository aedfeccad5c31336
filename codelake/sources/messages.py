"""Parsing of delimited events, status messages and push payloads.

Every function takes a batch or a streaming DataFrame.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed topic names, enum values and defaults.
TOPICS = ["project.registered", "migration.job.created", "migration.job.status", "migration.job.progress"]
TARGETS = ["NATIVE_KAFKA_CLIENTS", "SPRING_KAFKA_HYBRID"]
DEFAULT_TARGET = "NATIVE_KAFKA_CLIENTS"


def parse_event(df: DataFrame, names: Sequence[str] = ("user_id", "storage_key", "target"), limit: int = 3) -> DataFrame:
    """Split ``a|b|c`` at the first bars; missing parts are empty, a bad target is the default."""
    parts = F.split("value", "\\|", limit)
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    target = part(limit - 1)
    columns = [part(i).alias(n) for i, n in enumerate(names[:-1])]
    return df.filter(F.col("key").isNotNull() & F.col("value").isNotNull()).select(
        "key", *columns, F.when(target.isin(TARGETS), target).otherwise(DEFAULT_TARGET).alias(names[-1])
    )


def parse_status(df: DataFrame) -> DataFrame:
    """``DONE:key``, ``FAILED:reason`` or a bare running status; anything else is dropped."""
    value = F.col("value")
    status = (
        F.when(value.startswith("DONE:"), "DONE")
        .when(value.startswith("FAILED:"), "FAILED")
        .when(value.isin("ANALYZING", "MIGRATING"), value)
    )
    detail = F.when(value.startswith("DONE:"), F.substr(value, F.lit(6))).when(
        value.startswith("FAILED:"), F.substr(value, F.lit(8))
    )
    return (
        df.filter(F.col("key").isNotNull() & value.isNotNull())
        .withColumn("status", status).withColumn("detail", detail)
        .filter(F.col("status").isNotNull())
    )


PUSH_SCHEMA = "repository struct<clone_url: string>, ref string, head_commit struct<id: string>"


def parse_push(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Push payloads to (repo_url, branch, commit_sha); incomplete ones are dropped."""
    p = F.from_json(payload, PUSH_SCHEMA)
    return (
        df.withColumn("_p", p)
        .withColumn("repo_url", F.col("_p.repository.clone_url"))
        .withColumn("branch", F.regexp_replace("_p.ref", "^refs/(heads|tags)/", ""))
        .withColumn("commit_sha", F.col("_p.head_commit.id"))
        .filter(F.col("repo_url").isNotNull() & F.col("branch").isNotNull() & F.col("commit_sha").isNotNull())
        .drop("_p")
    )


def trigger(df: DataFrame, enabled: bool, payload: str = "payload") -> DataFrame:
    """Accepted push deliveries to re-run triggers."""
    if not enabled:
        df = df.filter(F.lit(False))
    pushes = df.filter((F.col("status") == "ACCEPTED") & (F.col("event_type") == "push"))
    return parse_push(pushes, payload).select("delivery_id", "repo_url", "branch", "commit_sha")


SIGNATURE_PREFIX = "sha256="


def hmac_sha256(secret: bytes, body: Column) -> Column:
    """The keyed hash by its definition, two plain hashes over padded keys, as lower-case hex."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda byte: F.unhex(F.lit(bytes(c ^ byte for c in key).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), F.encode(body, "UTF-8")), 256))), 256)


def signature_ok(secret: str | None):
    """Column function (body, header) -> boolean: the header holds the body's keyed hash.

    Without a secret, for a null body or header, or without the prefix it's false.
    Comparing hashes of both sides takes the same time wherever they first differ.
    """
    def check(body: Column, header: Column) -> Column:
        if not (secret or "").strip():
            return F.lit(False)
        given = F.lower(F.substring(header, len(SIGNATURE_PREFIX) + 1, 1 << 30))
        same = F.sha2(given, 256) == F.sha2(hmac_sha256(secret.encode(), body), 256)
        return F.coalesce(F.startswith(header, F.lit(SIGNATURE_PREFIX)) & same, F.lit(False))

    return check


def sign(secret: str, body: str) -> str:
    return SIGNATURE_PREFIX + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def read_events(spark: SparkSession, source: str, fmt: str = "kafka", topics: Sequence[str] = TOPICS,
                schema: str = "key string, value string, ts timestamp", **options) -> DataFrame:
    """Event stream (key, value, ts): Kafka topics, or files of the same shape."""
    if fmt == "kafka":
        raw = (
            spark.readStream.format("kafka").option("kafka.bootstrap.servers", source)
            .option("subscribe", ",".join(topics)).options(**options).load()
        )
        return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), F.col("timestamp").alias("ts"), "topic")
    return spark.readStream.format(fmt).schema(schema).options(**options).load(source)
