"""Domain views over the star-schema and text tables, in Spark and in ANSI SQL.

Every view exists twice: as a DataFrame for the engine and as a CTE for the SQL
check.  ``with_views`` puts the CTEs a statement needs in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.session import pin_utc
from codelake.sources.tables import load


def ledger(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return load(spark, d, "events").select(
        F.col("event_id").alias("call_id"),
        F.concat(F.lit("job-"), (F.col("user_id") % 50).cast("string")).alias("job_id"),
        F.col("event_type").alias("agent"),
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("provider"),
        F.when(k % 2 == 0, "MIGRATION").otherwise("ANALYSIS").alias("tier"),
        k.alias("input_tokens"),
        (F.col("event_id") % 1000).alias("output_tokens"),
        F.col("value").cast("decimal(12,8)").alias("cost_usd"),
        (k % 3 == 0).alias("cache_hit"),
        F.col("ts").alias("created_at"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    shipped = (
        load(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max("l_shipdate").alias("last_ship"))
    )
    status = (
        F.when(F.col("o_orderstatus") == "O", "MIGRATING")
        .when(F.col("o_orderstatus") == "F", "FAILED")
        .otherwise("DONE")
    )
    return (
        load(spark, d, "orders")
        .join(shipped, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("run_id"),
            F.col("o_custkey").alias("user_id"),
            (F.col("o_custkey") % 100).alias("project_id"),
            status.alias("status"),
            F.col("o_orderdate").alias("created_at"),
            F.greatest(F.coalesce("last_ship", "o_orderdate"), "o_orderdate").alias("updated_at"),
        )
    )


# Fixed mapping of the event table's types to run statuses.
EVENT_STATUS = {
    "signup": "PENDING",
    "view": "ANALYZING",
    "click": "MIGRATING",
    "purchase": "DONE",
    "error": "FAILED",
}


def status_log(spark: SparkSession, d: str) -> DataFrame:
    status = F.lit(None).cast("string")
    for event, name in EVENT_STATUS.items():
        status = F.when(F.col("event_type") == event, name).otherwise(status)
    return load(spark, d, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", status.alias("status")
    )


def files(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(
        F.array(*[F.lit(x) for x in (".java", ".yml", ".txt", ".md")]),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    return load(spark, d, "documents").select(
        F.col("source").alias("project_id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.col("text").alias("content"),
        "doc_id",
        "lang",
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    shared = F.col("label") < 5
    return load(spark, d, "embeddings").select(
        "vec_id",
        "label",
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"),
        F.when(shared, "DOCUMENTATION").otherwise("SOURCE_CODE").alias("doc_type"),
        F.when(~shared, F.concat(F.lit("p"), (F.col("label") % 3).cast("string"))).alias("project_id"),
        "embedding",
    )


def reports(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"),
        (F.col("turn") + 1).alias("version"),
        F.col("text").alias("content"),
        "role",
    )


# Fixed lists of the findings view: runner by user_id % 6, severity by event type.
RUNNERS = ["contract", "pubsub-leak", "static", "docker", "docker-test", "custom"]


def findings(spark: SparkSession, d: str) -> DataFrame:
    severity = (
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "click", "WARNING")
        .otherwise("INFO")
    )
    return load(spark, d, "events").select(
        F.concat(F.lit("proj"), (F.col("user_id") % 20).cast("string")).alias("project_id"),
        F.element_at(
            F.array(*[F.lit(r) for r in RUNNERS]), (F.col("user_id") % 6 + 1).cast("int")
        ).alias("runner_id"),
        severity.alias("severity"),
        F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".java")).alias("path"),
        F.get_json_object("props", "$.k").cast("int").alias("line"),
        F.concat(F.col("event_type"), F.lit(" #"), F.col("event_id").cast("string")).alias("message"),
        F.col("event_id").alias("seq"),
        "ts",
    )


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(
        "event_id",
        "user_id",
        "ts",
        F.concat(
            F.lit("["), F.upper("event_type"), F.lit("] user "), F.col("user_id").cast("string"),
            F.lit(" value "), F.col("value").cast("decimal(10,2)").cast("string"),
            F.lit(" props "), F.col("props"),
        ).alias("line"),
    )


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, d, "events").select(
        F.when(F.col("event_id") % 97 != 0, F.concat(F.lit("d-"), F.col("event_id").cast("string"))).alias(
            "delivery_id"
        ),
        F.when(F.col("event_type") == "signup", "push")
        .when(F.col("event_type") == "view", "pull_request")
        .when(F.col("event_type") == "click", "issues")
        .when(F.col("event_type") == "purchase", "push")
        .alias("event_type"),
        (k % 7 != 0).alias("signature_valid"),
        F.col("props").alias("payload"),
        F.col("ts").alias("received_at"),
        F.col("event_id").alias("id"),
    )


SQL_VIEWS = {
    "ledger": """
        SELECT event_id AS call_id, 'job-' || (user_id % 50) AS job_id, event_type AS agent,
               'p' || (user_id % 5) AS provider,
               CASE WHEN k % 2 = 0 THEN 'MIGRATION' ELSE 'ANALYSIS' END AS tier,
               k AS input_tokens, event_id % 1000 AS output_tokens,
               CAST(value AS DECIMAL(12,8)) AS cost_usd, k % 3 = 0 AS cache_hit, ts AS created_at
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "runs": """
        SELECT o_orderkey AS run_id, o_custkey AS user_id, o_custkey % 100 AS project_id,
               CASE o_orderstatus WHEN 'O' THEN 'MIGRATING' WHEN 'F' THEN 'FAILED' ELSE 'DONE' END AS status,
               o_orderdate AS created_at,
               greatest(coalesce(last_ship, o_orderdate), o_orderdate) AS updated_at
        FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1)
             ON l_orderkey = o_orderkey""",
    "status_log": """
        SELECT user_id AS run_id, ts, event_id,
               CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'ANALYZING'
                    WHEN 'click' THEN 'MIGRATING' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED' END AS status
        FROM events""",
    "files": """
        SELECT source AS project_id,
               source || '/' || doc_id || (['.java', '.yml', '.txt', '.md'])[CAST(doc_id % 4 + 1 AS INT)] AS path,
               text AS content, doc_id, lang
        FROM documents""",
    "chunks": """
        SELECT vec_id, label, 'v' || vec_id AS path,
               CASE WHEN label < 5 THEN 'DOCUMENTATION' ELSE 'SOURCE_CODE' END AS doc_type,
               CASE WHEN label >= 5 THEN 'p' || (label % 3) END AS project_id, embedding
        FROM embeddings""",
    "reports": """
        SELECT conv_id AS session_id, turn + 1 AS version, text AS content, role FROM conversations""",
    "findings": """
        SELECT 'proj' || (user_id % 20) AS project_id,
               (['contract', 'pubsub-leak', 'static', 'docker', 'docker-test', 'custom'])[CAST(user_id % 6 + 1 AS INT)] AS runner_id,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END AS severity,
               'f' || user_id || '.java' AS path, CAST(json_extract_string(props, '$.k') AS INTEGER) AS line,
               event_type || ' #' || event_id AS message, event_id AS seq, ts
        FROM events""",
    "log_lines": """
        SELECT event_id, user_id, ts,
               '[' || upper(event_type) || '] user ' || user_id || ' value ' || CAST(value AS DECIMAL(10,2))
               || ' props ' || props AS line
        FROM events""",
    "deliveries": """
        SELECT CASE WHEN event_id % 97 <> 0 THEN 'd-' || event_id END AS delivery_id,
               CASE event_type WHEN 'signup' THEN 'push' WHEN 'view' THEN 'pull_request'
                    WHEN 'click' THEN 'issues' WHEN 'purchase' THEN 'push' END AS event_type,
               CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 <> 0 AS signature_valid,
               props AS payload, ts AS received_at, event_id AS id
        FROM events""",
}

VIEWS = {
    "ledger": ledger, "runs": runs, "status_log": status_log, "files": files, "chunks": chunks,
    "reports": reports, "findings": findings, "log_lines": log_lines, "deliveries": deliveries,
}


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` (a SELECT, or CTEs followed by one) with the named views."""
    ctes = [f"{n} AS ({SQL_VIEWS[n]})" for n in names.split()]
    body = body.strip()
    recursive = "RECURSIVE " if "WITH RECURSIVE" in body.upper()[:20] else ""
    if body.upper().startswith("WITH RECURSIVE"):
        body = ", " + body[len("WITH RECURSIVE"):].strip()
    elif body.upper().startswith("WITH"):
        body = ", " + body[len("WITH"):].strip()
    return f"WITH {recursive}{', '.join(ctes)} {body}" if ctes else body


def open_view(spark: SparkSession, d: str, name: str) -> DataFrame:
    pin_utc(spark)
    return VIEWS[name](spark, d) if name in VIEWS else load(spark, d, name)
