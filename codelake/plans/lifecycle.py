"""Queries over runs, sessions, pauses and deliveries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from codelake.operators import runs as R
from codelake.operators.slices import by_range, id_slice, ranged
from codelake.plans.registry import query
from codelake.sources import sinks

AFTER, BEFORE = dt.datetime(1996, 1, 1), dt.datetime(1997, 12, 31)
CUTOFF = dt.datetime(1998, 6, 1)
NOW = dt.datetime(2024, 1, 31, 12)
JOB_VALUES = ", ".join(f"('{s}')" for s in R.JOB_STATUSES)


@query("flt1_filter_runs", f"""
    SELECT run_id, created_at FROM runs WHERE project_id = 7 AND status = 'DONE'
    AND created_at >= TIMESTAMP '{AFTER}' AND created_at <= TIMESTAMP '{BEFORE}'""", "runs")
def _(t):
    return R.filter_runs(t.runs, project=7, status="DONE", after=AFTER, before=BEFORE).select("run_id", "created_at")


@query("flt3_stale", f"SELECT run_id, updated_at FROM runs WHERE status = 'MIGRATING' AND updated_at < TIMESTAMP '{CUTOFF}'",
       "runs")
def _(t):
    return R.stale(t.runs, "MIGRATING", CUTOFF).select("run_id", "updated_at")


@query("flt4_active", "SELECT run_id, project_id, status FROM runs WHERE status NOT IN ('DONE', 'FAILED', 'CANCELLED')", "runs")
def _(t):
    return R.active(t.runs).select("run_id", "project_id", "status")


@query("flt10_search_runs", """
    SELECT run_id, project_id FROM runs WHERE status = 'FAILED'
    AND (contains(lower(CAST(run_id AS VARCHAR)), '42') OR contains(lower(CAST(project_id AS VARCHAR)), '42'))""", "runs")
def _(t):
    return R.search_runs(t.runs, "FAILED", " 42 ").select("run_id", "project_id")


@query("flt13_retain", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def _(t):
    return R.retain(t.events, "ts", dt.datetime(2024, 1, 15)).select("event_id")


@query("flt15_domain_violations", "SELECT run_id, status FROM runs WHERE status NOT IN ('PENDING', 'DONE')", "runs")
def _(t):
    return R.domain_violations(t.runs, "status", ["PENDING", "DONE"]).select("run_id", "status")


@query("ag5_status_counts", f"""
    SELECT d.status, count(r.run_id) AS n FROM (VALUES {JOB_VALUES}) AS d(status)
    LEFT JOIN runs r ON r.status = d.status GROUP BY d.status""", "runs")
def _(t):
    return R.status_counts(t.runs)


@query("ag6_org_summary", """
    SELECT count(*) AS total, CAST(count(*) FILTER (WHERE status = 'DONE') AS DOUBLE) / count(*) AS success_rate,
           coalesce(avg(date_diff('microsecond', created_at, updated_at)) FILTER (WHERE status = 'DONE') / 1e6, 0) AS avg_seconds
    FROM runs""", "runs")
def _(t):
    return R.org_summary(t.runs)


@query("ag7_status_share", """
    SELECT status, n, CAST(floor(n * 100.0 / sum(n) OVER () + 0.5) AS BIGINT) AS percent
    FROM (SELECT status, count(*) AS n FROM runs GROUP BY status)""", "runs")
def _(t):
    return R.status_share(t.runs)


@query("ag8_facets", """
    SELECT CASE WHEN grouping(status) = 1 THEN 'ALL' ELSE status END AS status, count(*) AS n
    FROM runs GROUP BY ROLLUP (status)""", "runs")
def _(t):
    return R.facets(t.runs)


@query("ag9_runs_by_day", """
    SELECT strftime(d, '%Y-%m-%d') AS day, count(e.event_id) AS n
    FROM generate_series(TIMESTAMP '2024-01-18', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) AS g(d)
    LEFT JOIN events e ON CAST(e.ts AS DATE) = CAST(d AS DATE) GROUP BY 1""")
def _(t):
    return R.runs_by_day(t.events, "ts", NOW, 14)


# Steps view: one step per event; purchase is DONE, click is ACTIVE, the rest PENDING.
STEPS_SQL = """
    steps AS (SELECT user_id AS run_id, ts AS started_at,
                CASE WHEN event_type = 'purchase' THEN ts + to_seconds(CAST(floor(value) AS BIGINT)) END AS ended_at,
                CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'click' THEN 'ACTIVE' ELSE 'PENDING' END AS state
              FROM events)"""


def _steps(t):
    return t.events.select(
        F.col("user_id").alias("run_id"),
        F.col("ts").alias("started_at"),
        F.when(F.col("event_type") == "purchase",
               F.timestamp_add("SECOND", F.floor("value").cast("int"), F.col("ts")).cast("timestamp_ntz")).alias("ended_at"),
        F.when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "click", "ACTIVE")
        .otherwise("PENDING").alias("state"),
    )


@query("ag20_progress", f"""
    WITH {STEPS_SQL}
    SELECT run_id, CAST(floor(100 * sum(CASE state WHEN 'DONE' THEN 1.0 WHEN 'ACTIVE' THEN 0.5 ELSE 0.0 END)
           / count(*) + 0.5) AS BIGINT) AS percent FROM steps GROUP BY run_id""")
def _(t):
    return R.progress(_steps(t), ["run_id"])


@query("ag21_eta", f"""
    WITH {STEPS_SQL},
    a AS (SELECT run_id,
            avg(CASE WHEN state = 'DONE' THEN date_diff('microsecond', started_at, ended_at) END) AS mean,
            count(*) FILTER (WHERE state IN ('PENDING', 'ACTIVE')) AS remaining,
            coalesce(sum(CASE WHEN state = 'ACTIVE' THEN date_diff('microsecond', started_at, TIMESTAMP '{NOW}') END), 0) AS spent
          FROM steps GROUP BY run_id)
    SELECT run_id, CASE WHEN mean IS NULL THEN NULL WHEN remaining = 0 THEN 0
           ELSE CAST(floor(greatest(0.0, mean * remaining - spent) / 1e6 + 0.5) AS BIGINT) END AS eta_seconds FROM a""")
def _(t):
    return R.eta(_steps(t), ["run_id"], NOW)


@query("ag28_audit_timeline", "SELECT user_id AS session_id, ts, event_id, event_type AS event FROM events")
def _(t):
    return R.audit_timeline(t.events.select(
        F.col("user_id").alias("session_id"), "ts", "event_id", F.col("event_type").alias("event")))


@query("ag28_audit_counts", "SELECT user_id AS session_id, event_type AS event, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return R.audit_counts(t.events.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("event")))


@query("wn1_latest_report", """
    SELECT session_id, version, content FROM reports
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY version DESC) = 1""", "reports")
def _(t):
    return R.latest_by(t.reports.drop("role"), ["session_id"], ["version"])


@query("wn1_report_history", "SELECT session_id, version, content FROM reports", "reports")
def _(t):
    return R.history(t.reports.drop("role"))


@query("wn1_report_version", "SELECT session_id, version, content FROM reports WHERE session_id = 3 AND version = 2", "reports")
def _(t):
    return R.exact_version(t.reports.drop("role"), 3, 2)


@query("wn2_latest_by_project", """
    SELECT project_id, run_id, created_at FROM runs
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, run_id DESC) = 1""", "runs")
def _(t):
    return R.latest_by(t.runs.select("project_id", "run_id", "created_at"), ["project_id"], ["created_at", "run_id"])


PAUSES_SQL = """
    pauses AS (SELECT event_id AS id, user_id AS session_id, ts AS paused_at,
                 CASE WHEN value >= 50 THEN ts + INTERVAL 1 HOUR END AS resumed_at FROM events WHERE event_type = 'error')"""


@query("wn3_open_pause", f"""
    WITH {PAUSES_SQL} SELECT session_id, id, paused_at FROM pauses WHERE resumed_at IS NULL
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY paused_at DESC, id DESC) = 1""")
def _(t):
    pauses = t.events.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("ts").alias("paused_at"),
        F.when(F.col("value") >= 50, F.timestamp_add("HOUR", F.lit(1), F.col("ts"))).alias("resumed_at"),
    )
    return R.open_pause(pauses).select("session_id", "id", "paused_at")


@query("wn4_pair_pauses", """
    WITH l AS (SELECT user_id AS run_id, ts, event_id, CASE event_type WHEN 'error' THEN 'pause' ELSE 'resume' END AS action
               FROM events WHERE event_type IN ('error', 'purchase')),
    m AS (SELECT *, lag(action) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS prev FROM l),
    k AS (SELECT * FROM m WHERE (action = 'pause' AND coalesce(prev, 'resume') = 'resume') OR (action = 'resume' AND prev = 'pause')),
    p AS (SELECT *, lead(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS resumed_at FROM k)
    SELECT run_id, ts AS paused_at, resumed_at, date_diff('microsecond', ts, resumed_at) / 1e6 AS seconds
    FROM p WHERE action = 'pause'""")
def _(t):
    action = F.when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "purchase", "resume")
    log = t.events.select(F.col("user_id").alias("run_id"), "ts", "event_id", action.alias("action")).filter("action IS NOT NULL")
    return R.pair_pauses(ranged(log, ["run_id"], ["ts", "event_id"]), by_range())


@query("wn5_decisions_latest", """
    SELECT kind, "from", "to", seq FROM (
      SELECT event_type AS kind, 'u' || user_id AS "from", 'v' || CAST(floor(value) AS BIGINT) AS "to", event_id AS seq FROM events)
    QUALIFY row_number() OVER (PARTITION BY kind, "from" ORDER BY seq DESC) = 1""")
def _(t):
    decisions = t.events.select(
        F.col("event_type").alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("from"),
        F.concat(F.lit("v"), F.floor("value").cast("string")).alias("to"), F.col("event_id").alias("seq"))
    return R.latest_by(decisions, ["kind", "from"], ["seq"])


STREAK_SQL = """
    WITH l AS (SELECT user_id AS run_id, event_id, ts,
                 CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS f, CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS s FROM events),
    g AS (SELECT *, sum(s) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS grp FROM l),
    c AS (SELECT *, sum(f) OVER (PARTITION BY run_id, grp ORDER BY ts, event_id) AS streak FROM g)
    SELECT run_id, event_id, CAST(streak AS BIGINT) AS streak, CASE WHEN streak >= 3 THEN 'PAUSED' ELSE 'FAILED' END AS verdict
    FROM c WHERE f = 1"""


def outcomes(t):
    outcome = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success").otherwise("other")
    return t.events.select(F.col("user_id").alias("run_id"), "event_id", "ts", outcome.alias("outcome"))


@query("wn8_failure_streak", STREAK_SQL)
def _(t):
    return R.failure_streak(ranged(outcomes(t), ["run_id"], ["ts", "event_id"]), 3, by_range())


# Transition table over the job statuses of the status log, for the audit query.
LOG_TRANSITIONS = {
    "PENDING": ["ANALYZING", "FAILED"],
    "ANALYZING": ["MIGRATING", "FAILED"],
    "MIGRATING": ["DONE", "FAILED"],
    "DONE": [],
    "FAILED": [],
}
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, bs in LOG_TRANSITIONS.items() for b in bs)


@query("wn9_illegal_transitions", f"""
    WITH x AS (SELECT run_id, event_id, status, lag(status) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS prev FROM status_log)
    SELECT run_id, event_id, prev, status FROM x WHERE prev IS NOT NULL
    AND (prev, status) NOT IN (SELECT (a, b) FROM (VALUES {_ALLOWED}) AS v(a, b))""", "status_log")
def _(t):
    return R.illegal_transitions(ranged(t.status_log, ["run_id"], ["ts", "event_id"]), R.transition_table(t.spark, LOG_TRANSITIONS), by_range())


# Stage log: the stage is the hour-of-day third, the state comes from the status.
STAGES = ["analyse", "migrate", "validate"]
STAGE_LOG_SQL = """
    stage_log AS (SELECT run_id, ts, event_id,
        CASE WHEN hour(ts) < 8 THEN 'analyse' WHEN hour(ts) < 16 THEN 'migrate' ELSE 'validate' END AS stage,
        CASE status WHEN 'DONE' THEN 'DONE' WHEN 'FAILED' THEN 'ERROR' ELSE 'ACTIVE' END AS state FROM status_log)"""


def stage_log(t):
    hour = F.hour("ts")
    return t.status_log.select(
        "run_id", "ts", "event_id",
        F.when(hour < 8, "analyse").when(hour < 16, "migrate").otherwise("validate").alias("stage"),
        F.when(F.col("status") == "DONE", "DONE").when(F.col("status") == "FAILED", "ERROR").otherwise("ACTIVE").alias("state"))


@query("wn12_stage_durations", f"""
    WITH {STAGE_LOG_SQL},
    g AS (SELECT run_id, stage, min(ts) AS started_at, max(ts) AS last_at, arg_max(state, (ts, event_id)) AS state
          FROM stage_log GROUP BY 1, 2)
    SELECT run_id, stage, started_at, state,
           CASE WHEN state IN ('DONE', 'ERROR') THEN last_at ELSE TIMESTAMP '{NOW}' END AS ended_at,
           greatest(0, date_diff('microsecond', started_at,
             CASE WHEN state IN ('DONE', 'ERROR') THEN last_at ELSE TIMESTAMP '{NOW}' END)) / 1e6 AS seconds FROM g""", "status_log")
def _(t):
    return R.stage_durations(stage_log(t), NOW)


@query("wn12_backfilled_stages", f"""
    WITH {STAGE_LOG_SQL},
    g AS (SELECT run_id, stage, arg_max(state, (ts, event_id)) AS state FROM stage_log GROUP BY 1, 2),
    d AS (SELECT * FROM (VALUES ('analyse', 0), ('migrate', 1), ('validate', 2)) AS v(stage, pos)),
    m AS (SELECT run_id, max(pos) FILTER (WHERE state IN ('DONE', 'ACTIVE')) AS furthest FROM g JOIN d USING (stage) GROUP BY 1)
    SELECT m.run_id, d.stage, coalesce(g.state, CASE WHEN d.pos < m.furthest THEN 'DONE' ELSE 'PENDING' END) AS state
    FROM m CROSS JOIN d LEFT JOIN g ON g.run_id = m.run_id AND g.stage = d.stage""", "status_log")
def _(t):
    return R.backfilled_stages(R.stage_durations(stage_log(t), NOW), STAGES)


@query("wn14_page", """
    SELECT run_id, created_at, count(*) OVER () AS total_elements, CAST(ceil(count(*) OVER () / 50.0) AS BIGINT) AS total_pages
    FROM runs ORDER BY created_at DESC, run_id LIMIT 50 OFFSET 100""", "runs")
def _(t):
    return R.page(t.runs.select("run_id", "created_at"), 2, 50, "created_at", True, "run_id")


LATEST_EVENT_SQL = """
    SELECT user_id AS session_id, event_type AS runner, ts, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""


@query("snk2_upsert_latest", LATEST_EVENT_SQL)
def _(t):
    logs = t.events.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("runner"), "ts", "event_id", "value")
    old, new = logs.filter(F.col("ts") < "2024-01-16"), logs.filter(F.col("ts") >= "2024-01-16")
    return sinks.upsert_latest(old, new, ["session_id", "runner"], ["ts", "event_id"])


@query("snk3_append_versions", """
    WITH a AS (SELECT session_id, max(version) AS m FROM reports WHERE role <> 'user' GROUP BY 1)
    SELECT r.session_id, coalesce(a.m, 0) + row_number() OVER (PARTITION BY r.session_id ORDER BY r.version) AS version, content
    FROM reports r LEFT JOIN a USING (session_id) WHERE role = 'user'""", "reports")
def _(t):
    stored = t.reports.filter(F.col("role") != "user")
    batch = t.reports.filter(F.col("role") == "user").withColumnRenamed("version", "turn")
    return sinks.append_versions(stored, batch, "turn", id_slice("turn")).select("session_id", "version", "content")


AUDIT_SQL = """
    audit AS (SELECT id, coalesce(delivery_id, 'unknown') AS delivery_id, coalesce(event_type, 'unknown') AS event_type,
        CASE WHEN NOT signature_valid THEN 'FAILED' WHEN event_type IS NULL OR event_type NOT IN ('push', 'pull_request', 'ping') THEN 'SKIPPED'
             ELSE 'ACCEPTED' END AS status,
        CASE WHEN NOT signature_valid THEN 'Invalid or missing X-Hub-Signature-256'
             WHEN event_type IS NULL OR event_type NOT IN ('push', 'pull_request', 'ping')
             THEN 'Event type not supported: ' || coalesce(event_type, 'null') END AS error,
        received_at, payload FROM deliveries)"""
SUPPORTED = ["push", "pull_request", "ping"]


@query("snk6_audit_deliveries", f"""
    WITH {AUDIT_SQL} SELECT id, delivery_id, event_type, status, error,
    CASE WHEN status = 'ACCEPTED' THEN received_at END AS processed_at FROM audit""", "deliveries")
def _(t):
    return sinks.audit_deliveries(t.deliveries, SUPPORTED).select(
        "id", "delivery_id", "event_type", "status", "error", "processed_at")


@query("jn14_replay", f"""
    WITH {AUDIT_SQL} SELECT delivery_id || '-replay-1706702400000' AS delivery_id, event_type, 'ACCEPTED' AS status, payload,
    TIMESTAMP '{NOW}' AS processed_at, id AS replay_of FROM audit WHERE status <> 'ACCEPTED'""", "deliveries")
def _(t):
    now = NOW.replace(tzinfo=dt.timezone.utc)
    return sinks.replay(sinks.audit_deliveries(t.deliveries, SUPPORTED), now).select(
        "delivery_id", "event_type", "status", "payload", "processed_at", "replay_of")


@query("jn7_resolve_config", """
    WITH o AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN '  ' ELSE 'custom-' || s_suppkey END AS s_name,
                      CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 END AS s_acctbal FROM supplier WHERE s_nationkey < 15)
    SELECT s.s_suppkey, coalesce(CASE WHEN trim(o.s_name) <> '' THEN o.s_name END, s.s_name) AS s_name,
           coalesce(o.s_acctbal, s.s_acctbal) AS s_acctbal
    FROM supplier s LEFT JOIN o USING (s_suppkey)""")
def _(t):
    s = t.supplier
    override = s.filter(F.col("s_nationkey") < 15).select(
        "s_suppkey",
        F.when(F.col("s_suppkey") % 3 == 0, None).when(F.col("s_suppkey") % 3 == 1, "  ")
        .otherwise(F.concat(F.lit("custom-"), F.col("s_suppkey").cast("string"))).alias("s_name"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") + 1).alias("s_acctbal"))
    return R.resolve_config(s, override, "s_suppkey", ["s_name", "s_acctbal"]).select("s_suppkey", "s_name", "s_acctbal")
