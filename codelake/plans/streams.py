"""Batch forms of the stream operators, on the whole event tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from codelake.operators import runs as R
from codelake.operators import slices
from codelake.plans.ledger import DAILY_SQL
from codelake.plans.lifecycle import AUDIT_SQL, STREAK_SQL, SUPPORTED, outcomes
from codelake.plans.registry import query
from codelake.sources import messages as M
from codelake.sources import sinks
from codelake.streaming import machines
from codelake.streaming.folds import fold, session_states
from codelake.streaming.stateful import latest_progress

NOW = dt.datetime(2024, 1, 31, 12)
ORDER = ["ts", "event_id"]


@query("src5_parse_event", """
    SELECT 'k' || event_id AS key, 'u' || user_id AS user_id, CASE WHEN event_type = 'error' THEN '' ELSE 'zip-' || event_id END AS storage_key,
           CASE WHEN event_type = 'view' THEN 'SPRING_KAFKA_HYBRID' ELSE 'NATIVE_KAFKA_CLIENTS' END AS target
    FROM events WHERE event_type <> 'signup'""")
def _(t):
    u, e = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("zip-"), F.col("event_id").cast("string"))
    value = (
        F.when(F.col("event_type") == "error", u)
        .when(F.col("event_type") == "view", F.concat_ws("|", u, e, F.lit("SPRING_KAFKA_HYBRID")))
        .when(F.col("event_type") == "click", F.concat_ws("|", u, e, F.lit("SPRING_KAFKA_HYBRID|x")))
        .when(F.col("event_type") == "purchase", F.concat_ws("|", u, e))
    )
    return M.parse_event(t.events.select(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"), value.alias("value")))


MESSAGE = {"purchase": "DONE:out/", "error": "FAILED:code ", "view": "ANALYZING", "click": "MIGRATING", "signup": "HELLO"}


@query("src6_parse_status", """
    SELECT event_id, CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'ANALYZING' ELSE 'MIGRATING' END AS status,
           CASE event_type WHEN 'purchase' THEN 'out/' || event_id WHEN 'error' THEN 'code ' || event_id END AS detail
    FROM events WHERE event_type <> 'signup'""")
def _(t):
    value = F.lit(None).cast("string")
    for event, text in MESSAGE.items():
        full = F.concat(F.lit(text), F.col("event_id").cast("string")) if text[-1] in "/ " else F.lit(text)
        value = F.when(F.col("event_type") == event, full).otherwise(value)
    raw = t.events.select("event_id", F.col("user_id").cast("string").alias("key"), value.alias("value"))
    return M.parse_status(raw).select("event_id", "status", "detail")


PUSH_SQL = """
    SELECT o_orderkey, 'https://git.example.com/c' || o_custkey || '.git' AS repo_url,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'v' || o_orderkey ELSE 'release/' || lower(left(o_orderpriority, 1)) END AS branch,
           sha256(CAST(o_orderkey AS VARCHAR)) AS commit_sha
    FROM orders WHERE o_orderstatus <> 'P'"""


def _pushes(t):
    ref = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("refs/tags/v"), F.col("o_orderkey").cast("string"))).otherwise(
        F.concat(F.lit("refs/heads/release/"), F.lower(F.substring("o_orderpriority", 1, 1))))
    body = F.to_json(F.struct(
        F.struct(F.concat(F.lit("https://git.example.com/c"), F.col("o_custkey").cast("string"), F.lit(".git")).alias("clone_url")).alias("repository"),
        ref.alias("ref"),
        F.when(F.col("o_orderstatus") != "P", F.struct(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("id"))).alias("head_commit"),
        F.lit("x").alias("pusher")))
    return t.orders.withColumn("payload", body)


@query("src7_parse_push", PUSH_SQL)
def _(t):
    return M.parse_push(_pushes(t)).select("o_orderkey", "repo_url", "branch", "commit_sha")


@query("ss11_push_triggers", PUSH_SQL.replace("o_orderkey, 'https", "'d' || o_orderkey AS delivery_id, 'https") + " AND o_orderpriority <> '5-LOW'")
def _(t):
    d = _pushes(t).select(
        F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("delivery_id"), "payload",
        F.lit("push").alias("event_type"), F.when(F.col("o_orderpriority") == "5-LOW", "FAILED").otherwise("ACCEPTED").alias("status"))
    return M.trigger(d, True)


@query("ss1_run_state", """
    WITH x AS (SELECT *, min(CASE WHEN status IN ('DONE', 'FAILED') THEN (ts, event_id) END) OVER (PARTITION BY run_id) AS stop FROM status_log)
    SELECT run_id, status, event_id FROM x WHERE stop IS NULL OR (ts, event_id) <= stop
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) = 1""", "status_log")
def _(t):
    """Final state of every run: its first terminal row, else its last row."""
    terminal = F.col("status").isin(R.TERMINAL)
    rank = F.struct("ts", "event_id")
    row = F.struct("status", "event_id")
    best = F.coalesce(F.min_by(row, F.when(terminal, rank)), F.max_by(row, rank))
    return t.status_log.groupBy("run_id").agg(best.alias("r")).select("run_id", "r.status", "r.event_id")


# Fixed mapping of the event table to session actions.
ACTIONS = {"signup": "begin", "view": "plan", "click": "migrate", "purchase": "agent_ok", "error": "agent_failure"}


def session_log(t):
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.lit(None).cast("string")
    for event, name in ACTIONS.items():
        action = F.when(F.col("event_type") == event, name).otherwise(action)
    action = F.when((F.col("event_type") == "error") & (k < 80), "pause").when((F.col("event_type") == "view") & (k < 50), "resume").otherwise(action)
    return t.events.select(F.col("user_id").alias("run_id"), "event_id", "ts", action.alias("action"))


ALLOWED_SQL = ", ".join(f"('{a}', '{b}')" for a, bs in R.SESSION_TRANSITIONS.items() for b in bs)
SESSION_SQL = f"""
    WITH RECURSIVE allowed AS (SELECT * FROM (VALUES {ALLOWED_SQL}) AS v(a, b)),
    log AS (SELECT user_id AS run_id, event_id, CASE WHEN event_type = 'error' AND k < 80 THEN 'pause' WHEN event_type = 'view' AND k < 50 THEN 'resume'
              WHEN event_type = 'signup' THEN 'begin' WHEN event_type = 'view' THEN 'plan' WHEN event_type = 'click' THEN 'migrate'
              WHEN event_type = 'purchase' THEN 'agent_ok' ELSE 'agent_failure' END AS action,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
            FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
    want AS (SELECT *, CASE action WHEN 'begin' THEN 'CONTEXT_ANALYSED' WHEN 'plan' THEN 'PLAN_READY' WHEN 'migrate' THEN 'MIGRATING' WHEN 'pause' THEN 'PAUSED' END AS target FROM log),
    m AS (SELECT run_id, CAST(0 AS BIGINT) AS n, 'PENDING' AS status, CAST(NULL AS VARCHAR) AS paused_from, 0 AS errors, CAST(NULL AS BIGINT) AS event_id,
                 CAST(NULL AS VARCHAR) AS action, true AS accepted FROM (SELECT DISTINCT run_id FROM log)
          UNION ALL
          SELECT run_id, n, CASE WHEN NOT ok THEN status WHEN action = 'resume' THEN paused_from WHEN action = 'agent_ok' THEN status ELSE tgt END,
                 CASE WHEN ok AND action = 'resume' THEN NULL WHEN ok AND tgt = 'PAUSED' THEN status ELSE paused_from END, errs, event_id, action, ok
          FROM (SELECT m.run_id, w.n, m.status, m.paused_from, w.event_id, w.action, e.errs, e.tgt,
                  CASE WHEN w.action = 'resume' THEN m.status = 'PAUSED' AND m.paused_from IS NOT NULL WHEN w.action = 'agent_ok' THEN true
                       ELSE EXISTS (SELECT 1 FROM allowed WHERE a = m.status AND b = e.tgt) END AS ok
                FROM m JOIN want w ON w.run_id = m.run_id AND w.n = m.n + 1,
                LATERAL (SELECT CASE w.action WHEN 'agent_failure' THEN m.errors + 1 WHEN 'agent_ok' THEN 0 ELSE m.errors END AS errs,
                                CASE WHEN w.action <> 'agent_failure' THEN w.target WHEN m.errors + 1 >= 3 THEN 'PAUSED' ELSE 'FAILED' END AS tgt) e))
    SELECT run_id, event_id, action, accepted, status, paused_from, errors FROM m WHERE n > 0"""


@query("ss2_session_state", SESSION_SQL)
def _(t):
    return session_states(session_log(t), 3)


@query("ss3_auto_pause", STREAK_SQL)
def _(t):
    return R.failure_streak(slices.ranged(outcomes(t), ["run_id"], ORDER), 3, slices.by_range())


@query("ss4_approval_timeout", f"""
    WITH x AS (SELECT *, lead(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS next_ts FROM status_log)
    SELECT run_id, ts AS waiting_since, 'FAILED' AS status, 'system:approval-timeout' AS decided_by FROM x
    WHERE status = 'PENDING' AND date_diff('microsecond', ts, coalesce(next_ts, TIMESTAMP '{NOW}')) > 1800000000""", "status_log")
def _(t):
    log = slices.neighbour(slices.ranged(t.status_log, ["run_id"], ORDER), ["run_id"], ORDER, "ts", "next_ts", slices.by_range(), ahead=True)
    waited = F.timestamp_diff("MICROSECOND", F.col("ts"), F.coalesce("next_ts", F.lit(NOW).cast("timestamp_ntz")))
    return log.filter((F.col("status") == "PENDING") & (waited > 30 * 60 * 1_000_000)).select(
        "run_id", F.col("ts").alias("waiting_since"), F.lit("FAILED").alias("status"), F.lit("system:approval-timeout").alias("decided_by"))


@query("ss5_rate_limit", """
    WITH RECURSIVE l AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST([] AS BIGINT[]) AS log, true AS accepted FROM l
          UNION ALL
          SELECT l.user_id, l.n, l.event_id, CASE WHEN len(kept) < 3 THEN list_distinct(list_append(kept, ms)) ELSE kept END, len(kept) < 3
          FROM r JOIN l ON l.user_id = r.user_id AND l.n = r.n + 1,
          LATERAL (SELECT list_filter(r.log, lambda x: x > l.ms - 43200000) AS kept) k)
    SELECT user_id, event_id, accepted FROM r WHERE n > 0""")
def _(t):
    return fold(t.events, ["user_id"], ORDER, "ts", machines.RateLimit(3, 12 * 3_600_000), keep=["user_id", "event_id"])


@query("ss6_lockout", """
    WITH RECURSIVE l AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, event_type = 'signup' AS success,
                                row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('error', 'signup')),
    r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, 0 AS fails, CAST(0 AS BIGINT) AS fails_end, CAST(0 AS BIGINT) AS lock_end,
                 0 AS locks, CAST(0 AS BIGINT) AS locks_end, false AS blocked, CAST(NULL AS BIGINT) AS secs FROM l
          UNION ALL
          SELECT l.user_id, l.n, l.event_id, f, CASE WHEN l.success THEN r.fails_end ELSE l.ms + 300000 END,
                 CASE WHEN l.success THEN 0 WHEN f >= 2 THEN l.ms + s * 1000 ELSE r.lock_end END,
                 CASE WHEN f >= 2 THEN k + 1 ELSE r.locks END, CASE WHEN f >= 2 THEN l.ms + 86400000 ELSE r.locks_end END,
                 l.ms < r.lock_end, CASE WHEN f >= 2 THEN s END
          FROM r JOIN l ON l.user_id = r.user_id AND l.n = r.n + 1,
          LATERAL (SELECT CASE WHEN l.success THEN 0 WHEN l.ms < r.fails_end THEN r.fails + 1 ELSE 1 END AS f, CASE WHEN l.ms < r.locks_end THEN r.locks ELSE 0 END AS k) a,
          LATERAL (SELECT CAST(least(60 * pow(2, least(a.k, 5)), 3600) AS BIGINT) AS s) b)
    SELECT user_id, event_id, blocked, fails AS failures, secs AS lock_seconds FROM r WHERE n > 0""")
def _(t):
    tries = t.events.filter(F.col("event_type").isin("error", "signup")).withColumn("success", F.col("event_type") == "signup")
    return fold(tries, ["user_id"], ORDER, "ts", machines.Lockout(max_attempts=2), keep=["user_id", "event_id"])


@query("ss7_dedup_deliveries", "SELECT id, delivery_id FROM deliveries WHERE delivery_id IS NOT NULL", "deliveries")
def _(t):
    d = t.deliveries.filter("delivery_id IS NOT NULL").select("delivery_id", "id", "received_at")
    again = d.withColumn("received_at", F.timestamp_add("MINUTE", F.lit(3), F.col("received_at")).cast("timestamp_ntz")).withColumn("id", F.col("id") + 1)
    return R.first_by(d.unionByName(again), ["delivery_id"], ["received_at", "id"]).select("id", "delivery_id")


@query("ss8_daily_cost_window", DAILY_SQL, "ledger")
def _(t):
    return (
        t.ledger.groupBy(F.window("created_at", "1 day"), "provider", "tier", "agent")
        .agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
             F.sum("cost_usd").cast("double").alias("cost_usd"), F.count(F.lit(1)).alias("calls"), F.count_if("cache_hit").alias("cache_hits"))
        .withColumn("day", F.date_format("window.start", "yyyy-MM-dd")).drop("window"))


def progress_log(t):
    return t.events.select(
        (F.col("user_id") % 50).alias("job_id"), F.col("event_type").alias("stage"), "ts", "event_id",
        F.when(F.col("value") < 20, "done").when(F.col("value") < 60, "FAILED").otherwise("thinking").alias("status"))


@query("ss9_latest_progress", """
    SELECT user_id % 50 AS job_id, event_type AS stage, CASE WHEN value < 20 THEN 'DONE' WHEN value < 60 THEN 'FAILED' ELSE 'RUNNING' END AS status
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 50, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def _(t):
    return latest_progress(progress_log(t))


def cache_log(t):
    """Views are cache reads, every other status is a write."""
    return t.status_log.withColumn("is_read", F.col("status") == "ANALYZING")


@query("ss10_cached_status", """
    WITH w AS (SELECT * FROM status_log WHERE status <> 'ANALYZING'), r AS (SELECT * FROM status_log WHERE status = 'ANALYZING')
    SELECT r.run_id, r.event_id, arg_max(w.status, (w.ts, w.event_id)) AS cached FROM r LEFT JOIN w ON w.run_id = r.run_id
      AND (w.ts, w.event_id) < (r.ts, r.event_id) AND epoch_ms(r.ts) - epoch_ms(w.ts) < 86400000 GROUP BY 1, 2""", "status_log")
def _(t):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    log = cache_log(t).withColumn("ms", ms)
    log = log.withColumn("_w", F.when(~F.col("is_read"), F.struct("status", "ms")))
    log = slices.last_known(slices.ranged(log, ["run_id"], ORDER), ["run_id"], ORDER, "_w", "_e", slices.by_range())
    return log.filter("is_read").select("run_id", "event_id", F.when(F.col("ms") - F.col("_e.ms") < 86_400_000, F.col("_e.status")).alias("cached"))


def token_log(t):
    """Signups issue a token, clicks rotate one, errors log out; token names come from the row."""
    k = F.get_json_object("props", "$.k").cast("int")
    name = lambda n: F.concat(F.lit("t"), (n % 6).cast("string"))
    kind = F.when(F.col("event_type") == "signup", "issue").when(F.col("event_type") == "error", "logout").otherwise("rotate")
    return t.events.select("user_id", "event_id", "ts", kind.alias("kind"), name(k).alias("token"), name(k + 1).alias("new_token"),
                           (F.floor("value") * 36_000_00).cast("bigint").alias("ttl_ms"))


@query("ss12_token_replay", """
    WITH RECURSIVE l AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, CAST(floor(value) * 3600000 AS BIGINT) AS ttl,
            CASE event_type WHEN 'signup' THEN 'issue' WHEN 'error' THEN 'logout' ELSE 'rotate' END AS kind,
            't' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 AS token, 't' || (CAST(json_extract_string(props, '$.k') AS INTEGER) + 1) % 6 AS new_token,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST([] AS STRUCT(token VARCHAR, revoked BOOLEAN, expires BIGINT)[]) AS family, '' AS result FROM l
          UNION ALL
          SELECT l.user_id, l.n, l.event_id,
                 CASE b.result WHEN 'issued' THEN list_append(list_filter(r.family, lambda x: x.token <> l.token), {'token': l.token, 'revoked': false, 'expires': l.ms + l.ttl})
                      WHEN 'rotated' THEN list_append(list_filter(list_transform(r.family, lambda x: {'token': x.token, 'revoked': x.revoked OR x.token = l.token, 'expires': x.expires}), lambda x: x.token <> l.new_token),
                                                      {'token': l.new_token, 'revoked': false, 'expires': l.ms + l.ttl})
                      WHEN 'revoked' THEN list_transform(r.family, lambda x: {'token': x.token, 'revoked': true, 'expires': x.expires})
                      WHEN 'replay' THEN list_transform(r.family, lambda x: {'token': x.token, 'revoked': true, 'expires': x.expires}) ELSE r.family END, b.result
          FROM r JOIN l ON l.user_id = r.user_id AND l.n = r.n + 1,
          LATERAL (SELECT list_filter(r.family, lambda x: x.token = l.token) AS held) a,
          LATERAL (SELECT CASE WHEN l.kind = 'issue' THEN 'issued' WHEN l.kind = 'logout' THEN 'revoked' WHEN len(a.held) = 0 THEN 'unknown'
                               WHEN a.held[1].revoked THEN 'replay' WHEN l.ms >= a.held[1].expires THEN 'expired' ELSE 'rotated' END AS result) b)
    SELECT user_id, event_id, result FROM r WHERE n > 0""")
def _(t):
    return fold(token_log(t), ["user_id"], ORDER, "ts", machines.TokenReplay(), keep=["user_id", "event_id"])
