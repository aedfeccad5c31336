"""Queries over the usage ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from codelake.operators import usage
from codelake.operators.runs import rolling_failure
from codelake.operators.slices import by_range, ranged
from codelake.plans.registry import query
from codelake.sources.sinks import usage_csv_lines

FROM, TO = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)
NOW = dt.datetime(2024, 1, 21, 12)

# Fixed price list, USD per million tokens.
PRICES = [("p0", 3.0, 15.0), ("p1", 0.25, 1.25), ("p2", 2.5, 10.0), ("p3", 0.15, 0.6)]
PRICE_VALUES = ", ".join(f"('{p}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for p, i, o in PRICES)
PRICE_SQL = f"SELECT * FROM (VALUES {PRICE_VALUES}) AS t(provider, input_per_million, output_per_million)"

USAGE_SQL = """
    SELECT agent, provider, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
           CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
           CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, count(*) AS calls
    FROM ledger WHERE created_at >= TIMESTAMP '{0}' AND created_at < TIMESTAMP '{1}'
    GROUP BY agent, provider"""


@query("ag1_usage_by_agent", USAGE_SQL.format(FROM, TO), "ledger")
def _(t):
    return usage.usage_by_agent(t.ledger, FROM, TO)


@query("flt2_time_range", f"SELECT call_id, provider FROM ledger WHERE created_at >= TIMESTAMP '{FROM}' "
       f"AND created_at < TIMESTAMP '{TO}'", "ledger")
def _(t):
    return usage.time_range(t.ledger, "created_at", FROM, TO).select("call_id", "provider")


@query("ag2_token_summary", """
    SELECT provider, tier, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
           CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
           CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens
    FROM ledger GROUP BY provider, tier""", "ledger")
def _(t):
    return usage.token_summary(t.ledger)


@query("ag3_budget_status", """
    SELECT CAST(coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) AS used,
           coalesce(sum(input_tokens + output_tokens), 0) >= 1000000 AS exhausted
    FROM ledger WHERE created_at >= TIMESTAMP '2024-01-01'""", "ledger")
def _(t):
    return usage.budget_status(t.ledger, NOW, 1_000_000)


DAILY_SQL = """
    SELECT strftime(created_at, '%Y-%m-%d') AS day, provider, tier, agent,
           CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
           CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, count(*) AS calls,
           count(*) FILTER (WHERE cache_hit) AS cache_hits
    FROM ledger GROUP BY 1, 2, 3, 4"""


@query("ag4_daily_cost", DAILY_SQL, "ledger")
def _(t):
    return usage.daily_cost(t.ledger)


@query("snk7_refresh_daily", DAILY_SQL, "ledger")
def _(t):
    """A rollup built while the last days were half full, then refreshed for those days."""
    late = ["2024-01-29", "2024-01-30"]
    stale = usage.daily_cost(usage.time_range(t.ledger, "created_at", None, dt.datetime(2024, 1, 29, 12)))
    return usage.merge_daily(stale, t.ledger, late)


@query("ag10_cost_by_provider",
       "SELECT provider, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd FROM ledger GROUP BY provider", "ledger")
def _(t):
    return usage.cost_by_provider(t.ledger)


@query("ag10_totals", """
    SELECT CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, count(*) AS calls,
           CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens
    FROM ledger""", "ledger")
def _(t):
    return usage.totals(t.ledger)


for _name, _from in (("mtd", "2024-01-01 00:00:00"), ("7d", "2024-01-14 12:00:00"),
                     ("30d", "2023-12-22 12:00:00"), ("90d", "2023-10-23 12:00:00")):
    def _period(t, name=_name):
        return usage.usage_by_agent(t.ledger, *usage.period(NOW, name))

    query(f"ag11_usage_{_name}", USAGE_SQL.format(_from, NOW), "ledger")(_period)


@query("ag19_hit_rate", """
    SELECT provider, hits, misses, CAST(hits AS DOUBLE) / (hits + misses) AS rate,
           hits + misses >= 10 AND CAST(hits AS DOUBLE) / (hits + misses) < 0.2 AS alert
    FROM (SELECT provider, count(*) FILTER (WHERE cache_hit) AS hits,
                 count(*) FILTER (WHERE NOT cache_hit) AS misses FROM ledger GROUP BY provider)""", "ledger")
def _(t):
    return usage.hit_rate(t.ledger)


def _priced(t):
    return usage.price_usage(t.ledger, t.spark.sql(PRICE_SQL))


@query("jn16_price_usage", f"""
    WITH prices AS ({PRICE_SQL})
    SELECT call_id, provider, round(coalesce(input_tokens / 1e6 * input_per_million, 0)
           + coalesce(output_tokens / 1e6 * output_per_million, 0), 9) AS estimate
    FROM ledger LEFT JOIN prices USING (provider)""", "ledger")
def _(t):
    return _priced(t).select("call_id", "provider", F.round("estimate", 9).alias("estimate"))


@query("fn16_price_estimate", f"""
    WITH prices AS ({PRICE_SQL})
    SELECT provider, floor(round(sum(coalesce(input_tokens / 1e6 * input_per_million, 0)
           + coalesce(output_tokens / 1e6 * output_per_million, 0)), 7) * 1000 + 0.5) / 1000 AS estimate
    FROM ledger LEFT JOIN prices USING (provider) GROUP BY provider""", "ledger")
def _(t):
    from codelake.functions.numbers import round_half_up

    return _priced(t).groupBy("provider").agg(
        round_half_up(F.round(F.sum("estimate"), 7)).alias("estimate")
    )


@query("snk4_usage_csv", """
    SELECT '"' || replace(agent || ',' || provider, '"', '""') || '"' || ',' || provider || ',' || count(*) || ','
           || sum(input_tokens) || ',' || sum(output_tokens) || ',' || CAST(sum(cost_usd) AS DECIMAL(18,6)) AS line
    FROM ledger GROUP BY agent, provider""", "ledger")
def _(t):
    used = usage.usage_by_agent(t.ledger, None, None)
    return usage_csv_lines(used.withColumn("agent", F.concat_ws(",", "agent", "provider")))


@query("wn13_rolling_failure", """
    WITH w AS (SELECT provider, event_id, avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END) OVER f AS rate,
                      count(*) OVER f AS n
               FROM (SELECT 'p' || (user_id % 5) AS provider, event_id, ts, event_type = 'error' AS failed FROM events)
               WINDOW f AS (PARTITION BY provider ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT provider, event_id, CAST(rate AS DOUBLE) AS rate, n >= 10 AND rate >= 0.5 AS open FROM w""")
def _(t):
    calls = t.events.select(
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("provider"),
        "event_id", "ts", (F.col("event_type") == "error").alias("failed"),
    )
    return rolling_failure(ranged(calls, ["provider"], ["ts", "event_id"]), by_range())


@query("st1_recent", "SELECT run_id, created_at FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 6", "runs")
def _(t):
    from codelake.operators.runs import recent

    return recent(t.runs, 6).select("run_id", "created_at")


@query("st2_tier_order", """
    SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_nationkey % 2 = 0 THEN 0 ELSE 1 END, s_suppkey) - 1 AS pos
    FROM supplier""")
def _(t):
    from codelake.operators.sorts import positions, tier_key

    return positions(t.supplier, tier_key(F.col("s_nationkey") % 2 == 0), "s_suppkey").select("s_suppkey", "pos")


@query("st3_explicit_order", """
    SELECT s_suppkey, row_number() OVER (ORDER BY
             CASE s_suppkey WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 5 THEN 3 ELSE 4 END, s_suppkey) - 1 AS pos
    FROM supplier""")
def _(t):
    from codelake.operators.sorts import explicit_key, positions

    return positions(t.supplier, explicit_key("s_suppkey", [7, 3, -1, 5]), "s_suppkey").select("s_suppkey", "pos")
