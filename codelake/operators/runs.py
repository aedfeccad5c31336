"""Run and session lifecycle analytics on bounded tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelake.functions.dates import lit_like, ntz
from codelake.operators import slices

# Fixed enum values.
JOB_STATUSES = ["PENDING", "ANALYZING", "MIGRATING", "DONE", "FAILED", "CANCELLED"]
TERMINAL = ["DONE", "FAILED", "CANCELLED"]


def dimension(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    """A literal one-column table."""
    rows = ", ".join("('" + v.replace("'", "\\'") + "')" for v in values)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS d({name})")


def filter_runs(df: DataFrame, user=None, project=None, status=None, after=None, before=None) -> DataFrame:
    """Conjunction of the given predicates, both date ends inclusive, newest first."""
    for col, op, value in (
        ("user_id", "__eq__", user), ("project_id", "__eq__", project), ("status", "__eq__", status),
        ("created_at", "__ge__", after), ("created_at", "__le__", before),
    ):
        if value is not None:
            df = df.filter(getattr(F.col(col), op)(lit_like(df, col, value)))
    return df.orderBy(F.desc("created_at"), "run_id")


def stale(df: DataFrame, status: str, cutoff: dt.datetime) -> DataFrame:
    return df.filter((F.col("status") == status) & (F.col("updated_at") < lit_like(df, "updated_at", cutoff)))


def active(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("status").isin(TERMINAL)).orderBy("project_id", F.desc("created_at"), "run_id")


def search_runs(df: DataFrame, status: str = "ALL", text: str = "") -> DataFrame:
    needle = text.strip().lower()
    if status != "ALL":
        df = df.filter(F.col("status") == status)
    if needle:
        df = df.filter(
            F.lower(F.col("run_id").cast("string")).contains(needle)
            | F.lower(F.col("project_id").cast("string")).contains(needle)
        )
    return df


def retain(df: DataFrame, col: str, cutoff: dt.datetime) -> DataFrame:
    """Drop rows older than the cutoff."""
    return df.filter(F.col(col) >= lit_like(df, col, cutoff))


def domain_violations(df: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value is not in the enum (anti join to the literal dimension)."""
    dim = dimension(df.sparkSession, col, allowed)
    return df.join(dim, col, "left_anti")


def status_counts(runs: DataFrame, statuses: Sequence[str] = JOB_STATUSES) -> DataFrame:
    counted = runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    dim = dimension(runs.sparkSession, "status", statuses)
    return dim.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def org_summary(runs: DataFrame) -> DataFrame:
    done = F.col("status") == "DONE"
    micros = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("updated_at"))
    return runs.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.try_divide(F.count_if(done), F.count(F.lit(1))), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(F.when(done, micros)) / 1e6, F.lit(0.0)).alias("avg_seconds"),
    )


def status_share(runs: DataFrame) -> DataFrame:
    """Count and rounded percent per status; the window runs over the few status rows."""
    counted = runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    share = F.floor(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()) + 0.5)
    return counted.withColumn("percent", share).orderBy(F.desc("n"), "status")


def facets(runs: DataFrame) -> DataFrame:
    return (
        runs.rollup("status")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("status").alias("g"))
        .select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("status")).alias("status"), "n")
    )


def runs_by_day(df: DataFrame, ts: str, now: dt.datetime, n: int = 14) -> DataFrame:
    """Zero-filled histogram of the last ``n`` UTC days, today included."""
    last = now.date()
    first = last - dt.timedelta(days=n - 1)
    days = df.sparkSession.sql(
        f"SELECT date_format(d, 'yyyy-MM-dd') AS day FROM (SELECT explode(sequence(date'{first}', date'{last}')) AS d)"
    )
    counted = (
        df.filter((F.col(ts) >= lit_like(df, ts, first)) & (F.col(ts) < lit_like(df, ts, last + dt.timedelta(days=1))))
        .groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return days.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n")).orderBy("day")


def progress(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    score = F.sum(F.when(F.col("state") == "DONE", 1.0).when(F.col("state") == "ACTIVE", 0.5).otherwise(0.0))
    return steps.groupBy(*by).agg(
        F.floor(F.coalesce(100 * score / F.count("state"), F.lit(0.0)) + 0.5).alias("percent")
    )


def eta(steps: DataFrame, by: Sequence[str], now: dt.datetime) -> DataFrame:
    """Projected seconds left from the mean time of finished steps."""
    done = (F.col("state") == "DONE") & F.col("started_at").isNotNull() & F.col("ended_at").isNotNull()
    micros = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    mean = F.avg(F.when(done, micros(F.col("started_at"), F.col("ended_at"))))
    left = F.count_if(F.col("state").isin("PENDING", "ACTIVE"))
    spent = F.coalesce(
        F.sum(F.when(F.col("state") == "ACTIVE", micros(F.col("started_at"), ntz(now)))),
        F.lit(0),
    )
    return (
        steps.groupBy(*by)
        .agg(mean.alias("mean"), left.alias("left"), spent.alias("spent"))
        .select(
            *by,
            F.when(F.col("mean").isNull(), F.lit(None))
            .when(F.col("left") == 0, F.lit(0))
            .otherwise(F.floor(F.greatest(F.lit(0.0), F.col("mean") * F.col("left") - F.col("spent")) / 1e6 + 0.5))
            .cast("bigint").alias("eta_seconds"),
        )
    )


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key, by partial aggregation instead of a per-key sort."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The oldest row per key."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def history(df: DataFrame) -> DataFrame:
    return df.orderBy("session_id", F.desc("version"))


def exact_version(df: DataFrame, session, version: int) -> DataFrame:
    return df.filter((F.col("session_id") == F.lit(session)) & (F.col("version") == version))


def open_pause(pauses: DataFrame) -> DataFrame:
    return latest_by(pauses.filter(F.col("resumed_at").isNull()), ["session_id"], ["paused_at", "id"])


def pair_pauses(log: DataFrame, slice_by: Column) -> DataFrame:
    """Pause/resume log (run_id, ts, event_id, action) to pause intervals.

    A pause while paused and a resume while running are dropped first, which is
    what the session state machine does with them; then the next row closes a pause.
    """
    keys, order = ["run_id"], ["ts", "event_id"]
    log = log.filter(F.col("action").isin("pause", "resume"))
    log = slices.neighbour(log, keys, order, "action", "prev", slice_by)
    kept = log.filter(
        ((F.col("action") == "pause") & (F.coalesce("prev", F.lit("resume")) == "resume"))
        | ((F.col("action") == "resume") & (F.col("prev") == "pause"))
    )
    paired = slices.neighbour(kept.drop("prev"), keys, order, "ts", "resumed_at", slice_by, ahead=True)
    return paired.filter(F.col("action") == "pause").select(
        "run_id", F.col("ts").alias("paused_at"), "resumed_at",
        (F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("resumed_at")) / 1e6).alias("seconds"),
    )


def failure_streak(log: DataFrame, threshold: int, slice_by: Column) -> DataFrame:
    """Log (run_id, ts, event_id, outcome) to the failure streak at every failure.

    The counter resets only on success, so streak = failures so far minus failures
    at the last success.
    """
    keys, order = ["run_id"], ["ts", "event_id"]
    log = log.withColumn("_f", (F.col("outcome") == "failure").cast("bigint"))
    log = slices.running_sum(log, keys, order, "_f", "_failures", slice_by)
    log = log.withColumn("_mark", F.when(F.col("outcome") == "success", F.col("_failures")))
    log = slices.last_known(log, keys, order, "_mark", "_base", slice_by)
    streak = F.col("_failures") - F.coalesce("_base", F.lit(0))
    return log.filter(F.col("outcome") == "failure").select(
        "run_id", "event_id", streak.alias("streak"),
        F.when(streak >= threshold, "PAUSED").otherwise("FAILED").alias("verdict"),
    )


# Fixed transition table of the session state machine.
SESSION_TRANSITIONS = {
    "PENDING": ["CONTEXT_ANALYSED", "MIGRATING", "FAILED"],
    "CONTEXT_ANALYSED": ["PLAN_READY", "FAILED", "PAUSED"],
    "PLAN_READY": ["AWAITING_APPROVAL", "MIGRATING", "FAILED", "PAUSED"],
    "AWAITING_APPROVAL": ["MIGRATING", "FAILED", "PAUSED"],
    "MIGRATING": ["VALIDATING", "DONE", "FAILED", "PAUSED"],
    "VALIDATING": ["DONE", "FAILED", "PAUSED"],
    "PAUSED": ["CONTEXT_ANALYSED", "PLAN_READY", "AWAITING_APPROVAL", "MIGRATING", "VALIDATING", "FAILED"],
    "DONE": [],
    "FAILED": [],
}


def transition_table(spark: SparkSession, allowed: dict[str, list[str]] = SESSION_TRANSITIONS) -> DataFrame:
    rows = ", ".join(f"('{a}', '{b}')" for a, bs in allowed.items() for b in bs)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(prev, status)")


def illegal_transitions(log: DataFrame, allowed: DataFrame, slice_by: Column) -> DataFrame:
    """Rows whose (previous status, status) pair is not in the table."""
    log = slices.neighbour(log, ["run_id"], ["ts", "event_id"], "status", "prev", slice_by)
    return log.filter(F.col("prev").isNotNull()).join(allowed, ["prev", "status"], "left_anti").select(
        "run_id", "event_id", "prev", "status"
    )


def stage_durations(log: DataFrame, now: dt.datetime) -> DataFrame:
    """Start, end and seconds per (run, stage) of a log (run_id, stage, ts, event_id, state)."""
    last = F.max_by("state", F.struct("ts", "event_id"))
    span = log.groupBy("run_id", "stage").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), last.alias("state")
    )
    end = F.when(F.col("state").isin("DONE", "ERROR"), F.col("last_at")).otherwise(
        ntz(now)
    )
    micros = F.timestamp_diff("MICROSECOND", F.col("started_at"), end)
    return span.select(
        "run_id", "stage", "started_at", end.alias("ended_at"), "state",
        (F.greatest(F.lit(0), micros) / 1e6).alias("seconds"),
    )


def backfilled_stages(stages: DataFrame, order: Sequence[str]) -> DataFrame:
    """Every stage of every run: stages before the furthest DONE/ACTIVE one that never
    reported are DONE, later ones PENDING."""
    spark = stages.sparkSession
    ords = ", ".join(f"('{s}', {i})" for i, s in enumerate(order))
    dim = spark.sql(f"SELECT * FROM VALUES {ords} AS s(stage, pos)")
    placed = stages.join(dim, "stage")
    reached = placed.groupBy("run_id").agg(
        F.max(F.when(F.col("state").isin("DONE", "ACTIVE"), F.col("pos"))).alias("furthest")
    )
    grid = reached.select(
        "run_id", "furthest", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i).alias("pos"))
                                                   for i, s in enumerate(order)])).alias("s")
    ).select("run_id", "furthest", "s.stage", "s.pos")
    return grid.join(placed.select("run_id", "stage", "state"), ["run_id", "stage"], "left").select(
        "run_id", "stage",
        F.coalesce(
            "state", F.when(F.col("pos") < F.col("furthest"), "DONE").otherwise("PENDING")
        ).alias("state"),
    )


def rolling_failure(calls: DataFrame, slice_by: Column, n: int = 10, rate: float = 0.5) -> DataFrame:
    """Failure rate over the last ``n`` calls of a provider; open once ``n`` calls exist."""
    calls = calls.withColumn("_f", F.col("failed").cast("bigint"))
    calls = slices.trailing_mean(calls, ["provider"], ["ts", "event_id"], "_f", n, slice_by, "_s", "_n")
    return calls.select(
        "provider", "event_id", (F.col("_s") / F.col("_n")).alias("rate"),
        ((F.col("_n") >= n) & (F.col("_s") / F.col("_n") >= rate)).alias("open"),
    )


def page(df: DataFrame, page_no: int, size: int, sort: str, desc: bool, tie: str) -> DataFrame:
    """One page plus the total element and page counts on every row."""
    total = df.agg(F.count(F.lit(1)).alias("total_elements")).scalar()
    order = F.desc(sort) if desc else F.asc(sort)
    rows = df.orderBy(order, tie).offset(page_no * size).limit(size)
    return rows.withColumn("total_elements", total).withColumn(
        "total_pages", F.ceil(F.col("total_elements") / size)
    )


def audit_timeline(df: DataFrame) -> DataFrame:
    return df.orderBy("session_id", "ts", "event_id")


def audit_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("session_id", "event").agg(F.count(F.lit(1)).alias("n"))


def recent(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)


def resolve_config(system: DataFrame, override: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Override value when it is non-null and non-blank, else the system value."""
    o = override.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols])
    text = {f.name for f in system.schema.fields if f.dataType.simpleString() == "string"}

    def pick(c):
        over = F.col(f"_o_{c}")
        if c in text:
            over = F.when(F.trim(over) != "", over)
        return F.coalesce(over, F.col(c)).alias(c)

    kept = [c for c in system.columns if c not in cols]
    return system.join(o, key, "left").select(*kept, *[pick(c) for c in cols])
