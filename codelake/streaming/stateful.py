"""Structured Streaming forms of the keyed state operators."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codelake.sources.messages import trigger
from codelake.streaming import machines

WATERMARK = "10 minutes"
# Processors open their state in workers without a session, so these are no DDL strings.
STATE = T.StructType([T.StructField("json", T.StringType())])
CLOCK = T.StructType([T.StructField("ms", T.LongType()), T.StructField("due", T.LongType())])
WAITING = T.StructType([T.StructField("us", T.LongType()), T.StructField("json", T.StringType())])


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def _micros(stamps: pd.Series) -> list[int]:
    return [int(pd.Timestamp(v).value // 1000) for v in stamps]


class EventTimeProcessor(StatefulProcessor):
    """Runs a machine per key in event order, whatever order the rows come in.

    Rows wait in state until the watermark has passed them; then a timer releases them
    sorted by ``order``.  A row that comes behind the watermark can't be put in order any
    more: it goes out at once with ``late`` set and changes no state.  A machine with a
    deadline gets its turn when the watermark passes it.  The state of a key goes ``ttl_ms``
    after its last row.

    Spark itself drops rows behind its own watermark, so that one runs ``late_ms`` behind
    the watermark that counts here; what comes later still is in the progress metrics
    (``numRowsDroppedByWatermark``).
    """

    def __init__(self, machine, ts: str, keep: Sequence[str], order: Sequence[str], ttl_ms: int | None, late_ms: int):
        self.machine, self.ts, self.keep = machine, ts, list(keep)
        self.order = [c for c in order if c != ts]
        self.ttl_ms, self.late_ms = ttl_ms, late_ms
        self.columns = list(dict.fromkeys([*self.order, *self.keep, *machine.inputs]))
        self.names = [*self.keep, *[c.split()[0] for c in machine.outputs.split(", ")], "late"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", STATE)
        self.last = handle.getValueState("last", CLOCK)
        self.waiting = handle.getListState("waiting", WAITING)

    def _passed(self, timers) -> float:
        """The watermark in milliseconds; none before the first rows."""
        mark = timers.getCurrentWatermarkInMs()
        return mark + self.late_ms if mark > 0 else -math.inf

    def _run(self, key, fresh: list[tuple[int, str]], passed: float, fired: bool = False) -> Iterator[pd.DataFrame]:
        late = [row for row in fresh if row[0] // 1000 <= passed]
        held = [(us, text) for us, text in self.waiting.get()] if self.waiting.exists() else []
        held += [row for row in fresh if row[0] // 1000 > passed]
        ready = [row for row in held if row[0] // 1000 <= passed]
        left = [row for row in held if row[0] // 1000 > passed]
        rows = [(us, dict(zip(self.columns, json.loads(text), strict=True))) for us, text in ready]
        rows.sort(key=lambda r: (r[0], *[(r[1][c] is not None, r[1][c]) for c in self.order]))
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.machine.start()
        last, due = self.last.get() if self.last.exists() else (None, None)
        due = None if fired else due  # a timer goes when it has fired
        blank = [None] * (len(self.names) - len(self.keep) - 1)
        parse = lambda text: dict(zip(self.columns, json.loads(text), strict=True))
        out = [(*[parse(text)[c] for c in self.keep], *blank, True) for _, text in late]
        for us, row in rows:
            self._expire(state, us // 1000 - 1, key, out)
            if last is not None and self.ttl_ms is not None and us // 1000 > last + self.ttl_ms:
                state = self.machine.start()
            values = self.machine.step(state, us // 1000, *[row[c] for c in self.machine.inputs])
            if values is not None:
                out.append((*[row[c] for c in self.keep], *values, False))
            last = us // 1000
        self._expire(state, passed, key, out)
        self._store(state, last, due, left, passed)
        yield pd.DataFrame(out, columns=self.names)

    def _expire(self, state, until: float, key, out: list) -> None:
        deadline = getattr(self.machine, "deadline", lambda _: None)(state)
        if deadline is not None and deadline <= until:
            out.append((*key, *self.machine.expire(state), False))

    def _store(self, state, last, due, left, passed) -> None:
        if last is not None and self.ttl_ms is not None and not left and last + self.ttl_ms <= passed:
            last = None
        if last is None and not left:
            for held in (self.state, self.last, self.waiting):
                held.clear()
            self._alarm(due, None)
            return
        if last is not None:
            self.state.update((json.dumps(state, sort_keys=True),))
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        times = [us // 1000 for us, _ in left]
        if last is not None:
            times += [t for t in (getattr(self.machine, "deadline", lambda _: None)(state),) if t is not None]
            if self.ttl_ms is not None and not left:
                times.append(last + self.ttl_ms)
        # a timer fires once Spark's watermark, late_ms behind, is past it
        now = min(times) - self.late_ms - 1 if times else None
        self._alarm(due, now)
        self.last.update((last, now))

    def _alarm(self, old, new) -> None:
        if old == new:
            return
        if old is not None and old in set(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if new is not None:
            self.handle.registerTimer(new)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The rows of one key in one micro-batch; the source's rate limit bounds them.
        pdf = pd.concat(list(rows))
        columns = [[None if pd.isna(v) else v for v in pdf[c].tolist()] for c in self.columns]
        fresh = [(us, json.dumps(values)) for us, *values in zip(_micros(pdf[self.ts]), *columns, strict=True)]
        yield from self._run(key, fresh, self._passed(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(key, [], self._passed(timerValues), fired=True)

    def close(self) -> None:
        pass


#: How long a key's state outlives its last row where the machine doesn't say.
KEPT_MS = 90 * 86_400_000
#: A row that comes this much behind the watermark still reaches the late output.
LATE_MS = 30 * 86_400_000


def run_machine(stream: DataFrame, machine, keys: Sequence[str], ts: str, keep: Sequence[str],
                order: Sequence[str], lateness: str = "0 seconds", ttl_ms: int | None = None, late_ms: int = LATE_MS) -> DataFrame:
    """Apply a machine to a stream in event order; ``late`` marks rows that came more than ``lateness`` behind.

    One row for every row that the machine answers.  Without ``ttl_ms`` a key's state lives
    as long after its last row as the machine can need it (``memory_ms``), else 90 days.
    """
    fields = ", ".join(f"{n} {stream.schema[n].dataType.simpleString()}" for n in keep)
    behind = int(_interval_ms(lateness)) + late_ms
    ttl_ms = ttl_ms if ttl_ms is not None else getattr(machine, "memory_ms", KEPT_MS)
    return stream.withWatermark(ts, f"{behind} milliseconds").groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=EventTimeProcessor(machine, ts, keep, order, ttl_ms, late_ms),
        outputStructType=_schema(f"{fields}, {machine.outputs}, late boolean"),
        outputMode="Append", timeMode="EventTime",
    )


def _interval_ms(text: str) -> float:
    return pd.Timedelta(text) / pd.Timedelta(milliseconds=1)


def split_late(out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows in order, late rows) of a machine's output."""
    return out.filter("NOT late").drop("late"), out.filter("late")


def run_state(stream: DataFrame, **time) -> DataFrame:
    return run_machine(stream, machines.RunState(), ["run_id"], "ts", ["run_id", "event_id"], ["ts", "event_id"], **time)


def session_state(stream: DataFrame, threshold: int = 3, **time) -> DataFrame:
    """All events with their verdict; ``accepted = false`` rows are the side output."""
    return run_machine(stream, machines.SessionState(threshold), ["run_id"], "ts", ["run_id", "event_id", "action"], ["ts", "event_id"], **time)


def auto_pause(stream: DataFrame, threshold: int = 3, **time) -> DataFrame:
    return run_machine(stream, machines.AutoPause(threshold), ["run_id"], "ts", ["run_id", "event_id"], ["ts", "event_id"], **time)


def rate_limit(stream: DataFrame, limit: int, window_ms: int, keys: Sequence[str], **time) -> DataFrame:
    return run_machine(stream, machines.RateLimit(limit, window_ms), keys, "ts", [*keys, "event_id"], ["ts", "event_id"], **time)


def lockout(stream: DataFrame, keys: Sequence[str], **time) -> DataFrame:
    return run_machine(stream, machines.Lockout(), keys, "ts", [*keys, "event_id"], ["ts", "event_id"], **time)


def token_replay(stream: DataFrame, forget_ms: int | None = None, **time) -> DataFrame:
    return run_machine(stream, machines.TokenReplay(forget_ms), ["user_id"], "ts", ["user_id", "event_id"], ["ts", "event_id"], **time)


def approval_timeout(stream: DataFrame, minutes: int = 30, waiting: str = "AWAITING_APPROVAL", lateness: str = WATERMARK, **time) -> DataFrame:
    """Runs that wait for approval longer than the limit, once event time is past it, even if no row follows."""
    out = run_machine(stream, machines.ApprovalTimeout(minutes * 60_000, waiting), ["run_id"], "ts", ["run_id"], ["ts", "event_id"], lateness, **time)
    return out.withColumn("waiting_since", F.timestamp_millis("waiting_ms")).select("run_id", "waiting_since", "status", "decided_by", "late")


def dedup_deliveries(stream: DataFrame) -> DataFrame:
    """First row per delivery id within the watermark."""
    return stream.withWatermark("received_at", WATERMARK).dropDuplicatesWithinWatermark(["delivery_id"])


def stream_daily_cost(stream: DataFrame) -> DataFrame:
    """The daily rollup as a tumbling event-time window."""
    return (
        stream.withWatermark("created_at", WATERMARK)
        .groupBy(F.window("created_at", "1 day"), "provider", "tier", "agent")
        .agg(
            F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
            F.sum("cost_usd").cast("double").alias("cost_usd"), F.count(F.lit(1)).alias("calls"),
            F.count_if("cache_hit").alias("cache_hits"),
        )
        .withColumn("day", F.date_format("window.start", "yyyy-MM-dd")).drop("window")
    )


# Fixed progress statuses; anything else counts as running.
PROGRESS = ["PENDING", "RUNNING", "DONE", "FAILED"]


def latest_progress(df: DataFrame) -> DataFrame:
    """Newest status per (job, stage); batch and streaming (update mode)."""
    status = F.when(F.upper("status").isin(PROGRESS), F.upper("status")).otherwise("RUNNING")
    return df.groupBy("job_id", "stage").agg(F.max_by(status, F.struct("ts", "event_id")).alias("status"))


def progress_stream(stream: DataFrame, **time) -> DataFrame:
    """(job, stage, event, status) of every row in event order; a pair's last row is its progress, and its state goes after the TTL."""
    status = F.when(F.upper("status").isin(PROGRESS), F.upper("status")).otherwise("RUNNING")
    rows = stream.withColumn("status", status)
    return run_machine(rows, machines.Latest(), ["job_id", "stage"], "ts", ["job_id", "stage", "event_id"], ["ts", "event_id"], **time)


DAY_MS = 86_400_000


def cached_status_stream(stream: DataFrame, ttl_ms: int = DAY_MS, **time) -> DataFrame:
    """Reads with the status written within ``ttl_ms`` before them; an entry leaves the state when that time is over."""
    return run_machine(stream, machines.StatusCache(ttl_ms), ["run_id"], "ts", ["run_id", "event_id"], ["ts", "event_id"], **time)


def push_triggers(stream: DataFrame, enabled: bool) -> DataFrame:
    return trigger(stream, enabled)
