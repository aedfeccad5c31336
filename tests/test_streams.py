"""Stateful operators: literal cases, hot-key folds, and stream equals batch."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codelake.operators import runs as R
from codelake.operators import slices
from codelake.plans import ledger, lifecycle, streams  # noqa: F401
from codelake.plans.registry import QUERIES, Tables
from codelake.sources.messages import read_events
from codelake.streaming import folds, machines
from codelake.streaming import stateful as S
from codelake.streaming.folds import fold
from codelake.views import open_view
from conftest import SMALL, rows

T0 = dt.datetime(2024, 1, 1)


def play(machine, *steps):
    state = machine.start()
    return [machine.step(state, *s) for s in steps]


def test_run_state_absorbs_terminal():
    got = play(machines.RunState(), (0, "ANALYZING"), (1, "BOGUS"), (2, "DONE"), (3, "FAILED"))
    assert got == [("ANALYZING", True), ("ANALYZING", False), ("DONE", True), ("DONE", False)]


def test_session_transitions_and_resume():
    m = machines.SessionState(3)
    got = play(m, *[(0, a) for a in ["pause", "complete", "begin", "plan", "pause", "pause", "resume", "resume", "migrate", "complete", "fail"]])
    assert [(g[0], g[1]) for g in got] == [
        (False, "PENDING"), (False, "PENDING"), (True, "CONTEXT_ANALYSED"), (True, "PLAN_READY"), (True, "PAUSED"), (False, "PAUSED"),
        (True, "PLAN_READY"), (False, "PLAN_READY"), (True, "MIGRATING"), (True, "DONE"), (False, "DONE")]


def test_failure_counter_keeps_over_resume():
    m = machines.SessionState(2)
    state = m.start()
    state.update(status="MIGRATING", errors=1)
    assert m.step(state, 0, "agent_failure") == (True, "PAUSED", "MIGRATING", 2)
    assert m.step(state, 0, "resume") == (True, "MIGRATING", None, 2)
    assert m.step(state, 0, "agent_ok")[3] == 0
    assert m.step(state, 0, "agent_failure") == (True, "FAILED", None, 1)


def test_rate_limit_does_not_record_rejects():
    m = machines.RateLimit(2, 1000)
    assert [g[0] for g in play(m, (0,), (0,), (1,), (500,), (1000,), (1001,))] == [True, True, True, False, True, True]


def test_rate_limit_invariant():
    rnd = random.Random(5)
    m, state, ok, t = machines.RateLimit(4, 100), None, [], 0
    state = m.start()
    for _ in range(2000):
        t += rnd.randint(1, 30)
        if m.step(state, t)[0]:
            ok.append(t)
    assert all(len([x for x in ok if t - 100 < x <= t]) <= 4 for t in ok)


def test_lockout_doubles_and_caps():
    m = machines.Lockout(5)
    state, t, locks = m.start(), 0, []
    for _ in range(12):
        t += 1000
        out = m.step(state, t, False)
        if out[2]:
            locks.append(out[2])
    assert locks == [60, 120, 240, 480, 960, 1920, 1920, 1920]
    assert m.step(state, t + 1, True) == (True, 0, None)
    assert m.step(state, t + 2, False) == (False, 1, None)
    assert m.step(state, t + 400_000, False)[1] == 1


def test_token_family():
    got = play(machines.TokenReplay(), (0, "issue", "a", None, 100), (1, "rotate", "a", "b", 100), (2, "rotate", "a", "c", 100),
               (3, "rotate", "b", "d", 100), (4, "rotate", "zz", "q", 9), (5, "issue", "e", None, 10), (15, "rotate", "e", "f", 1))
    assert [g[0] for g in got] == ["issued", "rotated", "replay", "replay", "unknown", "issued", "expired"]


@pytest.mark.parametrize("make", [
    lambda t: (streams.session_log(t), "run_id", machines.SessionState(3), ["run_id", "event_id"]),
    lambda t: (t.events, "user_id", machines.RateLimit(3, 12 * 3_600_000), ["user_id", "event_id"]),
    lambda t: (t.events.withColumn("success", F.col("event_type") == "signup"), "user_id", machines.Lockout(2), ["user_id", "event_id"]),
    lambda t: (streams.token_log(t), "user_id", machines.TokenReplay(), ["user_id", "event_id"]),
])
def test_hot_keys_fold_to_the_same_result(spark, make):
    """All keys are hot and cut by day: the rounds have to reach the plain fold's result."""
    df, key, machine, keep = make(Tables(spark, SMALL))
    df = df.withColumn(key, F.col(key) % 3)
    week = F.floor(F.dayofmonth("ts") / 8)
    plain = fold(df, [key], ["ts", "event_id"], "ts", machine, week, keep)
    hot = fold(df, [key], ["ts", "event_id"], "ts", machine, week, keep, hot_rows=300)
    assert rows(plain) == rows(hot)


def test_more_than_ten_numeric_slices_and_null_keys(spark):
    """Slice 10 comes after slice 2, and the rows of a null key are one key's."""
    events = [(None if k % 2 else 1, k, "failure" if k % 5 else "success") for k in range(120)]
    df = spark.createDataFrame(events, "key int, n int, outcome string").withColumn("ts", F.timestamp_seconds("n"))
    cut = F.floor(F.col("n") / 6)
    plain = fold(df, ["key"], ["ts", "n"], "ts", machines.AutoPause(), cut, ["key", "n"])
    streaks, seen = {}, []
    for key, n, outcome in events:
        streaks[key] = streaks.get(key, 0) + 1 if outcome == "failure" else 0
        if outcome == "failure":
            seen.append((key, n, streaks[key]))
    assert sorted(seen, key=str) == sorted(((r.key, r.n, r.streak) for r in plain.collect()), key=str)
    one_key = df.filter("key IS NOT NULL")
    hot = fold(one_key, ["key"], ["ts", "n"], "ts", machines.AutoPause(), cut, ["key", "n"], hot_rows=5)
    assert sorted(x for x in seen if x[0] == 1) == sorted((r.key, r.n, r.streak) for r in hot.collect())


def stream_of(spark, df, tmp_path, n=4):
    """The rows of ``df`` as a file stream, in event order, one file per micro-batch."""
    folder = str(tmp_path / "in")
    first, last = df.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / n
    for i in range(n):
        lo, hi = first + step * i, first + step * (i + 1)
        part = df.filter((F.col("ts") >= lo) & ((F.col("ts") < hi) if i < n - 1 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(stream, tmp_path, name, mode="append"):
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return stream.sparkSession.table(name)


def with_ts(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_run_state_stream(spark, tmp_path):
    log = with_ts(open_view(spark, SMALL, "status_log"))
    out = drain(S.run_state(stream_of(spark, log, tmp_path)), tmp_path, "s_run")
    last = out.filter("applied").groupBy("run_id").agg(F.max_by("status", "event_id").alias("status"), F.max("event_id").alias("event_id"))
    assert rows(last, "run_id", "status", "event_id") == rows(QUERIES["ss1_run_state"](spark, SMALL), "run_id", "status", "event_id")


def test_session_and_auto_pause_streams(spark, tmp_path):
    t = Tables(spark, SMALL)
    out = drain(S.session_state(stream_of(spark, with_ts(streams.session_log(t)), tmp_path)), tmp_path, "s_session")
    cols = ["run_id", "event_id", "action", "accepted", "status", "paused_from", "errors"]
    assert rows(out, *cols) == rows(QUERIES["ss2_session_state"](spark, SMALL), *cols)


def test_rate_limit_stream(spark, tmp_path):
    ev = with_ts(Tables(spark, SMALL).events).select("user_id", "event_id", "ts")
    out = drain(S.rate_limit(stream_of(spark, ev, tmp_path), 3, 12 * 3_600_000, ["user_id"]), tmp_path, "s_rate")
    cols = ["user_id", "event_id", "accepted"]
    assert rows(out, *cols) == rows(QUERIES["ss5_rate_limit"](spark, SMALL), *cols)


def test_token_stream(spark, tmp_path):
    t = Tables(spark, SMALL)
    out = drain(S.token_replay(stream_of(spark, with_ts(streams.token_log(t)), tmp_path)), tmp_path, "s_token")
    assert rows(out, "user_id", "event_id", "result") == rows(QUERIES["ss12_token_replay"](spark, SMALL), "user_id", "event_id", "result")


def test_cached_status_stream(spark, tmp_path):
    t = Tables(spark, SMALL)
    out = drain(S.cached_status_stream(stream_of(spark, with_ts(streams.cache_log(t)), tmp_path)), tmp_path, "s_cache")
    cols = ["run_id", "event_id", "cached"]
    assert rows(out, *cols) == rows(QUERIES["ss10_cached_status"](spark, SMALL), *cols)


def test_approval_timeout_stream(spark, tmp_path):
    """Every wait but the ones after the last watermark is decided in the stream."""
    log = with_ts(open_view(spark, SMALL, "status_log"))
    out = drain(S.approval_timeout(stream_of(spark, log, tmp_path), 30, "PENDING"), tmp_path, "s_approval")
    end = log.agg(F.max("ts") - F.expr("INTERVAL 45 MINUTES")).first()[0]
    batch = QUERIES["ss4_approval_timeout"](spark, SMALL).filter(F.col("waiting_since") < F.lit(end))
    got = out.filter(F.col("waiting_since") < F.lit(end))
    key = ["run_id", F.date_format("waiting_since", "yyyy-MM-dd HH:mm:ss").alias("w")]
    assert rows(got.select(*key)) == rows(batch.select(*key))


def test_daily_cost_stream(spark, tmp_path):
    led = open_view(spark, SMALL, "ledger").withColumn("ts", F.col("created_at").cast("timestamp")).drop("created_at")
    st = stream_of(spark, led, tmp_path).withColumnRenamed("ts", "created_at")
    out = drain(S.stream_daily_cost(st), tmp_path, "s_cost", "update")
    cols = ["day", "provider", "tier", "agent"]
    latest = out.groupBy(*cols).agg(F.max("calls").alias("calls"), F.max("input_tokens").alias("tokens"))
    assert rows(latest) == rows(QUERIES["ag4_daily_cost"](spark, SMALL).select(*cols, "calls", F.col("input_tokens").alias("tokens")))


def test_dedup_and_progress_streams(spark, tmp_path):
    d = open_view(spark, SMALL, "deliveries").filter("delivery_id IS NOT NULL").withColumn("ts", F.col("received_at").cast("timestamp"))
    doubled = d.unionByName(d.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))).drop("received_at")
    st = stream_of(spark, doubled, tmp_path).withColumnRenamed("ts", "received_at")
    assert drain(S.dedup_deliveries(st), tmp_path, "s_dedup").count() == d.count()


def test_latest_progress_stream(spark, tmp_path):
    log = with_ts(streams.progress_log(Tables(spark, SMALL)))
    out = drain(S.latest_progress(stream_of(spark, log, tmp_path)), tmp_path, "s_progress", "complete")
    assert rows(out) == rows(S.latest_progress(log))


def test_triggers_and_event_source(spark, tmp_path):
    folder = str(tmp_path / "src")
    spark.createDataFrame([("p1", "u|k|SPRING_KAFKA_HYBRID", T0), ("p2", "u", T0), (None, "x", T0)], "key string, value string, ts timestamp").write.parquet(folder)
    from codelake.sources.messages import parse_event
    out = drain(parse_event(read_events(spark, folder, fmt="parquet")), tmp_path, "s_src")
    assert rows(out) == [("p1", "u", "k", "SPRING_KAFKA_HYBRID"), ("p2", "u", "", "NATIVE_KAFKA_CLIENTS")]
    body = '{"repository":{"clone_url":"u"},"ref":"refs/heads/main","head_commit":{"id":"s"}}'
    d = spark.createDataFrame([("1", "push", "ACCEPTED", body), ("2", "push", "SKIPPED", body), ("3", "issues", "ACCEPTED", body)],
                              "delivery_id string, event_type string, status string, payload string")
    assert rows(S.push_triggers(d, True)) == [("1", "u", "main", "s")]
    assert S.push_triggers(d, False).count() == 0


def shuffled_stream(spark, df, tmp_path, minutes, n=4, seed=3):
    """Rows in files by their time plus up to ``minutes`` of delay, so each file mixes times; a last row far ahead lets all go."""
    folder = str(tmp_path / "in")
    arrival = F.col("ts").cast("double") + F.rand(seed) * minutes * 60
    rows_ = df.withColumn("_at", arrival).toPandas().sort_values("_at")
    last = rows_["ts"].max()
    for part in np.array_split(rows_, n):
        spark.createDataFrame(part.drop(columns="_at").sample(frac=1, random_state=seed), df.schema).coalesce(1).write.mode("append").parquet(folder)
    far = rows_.tail(1).drop(columns="_at").assign(ts=last + pd.Timedelta(days=400))
    far[df.columns[0]] = -1
    spark.createDataFrame(far, df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("name, make", [
    ("ss2_session_state", lambda t: (streams.session_log(t), S.session_state)),
    ("ss5_rate_limit", lambda t: (t.events.select("user_id", "event_id", "ts"), lambda s, **k: S.rate_limit(s, 3, 12 * 3_600_000, ["user_id"], **k))),
    ("ss10_cached_status", lambda t: (streams.cache_log(t), S.cached_status_stream)),
])
def test_shuffled_stream_equals_batch_and_state_goes(spark, tmp_path, name, make):
    df, run = make(Tables(spark, SMALL))
    stream = shuffled_stream(spark, with_ts(df), tmp_path, 600)
    out = drain(run(stream, lateness="10 hours"), tmp_path, "x_" + name)
    want = QUERIES[name](spark, SMALL)
    got, late = S.split_late(out)
    assert late.count() == 0
    assert rows(got.filter(F.col(want.columns[0]) != -1), *want.columns) == rows(want, *want.columns)
    for held in ("machine", "waiting"):
        state = spark.read.format("statestore").option("stateVarName", held).load(str(tmp_path / "ck"))
        assert state.filter("key." + want.columns[0] + " != -1").count() == 0


def test_late_rows_go_to_their_own_output(spark, tmp_path):
    """Without tolerance, rows behind the watermark change nothing and are counted; the rest is in order."""
    df = with_ts(open_view(spark, SMALL, "status_log"))
    out = drain(S.run_state(shuffled_stream(spark, df, tmp_path, 3000)), tmp_path, "x_late")
    got, late = S.split_late(out)
    assert late.count() > 0 and got.count() + late.count() == df.count() + 1
    on_time = df.join(late.select("event_id"), "event_id", "left_anti")
    want = fold(on_time, ["run_id"], ["ts", "event_id"], "ts", machines.RunState(), F.to_date("ts"), ["run_id", "event_id"])
    assert rows(got.filter("run_id != -1"), *want.columns) == rows(want)


def test_approval_timeout_out_of_order(spark, tmp_path):
    log = with_ts(open_view(spark, SMALL, "status_log"))
    out = drain(S.approval_timeout(shuffled_stream(spark, log, tmp_path, 300), 30, "PENDING", lateness="5 hours"), tmp_path, "x_approval")
    key = ["run_id", F.date_format("waiting_since", "yyyy-MM-dd HH:mm:ss").alias("w")]
    assert out.filter("late").count() == 0
    assert rows(out.filter("run_id != -1").select(*key)) == rows(QUERIES["ss4_approval_timeout"](spark, SMALL).select(*key))


def test_progress_stream(spark, tmp_path):
    log = with_ts(streams.progress_log(Tables(spark, SMALL)))
    out = drain(S.progress_stream(shuffled_stream(spark, log, tmp_path, 120), lateness="2 hours"), tmp_path, "x_progress")
    last = out.filter("job_id != -1").join(log.select("event_id", "ts"), "event_id").groupBy("job_id", "stage").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    assert rows(last) == rows(S.latest_progress(log))


def test_forgotten_tokens_are_unknown():
    got = play(machines.TokenReplay(50), (0, "issue", "a", None, 100), (1, "rotate", "a", "b", 100), (149, "rotate", "a", "c", 1), (152, "rotate", "a", "c", 1))
    assert [g[0] for g in got] == ["issued", "rotated", "replay", "unknown"]


@pytest.mark.parametrize("block", [3, 256])
def test_session_maps_equal_the_plain_fold(spark, block, monkeypatch):
    """Blocks of three rows make five levels of maps; null keys and unknown actions are rows like others."""
    t = Tables(spark, SMALL)
    log = streams.session_log(t).withColumn("run_id", F.when(F.col("run_id") % 5 != 0, F.col("run_id") % 2))
    log = log.withColumn("action", F.when(F.col("event_id") % 11 != 0, F.col("action")).otherwise("no such action"))
    monkeypatch.setattr(folds.fold_finite, "__defaults__", (block,))
    got = folds.session_states(log, 2)
    seen = {}
    machine, want = machines.SessionState(2), []
    for r in sorted(log.collect(), key=lambda r: (r.ts, r.event_id)):
        state = seen.setdefault(r.run_id, machine.start())
        want.append((r.run_id, r.event_id, r.action, *machine.step(state, 0, r.action)))
    cols = ["run_id", "event_id", "action", "accepted", "status", "paused_from", "errors"]
    assert rows(got, *cols) == sorted(want, key=repr)


def test_one_key_in_one_instant_spreads(spark):
    """All rows of one provider at one time: ranges part them, a day would not."""
    df = spark.range(4000).select(F.lit("p").alias("provider"), F.lit(T0).alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 3 == 0).alias("failed"))
    cut = slices.ranged(df, ["provider"], ["ts", "event_id"])
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500
    got = R.rolling_failure(cut, slices.by_range()).select("event_id", "rate").orderBy("event_id").collect()
    assert all(abs(r.rate - sum(k % 3 == 0 for k in range(max(0, r.event_id - 9), r.event_id + 1)) / min(10, r.event_id + 1)) < 1e-9 for r in got)


def test_fold_with_ranges_and_null_keys(spark):
    df = spark.range(900).select(F.when(F.col("id") % 4 != 0, F.col("id") % 2).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 40).alias("ts"), (F.col("id") % 7 == 0).alias("success"))
    got = fold(df, ["user_id"], ["ts", "event_id"], "ts", machines.Lockout(2), keep=["user_id", "event_id"])
    seen, want, machine = {}, [], machines.Lockout(2)
    for r in df.orderBy("event_id").collect():
        want.append((r.user_id, r.event_id, *machine.step(seen.setdefault(r.user_id, machine.start()), r.event_id * 40_000, r.success)))
    assert rows(got) == sorted(want, key=repr)
