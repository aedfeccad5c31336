import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from codelake.operators import corpus as C
from codelake.operators import runs as R
from codelake.operators import slices, usage
from codelake.operators.filters import parse_log_query, prune_corpus
from codelake.operators.slices import id_slice
from codelake.sources import sinks
from conftest import rows

T0 = dt.datetime(2024, 1, 1)


def log(spark, events):
    return spark.createDataFrame([("r", T0 + dt.timedelta(minutes=i), i, o) for i, o in enumerate(events)],
                                 "run_id string, ts timestamp_ntz, event_id bigint, outcome string")


def test_streak_survives_a_pause_and_resets_on_success(spark):
    got = R.failure_streak(log(spark, ["failure", "failure", "failure", "other", "failure", "success", "failure"]), 3, slices.day_slice("ts"))
    assert [(r.streak, r.verdict) for r in got.orderBy("event_id").collect()] == [
        (1, "FAILED"), (2, "FAILED"), (3, "PAUSED"), (4, "PAUSED"), (1, "FAILED")]


def test_slices_equal_plain_windows(spark):
    """One key with all rows, and tiny slices."""
    rnd = random.Random(1)
    data = [(rnd.choice(["hot", "hot", "a", "b"]), i, rnd.randint(0, 9), rnd.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, i bigint, v bigint, m bigint")
    w = Window.partitionBy("k").orderBy("i")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "k", "i", F.sum("v").over(run).alias("s"), F.row_number().over(w).alias("n"), F.lag("v").over(w).alias("lag"),
        F.lead("v").over(w).alias("lead"), F.last("m", True).over(run).alias("m"),
        F.last("m", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m0"),
        F.sum("v").over(w.rowsBetween(-3, 0)).alias("t"), F.count("*").over(w.rowsBetween(-3, 0)).alias("c"))
    cut = id_slice("i", 7)
    got = df.withColumn("m1", F.col("m"))
    got = slices.running_sum(got, ["k"], ["i"], "v", "s", cut)
    got = slices.row_numbers(got, ["k"], ["i"], "n", cut)
    got = slices.neighbour(got, ["k"], ["i"], "v", "lag", cut)
    got = slices.neighbour(got, ["k"], ["i"], "v", "lead", cut, ahead=True)
    got = slices.last_known(got, ["k"], ["i"], "m1", "mm", cut)
    got = slices.last_known(got, ["k"], ["i"], "m1", "m0", cut, inclusive=False)
    got = slices.trailing_mean(got, ["k"], ["i"], "v", 4, cut, "t", "c", block=5)
    assert rows(got, "k", "i", "s", "n", "lag", "lead", "mm", "m0", "t", "c") == rows(want)


def test_budget_prefix_stops_at_first_that_does_not_fit(spark):
    df = spark.createDataFrame([("p", i, c) for i, c in enumerate([4, 3, 9, 1])], "p string, i bigint, c bigint")
    assert rows(C.budget_prefix(df, ["p"], ["i"], "c", 10, id_slice("i", 2)), "i") == [(0,), (1,)]


def test_pauses_ignore_repeats(spark):
    acts = ["resume", "pause", "pause", "resume", "resume", "pause"]
    df = spark.createDataFrame([("r", T0 + dt.timedelta(minutes=i), i, a) for i, a in enumerate(acts)], "run_id string, ts timestamp_ntz, event_id bigint, action string")
    got = R.pair_pauses(df, F.hour("ts")).orderBy("paused_at").collect()
    assert [(r.paused_at.minute, r.seconds) for r in got] == [(1, 120.0), (5, None)]


def test_log_query():
    assert parse_log_query('Foo "Bar Baz" -qux -"a b" -') == (["foo", "bar baz", "-"], ["qux", "a b"])
    assert parse_log_query("  ") == ([], [])


def test_empty_keep_set_deletes_nothing(spark):
    chunks = spark.createDataFrame([("a", "DOCUMENTATION", None), ("b", "SOURCE_CODE", "p")], "path string, doc_type string, project_id string")
    none = spark.createDataFrame([], "path string")
    assert prune_corpus(chunks, none).count() == 2
    assert rows(prune_corpus(chunks, none.union(spark.sql("SELECT 'zzz'"))), "path") == [("b",)]


def test_periods():
    now = dt.datetime(2024, 3, 15, 7)
    assert usage.period(now, "mtd") == (dt.datetime(2024, 3, 1), now)
    assert usage.period(now, "7d") == (now - dt.timedelta(days=7), now)


def test_budget_without_limit(spark):
    df = spark.createDataFrame([(5, 6, T0)], "input_tokens bigint, output_tokens bigint, created_at timestamp_ntz")
    assert tuple(usage.budget_status(df, T0, 0).first()) == (11, False)
    assert tuple(usage.budget_status(df, T0, 11).first()) == (11, True)
    assert tuple(usage.budget_status(df, T0.replace(month=2), 11).first()) == (0, False)


def test_empty_summaries(spark):
    none = spark.createDataFrame([], "status string, created_at timestamp_ntz, updated_at timestamp_ntz")
    assert tuple(R.org_summary(none).first()) == (0, 0.0, 0.0)
    assert all(r.n == 0 for r in R.status_counts(none).collect())


def test_refresh_replaces_only_touched_days(spark, tmp_path):
    def row(day, cost):
        return ("j", "a", "p", "T", 1, 1, cost, False, dt.datetime(2024, 1, day, 5))
    schema = "job_id string, agent string, provider string, tier string, input_tokens bigint, output_tokens bigint, cost_usd double, cache_hit boolean, created_at timestamp_ntz"
    target = str(tmp_path / "daily")
    usage.refresh_daily(target, spark.createDataFrame([row(1, 1.0), row(2, 2.0)], schema), ["2024-01-01", "2024-01-02"])
    usage.refresh_daily(target, spark.createDataFrame([row(1, 9.0), row(2, 5.0)], schema), ["2024-01-02"])
    got = {str(r.day): r.cost_usd for r in spark.read.parquet(target).collect()}
    assert got == {"2024-01-01": 1.0, "2024-01-02": 5.0}


def test_csv_and_patch_writers(spark, tmp_path):
    used = spark.createDataFrame([('a"b', "p,q", 1, 2, 3, 0.5)], "agent string, provider string, calls bigint, input_tokens bigint, output_tokens bigint, cost_usd double")
    sinks.export_usage_csv(used, str(tmp_path / "csv"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert sorted(set(lines)) == sorted([sinks.CSV_HEADER, '"a""b","p,q",1,2,3,0.500000'])
    assert sinks.usage_csv_lines(used).first()[0] == '"a""b","p,q",1,2,3,0.500000'
    files = spark.createDataFrame([(None, "n", "CREATED", "x\n")], "original_path string, new_path string, change_type string, content string")
    assert sinks.to_patch(files).first().patch == "diff --git /dev/null b/n\n--- /dev/null\n+++ b/n\n@@ -0,0 +1,2 @@\n+x\n+\n\n"


def test_chunking(spark):
    text = "a" * 500 + "\n\n" + "b" * 400 + "\n\n\n" + "c" * 900 + "\n\nd\n\n"
    got = C.chunk(spark.createDataFrame([(1, text), (2, " \n")], "id int, text string")).orderBy("chunk_index").collect()
    assert [(r.chunk_index, len(r.chunk_text)) for r in got] == [(0, 500), (1, 400), (2, 900), (3, 1)]


def test_headline(spark):
    text = " ".join(f"w{i}" for i in range(30)) + " Hit, " + " ".join(f"v{i}" for i in range(40)) + " hit end"
    got = C.headline(spark.createDataFrame([(text,), ("nothing",)], "content string"), "hit").collect()
    pieces = got[0].headline.split(" ... ")
    assert len(pieces) == 2 and all(len(p.split()) <= 20 for p in pieces) and "<b>Hit,</b>" in pieces[0] and "<b>hit</b>" in pieces[1]
    assert got[1].headline == ""


def test_fingerprint_layouts(spark):
    schema = "project_id string, path string, content string"
    a = [("p", "b", "2"), ("p", "a", "1"), ("q", "a", "1")]
    flat = lambda d: {r.project_id: r.digest for r in C.fingerprint(spark.createDataFrame(d, schema)).collect()}
    tree = lambda d: {r.project_id: r.digest for r in C.fingerprint(spark.createDataFrame(d, schema), flat_limit=0).collect()}
    import hashlib
    assert flat(a)["p"] == hashlib.sha256(b"a:1\nb:2\n").hexdigest()
    for f in (flat, tree):
        assert f(a) == f(a[::-1]) and f(a)["p"] != f([("p", "b", "2"), ("p", "a", "x")])["p"]


def test_fingerprint_of_a_large_project_is_plain(spark):
    import hashlib
    from pyspark.sql import functions as F

    n = 70
    files = spark.range(n).select(
        F.lit("big").alias("project_id"), F.format_string("f%02d", "id").alias("path"), F.repeat(F.format_string("%08d", "id"), 125_000).alias("content"))
    more = spark.createDataFrame([("none", "a", None), (None, "b", "2"), (None, "a", "1"), ("é", "a", "ü")], "project_id string, path string, content string")
    want = hashlib.sha256()
    for i in range(n):
        want.update(f"f{i:02d}:".encode() + f"{i:08d}".encode() * 125_000 + b"\n")
    got = {r.project_id: r.digest for r in C.fingerprint(files.unionByName(more)).collect()}
    plain = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {"big": want.hexdigest(), "none": None, None: plain("a:1\nb:2\n"), "é": plain("a:ü\n")}


def test_common_prefix_fallback(spark):
    df = spark.createDataFrame([("g", "b.x"), ("g", "a.y"), ("h", "a.b.c"), ("h", "a.b"), ("i", "z.q")], "g string, p string")
    assert dict(rows(C.common_prefix(df, ["g"], "p"))) == {"g": "", "h": "a.b", "i": "z.q"}
    assert dict(rows(C.common_prefix(df, ["g"], "p", True)))["g"] == "a.y"
