import pytest
from pyspark.sql import functions as F

from codelake.functions import text as X
from codelake.functions.numbers import round_half_up
from codelake.sources.messages import parse_push, parse_status, sign, signature_ok


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("<p>a</p>  <b>b</b>", "a b"),
    ("<style>x{}</style><script a=1>y</script>t", "t"),
    ("a&nbsp;&amp;&lt;b&gt;", "a &<b>"),
    ("\x01 a \t\n", "a"),
])
def test_html(spark, raw, want):
    assert one(spark, raw, X.html_to_text) == want


@pytest.mark.parametrize("raw, want", [
    ("import javax.inject.Inject;", "import jakarta.inject.Inject;"),
    ("javax.sql.DataSource javax.crypto.Cipher", "javax.sql.DataSource javax.crypto.Cipher"),
    ("javax.transaction.xa.XAResource", "javax.transaction.xa.XAResource"),
    ("javax.transaction.Transactional", "jakarta.transaction.Transactional"),
    ("javax.annotation.processing.Filer javax.annotation.PostConstruct", "javax.annotation.processing.Filer jakarta.annotation.PostConstruct"),
    ("javax.ws.rs.Path javax.ws.other", "jakarta.ws.rs.Path javax.ws.other"),
    ("javax.elements.X javax.el.X", "javax.elements.X jakarta.el.X"),
    ("notjavax.inject", "notjavax.inject"),
    ("javax.xml.bind.JAXB javax.xml.parsers.P", "jakarta.xml.bind.JAXB javax.xml.parsers.P"),
])
def test_javax(spark, raw, want):
    assert one(spark, raw, X.javax_to_jakarta) == want


@pytest.mark.parametrize("raw, want", [
    ("```java\ncode\n```\ntail", "code"),
    ("```java\ncode", "code"),
    ("```", ""),
    ("code\n```\nrest", "code"),
    ("plain  \n", "plain"),
])
def test_fences(spark, raw, want):
    assert one(spark, raw, X.strip_fences) == want


@pytest.mark.parametrize("path, raw, want", [
    ("A.java", "Here you go:\n\npackage a;\nclass A {}", "package a;\nclass A {}"),
    ("A.java", "no code at all", "no code at all"),
    ("pom.xml", "Sure: <project/>", "<project/>"),
    ("pom.xml", "  <project/>", "  <project/>"),
    ("a.yml", "Sure: a: b", "Sure: a: b"),
])
def test_prose(spark, path, raw, want):
    df = spark.createDataFrame([(path, raw)], "p string, c string")
    assert df.select(X.strip_prose(F.col("c"), F.col("p"))).first()[0] == want


def test_split_files(spark):
    raw = "intro\n=== FILE: a.java ===\n one \n== FILE: b.yml ==\ntwo\n=== FILE: a.java ===\nthree"
    got = one(spark, raw, X.split_files)
    assert [tuple(r) for r in got] == [("b.yml", "two"), ("a.java", "three")]


@pytest.mark.parametrize("raw, want", [
    ("x {\"a\": {\"b\": 1}} y", "{\"a\": {\"b\": 1}}"), ("none", "none"), ("} {", "} {"),
])
def test_json_slice(spark, raw, want):
    assert one(spark, raw, X.json_slice) == want


def test_json_strings(spark):
    assert one(spark, '["a", "", " ", "b"]', X.json_strings) == ["a", "b"]
    assert one(spark, "nope", X.json_strings) == []


@pytest.mark.parametrize("raw, want", [(None, "—"), ("0", "—"), ("11.6", "12s"), ("63", "1m 03s"), ("3600", "60m 00s")])
def test_duration(spark, raw, want):
    assert one(spark, raw, lambda c: X.duration_label(c.cast("double"))) == want


def test_owner_and_sentence(spark):
    assert one(spark, "a.B#m/1", X.owner_of) == "a.B"
    assert one(spark, "#m", X.owner_of) == "#m"
    assert one(spark, "One. Two.", X.first_sentence) == "One."
    assert one(spark, "Only", X.first_sentence) == "Only"


def test_highlight_is_one_pass(spark):
    assert one(spark, "Foo <foobar>", lambda c: X.highlight(c, ["foo", "foobar"])) == "<mark>Foo</mark> &lt;<mark>foo</mark>bar&gt;"


def test_round_half_up(spark):
    df = spark.sql("SELECT explode(array(-0.0005D, 0.0005D, 0.12345D)) AS v")
    assert [r[0] for r in df.select(round_half_up(F.col("v"))).collect()] == [0.0, 0.001, 0.123]


def test_signature(spark):
    good = sign("k", "body")
    df = spark.createDataFrame([("body", good), ("body", good[:-2] + "00"), ("body", "sha256=zz"), ("body", None), ("body", good[7:])], "b string, h string")
    assert [r[0] for r in df.select(signature_ok("k")("b", "h")).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(signature_ok(" ")("b", "h")).collect()] == [False] * 5


def test_status_and_push(spark):
    df = spark.createDataFrame([("a", "DONE:k1"), ("b", "FAILED:why: x"), ("c", "ANALYZING"), ("d", "BOGUS"), (None, "DONE:x"), ("e", None)], "key string, value string")
    got = [(r.key, r.status, r.detail) for r in parse_status(df).collect()]
    assert got == [("a", "DONE", "k1"), ("b", "FAILED", "why: x"), ("c", "ANALYZING", None)]
    body = '{"repository":{"clone_url":"u"},"ref":"refs/heads/a/b","head_commit":{"id":"s"}}'
    push = spark.createDataFrame([(body,), ("{}",), ("not json",), ('{"ref":"x"}',)], "payload string")
    assert [(r.repo_url, r.branch, r.commit_sha) for r in parse_push(push).collect()] == [("u", "a/b", "s")]


def test_split_files_reads_a_text_once(spark):
    df = spark.createDataFrame([("=== FILE: a ===\nx\n=== FILE: b ===\n \x0b y z\t\n",)], "c string").select(X.split_files(F.col("c")).alias("f"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("split(") == 1
    assert [tuple(r) for r in df.first().f] == [("a", "x"), ("b", "y z")]
