"""Java facts, contract checks, leaks and stack detection on literal sources."""

import pytest
from pyspark.sql import functions as F

from codelake.operators import code_rules as U
from codelake.operators import contracts as T
from codelake.operators import facts as K
from codelake.operators import findings as N
from conftest import rows

SCHEMA = "project_id string, path string, content string"
BASE = {
    "api/Port.java": "package a.api;\npublic interface Port extends Root {\n  String send(String m, int n);\n}\n",
    "api/Root.java": "package a.api;\npublic interface Root { void close(); }\n",
    "core/Good.java": "package a.core;\nimport a.api.Port;\npublic class Good implements Port {\n  public Good(String x) { }\n"
                      "  @Override public String send(String m, int n) { return m; }\n  @Override public void close() { int x = 1; }\n}\n",
}


def facts(spark, extra=None):
    files = {**BASE, **(extra or {})}
    return K.extract_facts(spark.createDataFrame([("p", k, v) for k, v in files.items()], SCHEMA), materialise=False)


def symbols(df):
    return sorted(r.symbol for r in df.select("symbol").collect())


def test_valid_code_is_quiet(spark):
    assert T.contract_violations(facts(spark)).count() == 0


BAD = "package a.core;\nimport a.api.Port;\nimport a.core.Gone;\npublic class Bad implements Port {\n  Good g;\n  Lost l;\n" \
      "  public int send(String m, int n) { g.vanish(); new Good(m, n); return 1; }\n  @Override public void extra() { int y = 1; }\n}\n"


@pytest.mark.parametrize("check, want", [
    (T.unresolved_imports, ["a.core.Gone"]), (T.missing_imports, ["Lost"]), (T.missing_interface_methods, ["close/0"]),
    (T.signature_mismatches, ["Bad.send(String,int):String"]), (T.bad_constructor_arity, ["Good/2"]), (T.unknown_calls, ["Good.vanish"]),
    (T.invalid_overrides, ["Bad.extra/0"]), (T.file_class_mismatch, ["Bad"]),
])
def test_one_violation_per_check(spark, check, want):
    assert symbols(check(facts(spark, {"core/Wrong.java": BAD}))) == want


def test_package_private(spark):
    f = facts(spark, {"core/Hid.java": "package a.core;\nclass Hid { }\n", "web/W.java": "package a.web;\nimport a.core.Hid;\npublic class W { Hid h; }\n"})
    assert symbols(T.package_private_uses(f)) == ["a.core.Hid"]


def test_lombok_and_records_count_as_members(spark):
    f = facts(spark, {
        "core/D.java": "package a.core;\n@Data public class D { private String name; }\n",
        "core/Rec.java": "package a.core;\npublic record Rec(int a, String b) { }\n",
        "core/Use.java": "package a.core;\npublic class Use { void go(D d, Rec r) { d.getName(); d.setName(\"x\"); r.a(); r.c(); new Rec(1); } }\n"})
    assert symbols(T.unknown_calls(f)) == ["Rec.c"] and symbols(T.bad_constructor_arity(f)) == ["Rec/1"]


def test_comments_and_strings_hold_no_facts(spark):
    src = 'package a;\n/* class Ghost { } */\n// import x.Y;\npublic class C { String s = "class Fake { }"; /** {@link Z} */ void m() { } }\n'
    f = facts(spark, {"C.java": src})
    assert {r.name for r in f.types.collect()} == {"Port", "Root", "Good", "C"}
    assert rows(f.methods.filter("path = 'C.java'"), "owner", "name", "line") == [("C", "m", 4)]


def test_declared_type_is_no_leak(spark):
    leak = {"x/L.java": "package x;\nimport com.google.cloud.pubsub.Publisher;\npublic class L { Publisher p; }\n"}
    assert symbols(U.leak_types(facts(spark, leak))) == ["Publisher"]
    assert symbols(U.leak_types(facts(spark, {**leak, "x/Publisher.java": "package x;\npublic class Publisher { }\n"}))) == []


def test_build_and_config_leaks(spark):
    df = spark.createDataFrame([
        ("p", "pom.xml", "<a>\n<b>google-cloud-pubsub</b>"), ("p", "build.gradle", "x 'spring-cloud-gcp-pubsub'"), ("p", "a.properties", "k=1\nspring.cloud.gcp.pubsub.x=1"),
        ("p", "a.yml", "spring:\n  gcp:\n    # c\n    pubsub:\n      a: 1\n  pubsub:\n    b: 1\n"), ("p", "A.java", "google-cloud-pubsub")], SCHEMA)
    assert rows(U.leak_dependencies(df), "path", "line") == [("build.gradle", 1), ("pom.xml", 2)]
    assert rows(U.leak_config(df), "path", "line", "symbol") == [("a.properties", 2, "gcp.pubsub."), ("a.properties", 2, "spring.cloud.gcp.pubsub"), ("a.yml", 4, "pubsub:")]


def test_first_occurrence_and_method(spark):
    src = "class A {\n  public void go(String a) {\n    x();\n    t.publish(a);\n    t.publish(a);\n  }\n}"
    got = N.first_hits(spark.createDataFrame([("p", "A.java", src)], SCHEMA), U.FEATURE_RULES, declaration=N.METHOD_DECL).collect()
    assert [(r.feature_id, r.line, r.method, r.text) for r in got] == [("pubsub.publish-single", 4, "go", "t.publish(a);")]


@pytest.mark.parametrize("path, text, want", [
    ("pom.xml", "jakarta.jakartaee-api payara-micro <maven.compiler.release>17</maven.compiler.release>", ("17", "Jakarta EE", "Maven", "Payara Micro")),
    ("m/pom.xml", "spring-boot-starter", (None, "Spring Boot", "Maven", "Embedded (Spring Boot)")),
    ("build.gradle.kts", "kotlin JavaLanguageVersion.of(21)", ("21", "unknown", "Gradle (Kotlin DSL)", None)),
    ("build.gradle", "quarkus sourceCompatibility = '11'", ("11", "Quarkus", "Gradle (Groovy)", "Quarkus")),
    ("README.md", "quarkus", (None, "unknown", "unknown", None)),
])
def test_stack(spark, path, text, want):
    r = U.detect_stack(spark.createDataFrame([("p", path, text)], SCHEMA)).first()
    assert (r.version, r.framework, r.build_system, r.runtime) == want


def test_profile_limits_are_optional(spark):
    df = spark.createDataFrame([("p", "A.java", "x" * 20 + "jakarta.ejb"), ("p", "B.java", "pubsub")], SCHEMA)
    full = U.profile_projects(df).first()
    assert (full.framework, full.eligible, full.technologies) == ("JAKARTA_EE", True, "JAKARTA_EE,GRADLE_KOTLIN,GCP_PUBSUB")
    cut = U.profile_projects(df, max_files=1, max_chars=10).first()
    assert (cut.framework, cut.eligible) == ("SPRING_BOOT", False)


def test_static_checks(spark):
    df = spark.createDataFrame([("p", "a", " ", "MODIFIED"), ("p", "b", "@PubSubListener", "MODIFIED"), ("p", "c", "@PubSubListener", "CREATED"), ("q", "d", "x", "UNCHANGED")],
                               SCHEMA + ", change_type string")
    assert rows(N.static_checks(df), "project_id", "severity", "path") == [("p", "ERROR", "a"), ("p", "ERROR", "b"), ("q", "WARNING", None)]


@pytest.mark.parametrize("code, log, want", [
    (0, "Tests run: 1, Failures: 1, Errors: 0, Skipped: 0\nTests run: 42, Failures: 0, Errors: 0, Skipped: 1", ["Sandbox tests passed (42 run, 1 skipped)"]),
    (0, "quiet", ["No tests in project — sandbox test runner had nothing to run"]),
    (1, "Tests run: 3, Failures: 1, Errors: 0, Skipped: 0\n  a.FooTest.bar: boom \n a.FooIT.baz: bang", ["a.FooTest.bar(): boom", "a.FooIT.baz(): bang"]),
    (1, "Tests run: 3, Failures: 1, Errors: 2, Skipped: 0", ["Sandbox tests failed: 1 failure(s), 2 error(s) of 3 test(s)"]),
    (137, "killed", ["Sandbox tests exited 137 (no parseable failures); tail: killed"]),
])
def test_test_logs(spark, code, log, want):
    df = spark.createDataFrame([(1, code, log)], "id int, exit_code int, log string")
    assert [r.message for r in N.parse_test_log(df).orderBy("pos").collect()] == want


def test_binding_helpers_are_unwrapped(spark):
    f = facts(spark, {"B.java": "package b;\npublic class B { void m() { p.getOrCreateSubscription(name(Cfg.T1), Cfg.S1); getOrCreateSubscription(T2, full(S1), x); } }"})
    assert rows(U.bindings(f), "subscription", "topic") == [("S1", "T1")]


def test_scope_gap_kinds(spark):
    f = facts(spark, {"x/S.java": "package x;\n@ApplicationScoped public class S { }", "x/L.java":
                      "package x;\npublic class L { @KafkaListener(topics = {\"a\"}) public void on(String m) { CdiLookup.get(S.class).go(m); CdiLookup.get(kind).go(m); } }"})
    assert rows(U.scope_gap(f), "symbol", "kind") == [("S", "TX_GAP"), ("kind", "TX_GAP_UNVERIFIED")]


DEEP = 'package a.core;\npublic class Deep {\n  private Map<String, List<Map<String, Set<List<Integer>>>>> deep;\n' \
       '  String text = """\n    } class Fake { "quoted" \\""" void no() {\n    """;\n  char c = \'"\';\n' \
       '  public List<Map<String, List<Set<Map<String, Long>>>>> build(Map<String, List<List<Set<Integer>>>> in) { return use(in); }\n  void after() { run(1); }\n}\n'


def test_facts_behind_text_blocks_and_deep_generics(spark):
    f = facts(spark, {"core/Deep.java": DEEP})
    mine = lambda df: df.filter("path = 'core/Deep.java'")
    assert rows(mine(f.types), "name", "line") == [("Deep", 2)]
    assert rows(mine(f.methods), "name", "line", "return_type") == [("after", 9, "void"), ("build", 8, "List")]
    assert ("deep", "Map") in rows(mine(f.variables), "var", "type") and ("in", "Map") in rows(mine(f.variables), "var", "type")
    assert rows(mine(f.calls), "method", "name") == [("after", "run"), ("build", "use")]


def test_overloads_are_judged_each_by_its_own(spark):
    """Only the overload that listens may not publish; only the one that doesn't may not consume."""
    code = "package a.core;\npublic class Over {\n  @KafkaListener(topics = \"t\")\n  public void on(String m) { bus.publish(m, 1); bus.consume(m); }\n" \
           "  public void on(String m, int n) { bus.publish(m, n); bus.consume(m); }\n}\n"
    got = U.unconverted(facts(spark, {"core/Over.java": code})).select("line", "symbol")
    assert rows(got) == [(4, "on (publish)"), (5, "on (consume)")]


def test_full_report_and_verdict(spark):
    files = {**BASE, "core/Bad.java": BAD}
    df = spark.createDataFrame([("p", k, v) for k, v in files.items()] + [("q", k, v) for k, v in BASE.items()], SCHEMA)
    deny = spark.createDataFrame([(0, "a.core.Gone")], "ord int, key string")
    f = K.extract_facts(df, materialise=False)
    report = N.full_report(f, df, deny, hybrid=False)
    counts = {(r.project_id, r.category): r.n for r in N.category_counts(report).collect()}
    assert counts["p", "CONTRACT"] > 3 and counts["p", "FORBIDDEN_IMPORT"] == 1 and not any(p == "q" for p, _ in counts)
    verdict = {r.project_id: (r.files, r.clean) for r in N.report_verdict(report, df).collect()}
    assert verdict == {"p": (4, False), "q": (3, True)}
    hybrid = N.full_report(f, df, deny)
    assert rows(hybrid.filter("category = 'NO_LISTENERS_FOUND'"), "project_id", "path", "line") == [("p", "", -1), ("q", "", -1)]


def test_written_facts_are_extracted_once(spark):
    """A written fact table no longer holds the regexes that made it, and equals the table made anew."""
    from codelake.operators import facts as K

    code = "package a;\nclass C {\n  private D d;\n  C(D x) { d.go(); }\n  void go(int n) { D e = new D(); e.run(n); }\n}\n"
    files = spark.createDataFrame([("p", "C.java", code)], "project_id string, path string, content string")
    once, anew = K.extract_facts(files), K.extract_facts(files, False)
    for name in ("types", "methods", "constructors", "variables", "calls"):
        df = getattr(once, name)
        assert getattr(once, name) is df and "regexp" not in df._jdf.queryExecution().toString()
        assert sorted(df.collect()) == sorted(getattr(anew, name).collect()) != []


def test_a_log_is_read_by_group(spark):
    log = "x\n[ERROR]  /tmp/workspace/src/A.java:[7,1]  gone \t\n[ERROR] b/B.java:[8,2] lost\n"
    df = N.parse_compile_log(spark.createDataFrame([(1, 1, log), (2, 0, log), (3, 2, " none "), (4, None, log)], "id int, exit_code int, log string"))
    assert "regexp_extract(" not in df._jdf.queryExecution().optimizedPlan().toString()
    two = [(0, "ERROR", "src/A.java", 7, "gone"), (1, "ERROR", "b/B.java", 8, "lost")]
    assert rows(df) == sorted([(1, *t) for t in two] + [(4, *t) for t in two] + [
        (2, 0, "INFO", None, None, "Sandbox compile passed (mvn -DskipTests compile)"), (3, 0, "ERROR", None, None, "Sandbox compile failed (exit 2); tail:  none ")], key=repr)


def below_exchange(df):
    """What Spark does before it deals the rows out."""
    return df._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)[1]


def test_hits_are_searched_after_the_repartition(spark):
    df = spark.range(3).repartition(4, "id").select(F.lit("p").alias("project_id"), F.concat("id", F.lit(".java")).alias("path"), F.concat(F.lit("  t.publish(a"), "id", F.lit(");\n")).alias("content"))
    hits = N.first_hits(df, U.FEATURE_RULES)
    assert "RLIKE" not in below_exchange(hits)
    assert rows(hits, "path", "line", "text") == [(f"{i}.java", 1, f"t.publish(a{i});") for i in range(3)]


SCOPES = ("package a;\n\n/* x\n */ class A {\n  int f;\n\n  void m(String a,\n\n      int b) { if (a) { g(); }\n h(); }\n  class B extends\n  C { B() { k(); } void n() { } }\n"
          "  abstract void o(); A() { } }\n  interface I { void p(int a); }\n")


def test_statements_after_the_repartition_with_lines_and_scopes(spark):
    df = spark.createDataFrame([("p", "A.java", SCOPES), ("p", "A.txt", SCOPES)], SCHEMA).repartition(4, "path").select("project_id", "path", F.concat("content", F.lit("")).alias("content"))
    st = K.statements(df)
    assert "Filter" not in below_exchange(st)
    got = [tuple(r) for r in st.orderBy("pos").select("line", "text", "term", "tname", "mname", "owner", "method", "level").collect() if r.term != "}"]
    assert got == [
        (1, "package a", ";", "", "", None, None, 0), (4, "class A", "{", "A", "", None, None, 0), (5, "int f", ";", "", "", "A", None, 0),
        (7, "void m(String a, int b)", "{", "", "m", "A", "m", 0), (9, "if (a)", "{", "", "", "A", "m", 1), (9, "g()", ";", "", "", "A", "m", 2),
        (10, "h()", ";", "", "", "A", "m", 1), (11, "class B extends C", "{", "B", "", "A", None, 0), (12, "B()", "{", "", "B", "B", "B", 0),
        (12, "k()", ";", "", "", "B", "B", 1), (12, "void n()", "{", "", "n", "B", "n", 0), (13, "abstract void o()", ";", "", "o", "A", None, 0),
        (13, "A()", "{", "", "A", "A", "A", 0), (14, "interface I", "{", "I", "", None, None, 0), (14, "void p(int a)", ";", "", "p", "I", None, 0)]


def test_fields_are_the_variables_of_level_zero(spark):
    f = facts(spark, {"core/F.java": "package a.core;\nclass F {\n  int a; @X String[] b = {};\n  void m(int c) { int d = 1; }\n}\n"})
    assert rows(f.fields) == rows(f.variables.filter("is_field")) and f.fields.count() == 2


def test_report_makes_shared_tables_once(spark, monkeypatch):
    """The checks of a report share calls, members and the types' ancestors, and find what each finds alone."""
    made, closure = [], T.closure
    monkeypatch.setattr(T, "closure", lambda *a: made.append(a) or closure(*a))
    df = spark.createDataFrame([("p", k, v) for k, v in {**BASE, "core/Wrong.java": BAD}.items()], SCHEMA)
    deny = spark.createDataFrame([(0, "a.core.*")], "ord int, key string")
    f = K.extract_facts(df)
    report = N.full_report(f, df, deny)
    assert len(made) == 2  # with and without interfaces
    alone = [row for check in T.CHECKS for row in check(K.extract_facts(df, False)).collect()]
    assert rows(report.filter("category = 'CONTRACT'"), "path", "line", "message") == sorted(
        [(r.path, r.line, f"[{r.kind}] {r.symbol}") for r in alone], key=repr)
