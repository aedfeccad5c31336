"""Validation findings: line rules, scoring, report tables, log mining, runner registry."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.text import java_trim
from codelake.operators import slices

# Fixed runner ids and labels.
ALWAYS_ON = ["contract", "pubsub-leak", "static", "migration-quality"]
RUNNER_LABELS = {
    "contract": "Contract Validation",
    "pubsub-leak": "Pub/Sub Leak Validation",
    "static": "Static Analysis",
    "docker": "Docker Compile",
    "docker-boot": "Docker Boot Health",
    "docker-test": "Unit Tests",
    "migration-quality": "Migration Quality",
}
FINDING_COLUMNS = ["project_id", "runner_id", "severity", "path", "line", "message"]


def stages(findings: DataFrame) -> DataFrame:
    """Errors, warnings and verdict per (project, runner); four runners always appear."""
    seen = findings.groupBy("project_id", "runner_id").agg(
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
    )
    projects = seen.select("project_id").distinct()
    always = projects.select("project_id", F.explode(F.array(*[F.lit(r) for r in ALWAYS_ON])).alias("runner_id"))
    label = F.col("runner_id")
    for runner, text in RUNNER_LABELS.items():
        label = F.when(F.col("runner_id") == runner, text).otherwise(label)
    return always.join(seen, ["project_id", "runner_id"], "full_outer").select(
        "project_id", "runner_id", label.alias("label"),
        F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"),
        (F.coalesce("errors", F.lit(0)) == 0).alias("passed"),
    )


def risks(findings: DataFrame, features: DataFrame, notes: DataFrame, advice: str = "Check this by hand.",
          feature_advice: str = "Check this by hand; the notes of its file say more.") -> DataFrame:
    """Warnings and notes are MEDIUM risks; features without a target are LOW.

    ``features`` is (project_id, path, id, description, target), ``notes`` (project_id, note).
    The advice texts are the caller's.
    """
    review = F.lit(advice)
    warn = findings.filter(F.col("severity") == "WARNING").select(
        "project_id", F.lit("MEDIUM").alias("level"), "path", F.col("message").alias("text"), review.alias("advice"))
    noted = notes.select("project_id", F.lit("MEDIUM").alias("level"), F.lit(None).cast("string").alias("path"),
                         F.col("note").alias("text"), review.alias("advice"))
    unmapped = features.filter(F.trim(F.coalesce("target", F.lit(""))) == "").select(
        "project_id", F.lit("LOW").alias("level"), "path",
        F.concat(F.lit("No target is known for "), "id", F.lit(": "), "description").alias("text"), F.lit(feature_advice).alias("advice"))
    return warn.unionByName(noted).unionByName(unmapped)


def confidence(findings: DataFrame, risk_rows: DataFrame) -> DataFrame:
    """Score 0..100 per project: minus 30 if failed, 15 an error (60), 3 a warning (15), 5 an unmapped feature (20)."""
    f = findings.groupBy("project_id").agg(
        F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    r = risk_rows.groupBy("project_id").agg(F.count_if(F.col("level") == "LOW").alias("unmapped"), F.count(F.lit(1)).alias("risks"))
    score = (
        F.lit(100)
        - F.when(F.col("errors") > 0, 30).otherwise(0)
        - F.least(F.lit(60), F.col("errors") * 15)
        - F.least(F.lit(15), F.col("warnings") * 3)
        - F.least(F.lit(20), F.coalesce("unmapped", F.lit(0)) * 5)
    )
    return f.join(r, "project_id", "left").select(
        "project_id", "errors", "warnings", F.coalesce("risks", F.lit(0)).alias("risks"),
        F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint").alias("score"))


def verdict(scored: DataFrame, manual: DataFrame) -> DataFrame:
    """Status and recommendation from errors, risks and manual actions."""
    m = manual.groupBy("project_id").agg(F.count(F.lit(1)).alias("manual"))
    clean = (F.col("risks") == 0) & (F.coalesce("manual", F.lit(0)) == 0)
    failed = F.col("errors") > 0
    return scored.join(m, "project_id", "left").select(
        "project_id",
        F.when(failed, "FAILED").when(clean, "SUCCESS").otherwise("PARTIAL").alias("status"),
        F.when(failed, "DO_NOT_DEPLOY").when(clean, "APPROVE_FOR_DEPLOYMENT").otherwise("MANUAL_REVIEW_REQUIRED").alias("recommendation"),
        "score",
    )


def by_file(findings: DataFrame, order: Sequence[str], slice_by: Column) -> DataFrame:
    """Findings with their position inside the file: grouped rows, not one list per file,
    so a file with very many findings stays spread out."""
    return slices.row_numbers(findings, ["project_id", "path"], order, "position", slice_by)


def kinds(findings: DataFrame, kind: str) -> DataFrame:
    """Distinct kinds per project."""
    return findings.select("project_id", kind).distinct()


def semantic_report(parts: dict[str, DataFrame]) -> DataFrame:
    """All findings (project_id, path, line, symbol, message) with their category."""
    cols = ["project_id", "path", "line", "symbol", "message"]
    return reduce(
        DataFrame.unionByName,
        [df.select(*cols).withColumn("category", F.lit(name)) for name, df in parts.items()],
    )


def full_report(f, files: DataFrame, deny: DataFrame, hybrid: bool = True, dependencies: DataFrame | None = None) -> DataFrame:
    """Every semantic check over a corpus, as one report.

    ``f`` holds the facts of ``files``, ``deny`` the forbidden names (ord, key), and
    ``dependencies`` findings about build files, if there are any.  The last four
    categories mean something for the hybrid target only.
    """
    from codelake.operators import code_rules, contracts

    f.variables  # noqa: B018  several checks read them: made first, so that fields are taken from them
    leaks = reduce(DataFrame.unionByName, [check(f) for check in (code_rules.leak_imports, code_rules.leak_types, code_rules.leak_calls)])
    forbidden = code_rules.forbidden_imports(f, deny).withColumn("kind", F.concat(F.lit("FORBIDDEN "), "rule"))
    parts = {"CONTRACT": contracts.contract_violations(f), "PUBSUB_LEAK": leaks, "FORBIDDEN_IMPORT": forbidden, "OVERENGINEERING": code_rules.listener_misuse(f)}
    if dependencies is not None:
        parts["DEPENDENCY"] = dependencies
    if hybrid:
        parts |= {"TX_GAP": code_rules.scope_gap(f), "TARGET_DRIFT": code_rules.target_drift(f), "CONSUMER_NOT_CONVERTED": code_rules.unconverted(f),
                  "NO_LISTENERS_FOUND": code_rules.no_listeners(files)}
    return semantic_report({name: df.withColumn("message", F.concat(F.lit("["), "kind", F.lit("] "), "symbol")) for name, df in parts.items()})


def report_verdict(report: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, files, findings, clean): a project without findings is clean; each project has a row."""
    sizes = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))
    found = report.groupBy("project_id").agg(F.count(F.lit(1)).alias("findings"))
    return sizes.join(found, "project_id", "left").select("project_id", "files", F.coalesce("findings", F.lit(0)).alias("findings"), F.col("findings").isNull().alias("clean"))


def category_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("project_id", "category").agg(F.count(F.lit(1)).alias("n"))


# ---- rules over lines ----------------------------------------------------------------

def lines_of(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per line with its 1-based number."""
    rest = [c for c in df.columns if c != content]
    return df.select(*rest, F.posexplode(F.split(F.col(content), "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def enclosing(lines: DataFrame, keys: Sequence[str], declares: Column) -> DataFrame:
    """Number of the last line at or above each line that declares something.

    The window holds the line numbers of one text, never its contents.
    """
    marked = lines.withColumn("_d", F.when(declares, F.col("line"))).drop("text")
    over = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("enclosing", F.last("_d", ignorenulls=True).over(over)).drop("_d")


# Method declaration line; group 1 is the name.
METHOD_DECL = "\\b(?:public|private|protected|static|final|\\s)*[\\w<>\\[\\],.?]+\\s+(\\w+)\\s*\\([^;]*\\)\\s*\\{?\\s*$"


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def first_hits(files: DataFrame, rules: Sequence[tuple[str, Sequence[str]]], content: str = "content",
               declaration: str | None = None) -> DataFrame:
    """First matching line per (file, rule), evaluated inside the row.

    ``rules`` are (id, regexes) in order.  With ``declaration`` the enclosing
    declaration's name (group 1 of the last matching line at or above) is added.
    """
    ls = F.transform(F.split(F.col(content), "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    any_rule = "|".join(f"(?:{r})" for _, rs in rules for r in rs)
    # No filter: Spark would move it, and with it whatever makes the content, below the caller's repartition.
    pre = files.withColumn("_l", F.when(F.col(content).rlike(any_rule), ls))

    def hit(rule_id, regexes, position):
        rule = "|".join(f"(?:{r})" for r in regexes)
        # A line that fits makes the content fit, so lines are looked at for few rules only.
        fits = F.when(F.col("_l").isNotNull() & F.col(content).rlike(rule), F.filter("_l", lambda x: x["text"].rlike(rule)))
        return F.transform(F.slice(fits, 1, 1), lambda x: F.struct(F.lit(position).alias("ord"), F.lit(rule_id).alias("feature_id"), x["line"].alias("line"), x["text"].alias("text")))

    hits = F.flatten(F.filter(F.array(*[hit(rid, rs, n) for n, (rid, rs) in enumerate(rules)]), lambda h: h.isNotNull()))
    rest = [c for c in files.columns if c != content]
    out = pre.select(*rest, "_l", F.inline(hits)).withColumn("text", _strip(F.col("text")))
    if declaration is not None:
        above = F.transform(F.slice(F.col("_l"), F.lit(1), F.col("line")), lambda x: _strip(x["text"]))
        out = out.withColumn("_owner", F.try_element_at(F.filter(above, lambda x: x.rlike(declaration)), F.lit(-1)))
        out = out.withColumn("method", F.when(F.col("_owner").isNotNull(), F.regexp_extract("_owner", declaration, 1))).drop("_owner")
    return out.drop("_l")


def line_of(content: Column, needle: Column) -> Column:
    """1-based line of the first occurrence, null when there is none."""
    at = F.instr(content, needle)
    before = F.substr(content, F.lit(1), at - 1)
    return F.when(at > 0, F.size(F.split(before, "\n", -1)))


def fragment_hits(files: DataFrame, fragments: Sequence[str], kind: str) -> DataFrame:
    """First occurrence of each literal fragment per file, with its line."""
    hits = F.array(*[
        F.struct(F.lit(f).alias("symbol"), line_of(F.col("content"), F.lit(f)).alias("line")) for f in fragments
    ])
    rest = [c for c in files.columns if c != "content"]
    return files.select(*rest, F.inline(F.filter(hits, lambda h: h["line"].isNotNull()))).withColumn("kind", F.lit(kind))


def pattern_findings(files: DataFrame, runner: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One finding per (file, rule) for rules (regex, severity, message) over contents."""
    hits = F.array(*[
        F.when(F.col("content").rlike(rx), F.struct(F.lit(sev).alias("severity"), F.lit(msg).alias("message")))
        for rx, sev, msg in rules
    ])
    found = files.select("project_id", "path", F.inline(F.filter(hits, lambda h: h.isNotNull())))
    return found.select("project_id", F.lit(runner).alias("runner_id"), "severity", "path", F.lit(None).cast("int").alias("line"), "message")


# Fixed quality patterns.
QUALITY_RULES = [
    ("(?i)//\\s*(TODO|FIXME|XXX|HACK)[:\\s]|//\\s*\\.\\.\\.(rest|implementation|your code|continue|etc)"
     "|/\\*\\s*(Add|Implement|Insert|Place)\\s+your|//\\s*Original (Pub/Sub|implementation|code)"
     "|//\\s*(MANUAL POLLING|RECOMMENDED APPROACH|TO ACTIVATE)", "ERROR", "scaffolding marker left in source"),
    ("(public|private|protected)\\s+[\\w<>,\\s\\[\\]]+\\s+\\w+\\s*\\([^)]*\\)\\s*(throws\\s+[\\w.,\\s]+)?\\s*\\{\\s*"
     "(/\\*[^*]*\\*/|//[^\\n]*\\n|\\s)*\\}", "ERROR", "empty method body"),
    ("\\b(catch\\s*\\(|throws\\s+[\\w.,\\s]*)\\bPub[Ss]ubException\\b", "ERROR", "stale exception in catch or throws"),
    ("(log|logger|LOG|LOGGER)\\.(trace|debug|info|warn|error)\\s*\\(\\s*\"[^\"]*Pub[/-]?Sub[^\"]*\"", "WARNING", "stale log text"),
]
# Fixed static-check markers.
STATIC_RULES = [
    ("google\\.cloud\\.pubsub", "ERROR", "Pub/Sub import not removed after migration"),
    ("@SubscriberHandler|@PubSubListener", "ERROR", "Pub/Sub annotation still present after migration"),
]
STATIC_JAVA_RULES = [("com\\.google\\.api\\.services\\.pubsub", "ERROR", "Legacy GCP Pub/Sub REST v1 import not removed")]


def quality_checks(files: DataFrame) -> DataFrame:
    """Quality rules on modified Java files."""
    java = files.filter((F.col("change_type") == "MODIFIED") & F.col("path").endswith(".java"))
    return pattern_findings(java, "migration-quality", QUALITY_RULES)


def static_checks(files: DataFrame) -> DataFrame:
    """Blank, marker and annotation checks on modified files; a warning per project without any."""
    modified = files.filter(F.col("change_type") == "MODIFIED")
    blank = java_trim(F.coalesce("content", F.lit(""))) == ""
    empty = modified.filter(blank).select(
        "project_id", F.lit("static").alias("runner_id"), F.lit("ERROR").alias("severity"), "path",
        F.lit(None).cast("int").alias("line"), F.lit("migrated file is empty").alias("message"))
    filled = modified.filter(~blank)
    idle = files.groupBy("project_id").agg(F.bool_or(F.col("change_type") == "MODIFIED").alias("m")).filter(~F.col("m")).select(
        "project_id", F.lit("static").alias("runner_id"), F.lit("WARNING").alias("severity"), F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("int").alias("line"), F.lit("nothing was changed").alias("message"))
    return (
        empty.unionByName(pattern_findings(filled, "static", STATIC_RULES))
        .unionByName(pattern_findings(filled.filter(F.col("path").endswith(".java")), "static", STATIC_JAVA_RULES))
        .unionByName(idle)
    )


def manual_actions(files: DataFrame, marker: str) -> DataFrame:
    """``path: marker line`` for every marker comment."""
    return files.select(
        "project_id", "path", F.explode(F.regexp_extract_all("content", F.lit(marker), 0)).alias("m")
    ).select("project_id", "path", F.concat("path", F.lit(": "), java_trim(F.col("m"))).alias("action"))


# ---- logs ----------------------------------------------------------------------------

# Fixed log patterns.
COMPILE_ERROR = "\\[ERROR\\]\\s+(.+?\\.java):\\[(\\d+),\\d+\\]\\s+(.+)"
TEST_SUMMARY = "Tests run:\\s+(\\d+),\\s+Failures:\\s+(\\d+),\\s+Errors:\\s+(\\d+),\\s+Skipped:\\s+(\\d+)"
TEST_FAILURE = "(?m)^\\s*([\\w.$]+(?:Test|IT))\\.(\\w+):\\s*(.+)$"


def _tail(log: Column, chars: int | None) -> Column:
    """The log's last ``chars`` characters; the whole log without a limit."""
    return log if chars is None else F.when(F.length(log) > chars, F.substring(log, -chars, chars)).otherwise(log)


def _hits(pattern: str, most: int | None, group: int = 0) -> Column:
    found = F.regexp_extract_all("log", F.lit(pattern), group)
    return found if most is None else F.slice(found, 1, most)


def _one(severity: str, message: Column) -> Column:
    none = F.lit(None)
    return F.array(F.struct(F.lit(severity).alias("severity"), none.cast("string").alias("path"), none.cast("int").alias("line"), message.alias("message")))


def parse_compile_log(logs: DataFrame, max_findings: int | None = None, tail_chars: int | None = None) -> DataFrame:
    """(…, exit_code, log) to findings: one per compiler error line, else the log's tail."""
    code = F.col("exit_code")
    one = lambda text: F.array(F.struct(F.lit(None).cast("string").alias("p"), F.lit(None).cast("string").alias("l"), text.alias("m")))
    group = lambda n: _hits(COMPILE_ERROR, max_findings, n)
    # The groups are read in a pass each over the whole log; what is made of them is made of rows.
    found = logs.withColumn("_p", F.when(F.coalesce(code != 0, F.lit(True)), group(1)))
    out = (
        F.when(code == 0, one(F.lit("Sandbox compile passed (mvn -DskipTests compile)")))
        .when(F.size("_p") > 0, F.arrays_zip(F.col("_p").alias("p"), group(2).alias("l"), group(3).alias("m")))
        .otherwise(one(F.concat(F.lit("Sandbox compile failed (exit "), code.cast("string"), F.lit("); tail: "), _tail(F.col("log"), tail_chars))))
    )
    rest = [c for c in logs.columns if c not in ("exit_code", "log")]
    at = F.instr("p", "/workspace/")
    return found.select(*rest, "exit_code", F.posexplode(out).alias("pos", "f")).select(*rest, "exit_code", "pos", "f.*").select(
        *rest, "pos", F.when(F.col("p").isNull() & (code == 0), "INFO").otherwise("ERROR").alias("severity"),
        F.when(at > 0, F.substr("p", at + len("/workspace/"), F.length("p"))).otherwise(F.col("p")).alias("path"),
        F.col("l").cast("int").alias("line"), F.when(F.col("p").isNotNull(), java_trim(F.col("m"))).otherwise(F.col("m")).alias("message"))


def parse_test_log(logs: DataFrame, max_findings: int | None = None, tail_chars: int | None = None) -> DataFrame:
    """(…, exit_code, log) to findings from the last summary line and the failing tests."""
    last = F.try_element_at(F.regexp_extract_all("log", F.lit(TEST_SUMMARY), 0), F.lit(-1))
    n = lambda g: F.coalesce(F.regexp_extract(last, TEST_SUMMARY, g).cast("int"), F.lit(0))
    df = logs.withColumn("_t", n(1)).withColumn("_f", n(2)).withColumn("_e", n(3)).withColumn("_s", n(4))
    text = lambda c: F.col(c).cast("string")
    df = df.withColumn("_hits", _hits(TEST_FAILURE, max_findings))
    hits = F.col("_hits")

    def finding(x):
        name = F.concat(F.regexp_extract(x, TEST_FAILURE, 1), F.lit("."), F.regexp_extract(x, TEST_FAILURE, 2), F.lit("()"))
        return F.struct(F.lit("ERROR").alias("severity"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"),
                        F.concat(name, F.lit(": "), java_trim(F.regexp_extract(x, TEST_FAILURE, 3))).alias("message"))

    clean = (F.col("exit_code") == 0) & (F.col("_f") == 0) & (F.col("_e") == 0)
    passed = F.when(F.col("_t") == 0, "No tests in project — sandbox test runner had nothing to run").otherwise(
        F.concat(F.lit("Sandbox tests passed ("), text("_t"), F.lit(" run, "), text("_s"), F.lit(" skipped)")))
    failed = F.concat(F.lit("Sandbox tests failed: "), text("_f"), F.lit(" failure(s), "), text("_e"), F.lit(" error(s) of "), text("_t"), F.lit(" test(s)"))
    exited = F.concat(F.lit("Sandbox tests exited "), text("exit_code"), F.lit(" (no parseable failures); tail: "), _tail(F.col("log"), tail_chars))
    out = (
        F.when(clean, _one("INFO", passed))
        .when(F.size(hits) > 0, F.transform(hits, finding))
        .when((F.col("_f") > 0) | (F.col("_e") > 0), _one("ERROR", failed))
        .otherwise(_one("ERROR", exited))
    )
    rest = [c for c in logs.columns if c not in ("exit_code", "log")]
    return df.select(*rest, F.posexplode(out).alias("pos", "f")).select(*rest, "pos", "f.*")


# ---- runner registry -----------------------------------------------------------------

@dataclass
class Runner:
    name: str
    order: int
    run: Callable[[DataFrame], DataFrame]
    available: Callable[[], bool] = lambda: True


@dataclass
class RunnerRegistry:
    """Finding runners in order; one that is unavailable or throws is skipped, never fatal.

    ``skipped`` says which and why, so a caller can tell a passing project from one that
    nobody looked at.
    """

    runners: list[Runner] = field(default_factory=list)
    reasons: list[tuple[int, str, str]] = field(default_factory=list)

    def skipped(self, files: DataFrame) -> DataFrame:
        """(project_id, runner_order, runner, reason): the runners that the last ``run`` left out, for each project."""
        rows = [F.struct(F.lit(o).alias("runner_order"), F.lit(n).alias("runner"), F.lit(r).alias("reason")) for o, n, r in self.reasons]
        reasons = F.array(*rows) if rows else F.array().cast("array<struct<runner_order int, runner string, reason string>>")
        return files.select("project_id").distinct().select("project_id", F.explode(reasons).alias("_r")).select("project_id", "_r.*")

    def add(self, name: str, order: int, run: Callable[[DataFrame], DataFrame], available: Callable[[], bool] = lambda: True) -> None:
        self.runners.append(Runner(name, order, run, available))

    def run(self, files: DataFrame) -> DataFrame:
        parts, self.reasons = [], []
        for runner in sorted(self.runners, key=lambda r: (r.order, r.name)):
            try:
                if runner.available():
                    found = runner.run(files).select(*FINDING_COLUMNS)
                    parts.append(found.withColumn("runner_order", F.lit(runner.order)))
                else:
                    self.reasons.append((runner.order, runner.name, "unavailable"))
            except Exception:  # noqa: BLE001
                self.reasons.append((runner.order, runner.name, "failed"))
                logging.getLogger(__name__).warning("runner %s skipped", runner.name, exc_info=True)
        if not parts:
            return files.sparkSession.createDataFrame(
                [], "project_id string, runner_id string, severity string, path string, line int, message string, runner_order int")
        return reduce(DataFrame.unionByName, parts)


def passed(findings: DataFrame) -> DataFrame:
    """A project passes when no finding is an error."""
    return findings.groupBy("project_id").agg((F.count_if(F.col("severity") == "ERROR") == 0).alias("passed"))
