"""Queries over a code corpus that Spark writes from the part and supplier tables.

Every part becomes one Java file and every supplier one build or configuration file,
so the corpus grows with the tables.  The checking SQL never sees the sources: it
states from the part's own columns what the facts and findings have to be.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake.operators import code_rules as U
from codelake.operators import contracts as T
from codelake.operators import facts as K
from codelake.operators import findings as N
from codelake.operators import graph as G
from codelake.operators import joins as J
from codelake.plans.registry import ORACLES, query

JAVA_TEMPLATE = """package com.acme.p{P}.{pkg};

import com.acme.p{P}.api.Api{i};
{gone}{google}{util}import java.util.List;
import static com.acme.p{P}.core.Names.go;

/** Generated {{ from a part; */
{scoped}{public}class C{j}{ext} implements Api{i} {{
    private final C{t} dep; // the neighbour {{
    private List<String> items;
{pub}{miss}{props}
    public C{j}(String a{arg2}) {{
        this.dep = null;
        start();
    }}
{handle}
    public void size{i}() {{
        C{t} other = new C{t}("x, y"{new2});
{chain}        other.run{t}("y");
    }}

    public void run{j}(String a) {{
        helper();
    }}

    private void start() {{ helper(); }}

    private void helper() {{ }}
{ghost}{seam}{listen}{poll}}}
"""


def code_files(t):
    """(project_id, path, content, change_type): 50 files per project."""
    s, key = F.col("p_size"), F.col("p_partkey")
    text = lambda c: c.cast("bigint").cast("string")
    j = (key % 50).alias("j")
    # A few bytes per part become kilobytes of source to be parsed: spread the parts first.
    spread = t.part.repartition(4 * t.spark.sparkContext.defaultParallelism, "p_partkey")
    p = spread.select(
        F.floor(key / 50).alias("P"), j, F.floor((key % 50) / 10).alias("i"), s.alias("s"), "p_brand").withColumn(
        "t", F.when(F.col("j") % 10 >= 2, F.col("j") - 1).otherwise(F.col("j")))
    s = F.col("s")
    v = {n: text(F.col(n)) for n in "P j i t".split()}

    def fill(template, extra=None):
        """The template as one concat over the row's columns."""
        import re

        parts = []
        for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
            if piece in ("{{", "}}"):
                parts.append(F.lit(piece[0]))
            elif re.fullmatch(r"\{\w+\}", piece):
                parts.append((extra or {}).get(piece[1:-1], v.get(piece[1:-1])))
            elif piece:
                parts.append(F.lit(piece))
        return F.concat(*parts)

    opt = lambda cond, template, other="": F.when(cond, fill(template)).otherwise(fill(other) if other else F.lit(""))
    util = F.col("j") % 10 == 9
    handle = """
    @Override
    public String handle{i}(String a, int b) {{
        {call}
        return a;
    }}
"""
    call = F.when(s % 8 == 0, fill("dep.lost{t}(a);")).otherwise(fill("dep.run{t}(a);"))
    body = fill(handle, {"call": call})
    extra = {
        "pkg": F.when(util, "util").otherwise("core"),
        "gone": opt(s % 5 == 0, "import com.acme.p{P}.core.Gone{j};\n"),
        "google": opt(s % 7 == 0, "import com.google.cloud.pubsub.Publisher;\n"),
        "util": opt(util, "import com.acme.p{P}.core.C{t};\n"),
        "scoped": opt(s % 4 == 0, "@ApplicationScoped\n"),
        "public": opt(s % 11 != 0, "public "),
        "ext": opt((F.col("j") % 10 >= 2) & (F.col("j") % 3 == 0), " extends C{t}"),
        "pub": F.when(s % 14 == 0, "    @Inject\n    Publisher pub;\n").when(s % 7 == 0, "    private Publisher pub;\n").otherwise(""),
        "miss": opt(s % 10 == 0, "    Missing{j} miss;\n"),
        "props": opt(s % 13 == 0, "    private ContainerProperties props;\n"),
        "arg2": opt(s % 2 == 0, ", int b"),
        "handle": F.when(s % 6 == 0, "").when(s % 6 == 1, F.replace(body, F.lit("int b"), F.lit("long b"))).otherwise(body),
        "new2": opt(s % 3 == 0, ", 1"),
        "chain": opt(s % 7 == 0, "        svc.projects().topics().publish(items.get(0), go(1));\n"),
        "ghost": opt(s % 9 == 0, "\n    @Override\n    public void ghost{j}() {{ int x = 1; }}\n"),
        "seam": opt(s % 14 == 0, "\n    public void publish(String a) {{ int y = 1; }}\n"),
        "listen": opt(s % 13 == 0, '\n    @KafkaListener(topics = {{"t{j}"}})\n    public void on{j}(String m) {{\n'
                      '        kafka.publish("t", m);\n        CdiLookup.get(C{t}.class).run{t}(m);\n    }}\n'),
        "poll": opt(s % 13 == 1, '\n    void poll() {{\n        sub.consume("x");\n        KafkaProducer p = new KafkaProducer(cfg);\n'
                    '        getOrCreateSubscription(Cfg.TOPIC_{j}, name(Cfg.SUB_{j}));\n        // TODO: later\n    }}\n'),
    }
    api = fill("package com.acme.p{P}.api;\n\npublic interface Api{i}{up} {{\n    String handle{i}(String a, int b);\n    void size{i}();\n}}\n",
               {"up": F.when(F.col("i") == 1, " extends Api0").otherwise("")})
    is_api = F.col("j") % 10 == 0
    path = F.when(is_api, fill("proj{P}/src/api/Api{i}.java")).when(F.col("p_brand") == "Brand#7", fill("proj{P}/src/core/Old{j}.java")).otherwise(
        fill("proj{P}/src/core/C{j}.java"))
    return p.select(fill("proj{P}").alias("project_id"), path.alias("path"), F.when(is_api, api).otherwise(fill(JAVA_TEMPLATE, extra)).alias("content"),
                    F.lit("MODIFIED").alias("change_type"))


def build_files(t):
    """One pom.xml, build.gradle or application.yml per supplier's project."""
    n = F.col("s_nationkey")
    version = (n + 1).cast("string")
    dep = F.when(n % 4 == 0, "\n  google-cloud-pubsub").otherwise("")
    stack = F.when(n % 5 == 0, "\n  spring-boot-starter").when(n % 5 == 1, "\n  quarkus").when(n % 5 == 2, "\n  jakarta.jakartaee-api").otherwise("")
    pom = F.concat(F.lit("<project>"), dep, stack, F.lit("\n<maven.compiler.release>"), version, F.lit("</maven.compiler.release>\n</project>"))
    gradle = F.concat(F.lit("plugins {}"), dep, stack, F.lit("\nsourceCompatibility = '"), version, F.lit("'\n"))
    yml = F.when(n % 2 == 0, "spring:\n  cloud:\n    gcp:\n      # note\n      pubsub:\n        id: x\n").otherwise("app:\n  gcp:\n    other: 1\n  pubsub:\n    id: y\n")
    kind = n % 3
    name = F.when(kind == 0, "pom.xml").when(kind == 1, "build.gradle").otherwise("src/application.yml")
    project = F.concat(F.lit("sup"), F.col("s_suppkey").cast("string"))
    return t.supplier.select(project.alias("project_id"), F.concat(project, F.lit("/"), name).alias("path"),
                             F.when(kind == 0, pom).when(kind == 1, gradle).otherwise(yml).alias("content"))


def facts(t, materialise=False):
    return K.extract_facts(code_files(t), materialise)


# c: one row per part with what its file is made from; st and ut belong to the neighbour C{t}.
C_SQL = """
    c0 AS (SELECT p_partkey // 50 AS P, p_partkey % 50 AS j, (p_partkey % 50) // 10 AS i, p_size AS s, p_brand FROM part),
    c1 AS (SELECT *, CASE WHEN j % 10 >= 2 THEN j - 1 ELSE j END AS t, j % 10 >= 2 AND j % 3 = 0 AS ext FROM c0),
    c AS (SELECT c1.*, o.s AS st, 'proj' || c1.P AS project_id,
            'proj' || c1.P || CASE WHEN c1.j % 10 = 0 THEN '/src/api/Api' || c1.i WHEN c1.p_brand = 'Brand#7' THEN '/src/core/Old' || c1.j ELSE '/src/core/C' || c1.j END || '.java' AS path,
            'com.acme.p' || c1.P || CASE WHEN c1.j % 10 = 0 THEN '.api' WHEN c1.j % 10 = 9 THEN '.util' ELSE '.core' END AS package
          FROM c1 JOIN c0 o ON o.P = c1.P AND o.j = c1.t),
    k AS (SELECT * FROM c WHERE j % 10 <> 0)"""


@query("cd1_types", f"""WITH {C_SQL}
    SELECT path, CASE WHEN j % 10 = 0 THEN 'Api' || i ELSE 'C' || j END AS name, package || '.' || CASE WHEN j % 10 = 0 THEN 'Api' || i ELSE 'C' || j END AS fqn,
      CASE WHEN j % 10 = 0 THEN 'INTERFACE' ELSE 'CLASS' END AS kind, j % 10 = 0 OR s % 11 <> 0 AS is_public,
      CASE WHEN j % 10 = 0 THEN CASE WHEN i = 1 THEN 'Api0' ELSE '' END ELSE CASE WHEN ext THEN 'C' || t ELSE '' END END AS ext,
      CASE WHEN j % 10 = 0 THEN '' ELSE 'Api' || i END AS impl, CASE WHEN j % 10 <> 0 AND s % 4 = 0 THEN 'ApplicationScoped' ELSE '' END AS annos,
      CASE WHEN j % 10 = 0 THEN 3 ELSE 8 + CASE WHEN s % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN s % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN j % 10 = 9 THEN 1 ELSE 0 END END AS line FROM c""")
def _(t):
    return facts(t).types.select("path", "name", "fqn", "kind", "is_public", F.array_join("extends", ",").alias("ext"), F.array_join("implements", ",").alias("impl"),
                                 F.array_join("annotations", ",").alias("annos"), F.col("line").cast("bigint").alias("line"))


IMPORTS_SQL = """imp AS (
    SELECT project_id, path, package, 'com.acme.p' || P || '.api.Api' || i AS name, false AS is_static FROM k
    UNION ALL SELECT project_id, path, package, 'com.acme.p' || P || '.core.Gone' || j, false FROM k WHERE s % 5 = 0
    UNION ALL SELECT project_id, path, package, 'com.google.cloud.pubsub.Publisher', false FROM k WHERE s % 7 = 0
    UNION ALL SELECT project_id, path, package, 'com.acme.p' || P || '.core.C' || t, false FROM k WHERE j % 10 = 9
    UNION ALL SELECT project_id, path, package, 'java.util.List', false FROM k
    UNION ALL SELECT project_id, path, package, 'com.acme.p' || P || '.core.Names.go', true FROM k)"""


@query("cd1_imports", f"WITH {C_SQL}, {IMPORTS_SQL} SELECT path, name, is_static FROM imp")
def _(t):
    return facts(t).imports.select("path", "name", "is_static")


METHODS_SQL = """m AS (
    SELECT path, 'Api' || i AS owner, 'handle' || i AS name, 'String,int' AS params, 'String' AS ret FROM c WHERE j % 10 = 0
    UNION ALL SELECT path, 'Api' || i, 'size' || i, '', 'void' FROM c WHERE j % 10 = 0
    UNION ALL SELECT path, 'C' || j, 'handle' || i, CASE WHEN s % 6 = 1 THEN 'String,long' ELSE 'String,int' END, 'String' FROM k WHERE s % 6 <> 0
    UNION ALL SELECT path, 'C' || j, 'size' || i, '', 'void' FROM k
    UNION ALL SELECT path, 'C' || j, 'run' || j, 'String', 'void' FROM k
    UNION ALL SELECT path, 'C' || j, x, '', 'void' FROM k, (VALUES ('start'), ('helper')) AS v(x)
    UNION ALL SELECT path, 'C' || j, 'ghost' || j, '', 'void' FROM k WHERE s % 9 = 0
    UNION ALL SELECT path, 'C' || j, 'publish', 'String', 'void' FROM k WHERE s % 14 = 0
    UNION ALL SELECT path, 'C' || j, 'on' || j, 'String', 'void' FROM k WHERE s % 13 = 0
    UNION ALL SELECT path, 'C' || j, 'poll', '', 'void' FROM k WHERE s % 13 = 1)"""


@query("cd1_methods", f"WITH {C_SQL}, {METHODS_SQL} SELECT * FROM m")
def _(t):
    return facts(t).methods.select("path", "owner", "name", F.array_join("param_types", ",").alias("params"), F.col("return_type").alias("ret"))


@query("cd1_constructors", f"WITH {C_SQL} SELECT path, 'C' || j AS owner, 1 + CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END AS arity FROM k")
def _(t):
    return facts(t).constructors.select("path", "owner", "arity")


@query("cd1_creations", f"""WITH {C_SQL}
    SELECT path, 'size' || i AS method, 'C' || t AS type, 1 + CASE WHEN s % 3 = 0 THEN 1 ELSE 0 END AS arity FROM k
    UNION ALL SELECT path, 'poll', 'KafkaProducer', 1 FROM k WHERE s % 13 = 1""")
def _(t):
    return facts(t).creations.select("path", "method", "type", "arity")


CALLS_SQL = """cl AS (
    SELECT path, 'C' || j AS method, '' AS receiver, 'start' AS name, 0 AS arity FROM k
    UNION ALL SELECT path, 'handle' || i, 'dep', CASE WHEN s % 8 = 0 THEN 'lost' ELSE 'run' END || t, 1 FROM k WHERE s % 6 <> 0
    UNION ALL SELECT path, 'size' || i, 'other', 'run' || t, 1 FROM k
    UNION ALL SELECT path, m, '', 'helper', 0 FROM (SELECT path, 'run' || j AS m FROM k UNION ALL SELECT path, 'start' FROM k)
    UNION ALL SELECT path, 'size' || i, r, n, a FROM k, (VALUES ('svc', 'projects', 0), ('items', 'get', 1), ('', 'go', 1), ('*', 'topics', 0), ('*', 'publish', 2)) AS v(r, n, a) WHERE s % 7 = 0
    UNION ALL SELECT path, 'on' || j, r, n, a FROM k, (VALUES ('kafka', 'publish', 2), ('CdiLookup', 'get', 1)) AS v(r, n, a) WHERE s % 13 = 0
    UNION ALL SELECT path, 'on' || j, '*', 'run' || t, 1 FROM k WHERE s % 13 = 0
    UNION ALL SELECT path, 'poll', r, n, a FROM k, (VALUES ('sub', 'consume', 1), ('', 'getOrCreateSubscription', 2), ('', 'name', 1)) AS v(r, n, a) WHERE s % 13 = 1)"""


@query("cd1_calls", f"WITH {C_SQL}, {CALLS_SQL} SELECT * FROM cl")
def _(t):
    receiver = F.when(F.col("receiver").contains(K.CALLED), "*").otherwise(F.col("receiver"))
    return facts(t).calls.select("path", "method", receiver.alias("receiver"), "name", "arity")


# ---- leaks and detectors ---------------------------------------------------------------

@query("cd3_leak_imports", f"WITH {C_SQL} SELECT path, 'com.google.cloud.pubsub.Publisher' AS symbol FROM k WHERE s % 7 = 0")
def _(t):
    return U.leak_imports(facts(t)).select("path", "symbol")


@query("cd4_leak_types", f"WITH {C_SQL} SELECT path, 'Publisher' AS symbol FROM k WHERE s % 7 = 0")
def _(t):
    return U.leak_types(facts(t, True)).select("path", "symbol")


@query("cd5_leak_calls", f"""WITH {C_SQL} SELECT path, '.projects().topics().publish()' AS symbol FROM k WHERE s % 7 = 0
    UNION ALL SELECT path, 'getOrCreateSubscription' FROM k WHERE s % 13 = 1""")
def _(t):
    return U.leak_calls(facts(t)).select("path", "symbol")


SUP_SQL = """sup AS (SELECT 'sup' || s_suppkey AS project_id, s_nationkey AS n, 'sup' || s_suppkey || CASE s_nationkey % 3 WHEN 0 THEN '/pom.xml' WHEN 1 THEN '/build.gradle'
    ELSE '/src/application.yml' END AS path FROM supplier)"""


@query("cd6_leak_build_files", f"WITH {SUP_SQL} SELECT path, 'google-cloud-pubsub' AS symbol, 2 AS line FROM sup WHERE n % 4 = 0 AND n % 3 <> 2")
def _(t):
    return U.leak_dependencies(build_files(t)).select("path", "symbol", "line")


@query("cd7_leak_config", f"WITH {SUP_SQL} SELECT path, 'pubsub:' AS symbol, 5 AS line FROM sup WHERE n % 2 = 0 AND n % 3 = 2")
def _(t):
    return U.leak_config(build_files(t)).select("path", "symbol", "line")


@query("cd8_static_checks", f"WITH {C_SQL} SELECT path, 'ERROR' AS severity, 'Pub/Sub import not removed after migration' AS message FROM k WHERE s % 7 = 0")
def _(t):
    return N.static_checks(code_files(t)).select("path", "severity", "message")


@query("cd9_quality_checks", f"""WITH {C_SQL} SELECT path, 'empty method body' AS message FROM k
    UNION ALL SELECT path, 'scaffolding marker left in source' FROM k WHERE s % 13 = 1""")
def _(t):
    return N.quality_checks(code_files(t)).select("path", "message")


@query("cd10_listener_misuse", f"WITH {C_SQL} SELECT path, 'ContainerProperties' AS symbol FROM k WHERE s % 13 = 0")
def _(t):
    return U.listener_misuse(facts(t, True)).select("path", "symbol")


@query("cd11_target_drift", f"WITH {C_SQL} SELECT path, 'new KafkaProducer' AS symbol FROM k WHERE s % 13 = 1")
def _(t):
    return U.target_drift(facts(t, True)).select("path", "symbol")


@query("cd12_scope_gap", f"WITH {C_SQL} SELECT path, 'C' || t AS symbol, 'TX_GAP' AS kind FROM k WHERE s % 13 = 0 AND st % 4 = 0")
def _(t):
    return U.scope_gap(facts(t, True)).select("path", "symbol", "kind")


@query("cd13_unconverted", f"""WITH {C_SQL} SELECT path, 'on' || j || ' (publish)' AS symbol FROM k WHERE s % 13 = 0
    UNION ALL SELECT path, 'poll (consume)' FROM k WHERE s % 13 = 1""")
def _(t):
    return U.unconverted(facts(t, True)).select("path", "symbol")


@query("cd14_bindings", f"WITH {C_SQL} SELECT project_id, 'SUB_' || j AS subscription, 'TOPIC_' || j AS topic FROM k WHERE s % 13 = 1")
def _(t):
    return U.bindings(facts(t))


@query("cd15_forbidden_imports", f"""WITH {C_SQL} SELECT path, 'com.google.cloud.pubsub.Publisher' AS symbol, 'com.google.cloud.pubsub.*' AS rule FROM k WHERE s % 7 = 0
    UNION ALL SELECT path, 'java.util.List', 'java.util.List' FROM k""")
def _(t):
    deny = t.spark.sql("SELECT * FROM VALUES (0, 'java.util.List'), (1, 'com.google.cloud.pubsub.*'), (2, 'com.google.*') AS d(ord, key)")
    return U.forbidden_imports(facts(t), deny).select("path", "symbol", "rule")


@query("cd16_glue_classes", f"WITH {C_SQL} SELECT path, 'wraps the injected client' AS reason FROM k WHERE s % 14 = 0")
def _(t):
    return U.glue_classes(facts(t, True)).select("path", "reason")


@query("cd2_features", f"""WITH {C_SQL} SELECT path, f AS feature_id, CASE WHEN f LIKE '%single' AND s % 13 = 0 AND s % 7 <> 0 THEN 'on' || j WHEN f LIKE '%single' THEN 'size' || i ELSE 'poll' END AS method
    FROM k, (VALUES ('pubsub.publish-single'), ('pubsub.subscription')) AS v(f)
    WHERE (f LIKE '%single' AND (s % 7 = 0 OR s % 13 = 0)) OR (f LIKE '%subscription' AND s % 13 = 1)""")
def _(t):
    hits = N.first_hits(code_files(t).select("project_id", "path", "content"), U.FEATURE_RULES, declaration=N.METHOD_DECL)
    return hits.select("path", "feature_id", "method")


# ---- contracts ---------------------------------------------------------------------------

@query("ct1_file_class_mismatch", f"WITH {C_SQL} SELECT path, 'C' || j AS symbol FROM k WHERE p_brand = 'Brand#7' AND s % 11 <> 0")
def _(t):
    return T.file_class_mismatch(facts(t)).select("path", "symbol")


@query("ct2_unresolved_imports", f"WITH {C_SQL} SELECT path, 'com.acme.p' || P || '.core.Gone' || j AS symbol FROM k WHERE s % 5 = 0")
def _(t):
    return T.unresolved_imports(facts(t, True)).select("path", "symbol")


@query("jn5_unresolved_imports", f"WITH {C_SQL} SELECT path, 'com.acme.p' || P || '.core.Gone' || j AS name FROM k WHERE s % 5 = 0")
def _(t):
    f = facts(t, True)
    base = F.concat(F.lit("com.acme.p"), F.regexp_extract("project_id", "\\d+", 0))
    return J.unresolved_imports(f.imports, f.types, base).select("path", "name")


@query("ct3_missing_imports", f"""WITH {C_SQL} SELECT path, 'Missing' || j AS symbol FROM k WHERE s % 10 = 0
    UNION ALL SELECT path, 'ContainerProperties' FROM k WHERE s % 13 = 0 UNION ALL SELECT path, 'KafkaProducer' FROM k WHERE s % 13 = 1""")
def _(t):
    return T.missing_imports(facts(t, True)).select("path", "symbol")


@query("ct4_missing_interface_methods", f"""WITH {C_SQL} SELECT path, 'handle' || i || '/2' AS symbol FROM k WHERE s % 6 = 0 AND NOT (ext AND st % 6 <> 0)
    UNION ALL SELECT path, x FROM k, (VALUES ('handle0/2'), ('size0/0')) AS v(x) WHERE i = 1""")
def _(t):
    return T.missing_interface_methods(facts(t, True)).select("path", "symbol")


@query("ct5_signature_mismatches", f"""WITH {C_SQL} SELECT path, 'C' || j || '.handle' || i || '(String,int):String' AS symbol FROM k
    WHERE (s % 6 = 1 AND NOT (ext AND st % 6 > 1)) OR (s % 6 = 0 AND ext AND st % 6 = 1)""")
def _(t):
    return T.signature_mismatches(facts(t, True)).select("path", "symbol")


@query("ct6_bad_constructor_arity", f"""WITH {C_SQL} SELECT path, 'C' || t || '/' || (1 + CASE WHEN s % 3 = 0 THEN 1 ELSE 0 END) AS symbol FROM k WHERE (s % 3 = 0) <> (st % 2 = 0)""")
def _(t):
    return T.bad_constructor_arity(facts(t, True)).select("path", "symbol")


@query("ct6_arity_lineitem", """
    SELECT l_orderkey, l_linenumber, l_partkey AS type FROM lineitem JOIN part ON p_partkey = l_partkey WHERE CAST(l_quantity AS INT) % 5 <> p_size % 5""")
def _(t):
    uses = t.lineitem.select("l_orderkey", "l_linenumber", F.lit("x").alias("project_id"), F.col("l_partkey").alias("type"), (F.col("l_quantity").cast("int") % 5).alias("arity"))
    ctors = t.part.select(F.lit("x").alias("project_id"), F.col("p_partkey").alias("type"), (F.col("p_size") % 5).alias("arity"))
    return T.arity_violations(uses, ctors).select("l_orderkey", "l_linenumber", "type")


@query("ct7_unknown_calls", f"WITH {C_SQL} SELECT path, 'C' || t || '.lost' || t AS symbol FROM k WHERE s % 8 = 0 AND s % 6 <> 0")
def _(t):
    return T.unknown_calls(facts(t, True)).select("path", "symbol")


@query("ct8_invalid_overrides", f"WITH {C_SQL} SELECT path, 'C' || j || '.ghost' || j || '/0' AS symbol FROM k WHERE s % 9 = 0")
def _(t):
    return T.invalid_overrides(facts(t, True)).select("path", "symbol")


@query("ct9_package_private_uses", f"WITH {C_SQL} SELECT path, 'com.acme.p' || P || '.core.C' || t AS symbol FROM k WHERE j % 10 = 9 AND st % 11 = 0")
def _(t):
    return T.package_private_uses(facts(t, True)).select("path", "symbol")


# ---- graph -------------------------------------------------------------------------------

EDGES_SQL = """e AS (
    SELECT project_id, package || '.C' || j AS caller, 'com.acme.p' || P || CASE WHEN t % 10 = 9 THEN '.util' ELSE '.core' END || '.C' || t AS callee FROM k
    UNION SELECT project_id, package || '.C' || j, package || '.C' || j FROM k)"""


@query("gr1_callers", f"WITH {C_SQL}, {EDGES_SQL} SELECT DISTINCT callee, regexp_extract(caller, '[^.]*$') AS caller FROM e")
def _(t):
    return G.callers(U.call_edges(facts(t, True)).filter("project_owned"))


@query("gr1_callees", f"WITH {C_SQL}, {EDGES_SQL} SELECT DISTINCT caller, callee FROM e")
def _(t):
    return G.callees(U.call_edges(facts(t, True)))


@query("gr1_neighbour_counts", "SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
def _(t):
    return G.degree(t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")), "part", "supplier")


@query("gr1_importers", f"WITH {C_SQL}, {IMPORTS_SQL} SELECT DISTINCT name AS target, path AS importer FROM imp")
def _(t):
    return G.importers(facts(t).imports.select(F.col("name").alias("target"), F.col("path").alias("importer")))


@query("gr1_methods_of", f"""WITH {C_SQL}, {METHODS_SQL} SELECT DISTINCT package || CASE WHEN j % 10 = 0 THEN '.Api' || i ELSE '.C' || j END AS fqn, name AS method,
      CAST(CASE WHEN params = '' THEN 0 ELSE len(str_split(params, ',')) END AS INTEGER) AS arity FROM m JOIN (SELECT DISTINCT path, package, i, j FROM c) USING (path)""")
def _(t):
    f = facts(t, True)
    return G.methods_of(f.methods, f.types).select("fqn", "method", "arity")


@query("gr1_classes_by_file", f"WITH {C_SQL} SELECT path, package || CASE WHEN j % 10 = 0 THEN '.Api' || i ELSE '.C' || j END AS fqn, CAST(1 AS INT) AS position FROM c")
def _(t):
    return G.classes_by_file(facts(t).types).select("path", "fqn", "position")


TURNS_SQL = """n AS (SELECT conv_id, turn, role || '-' || conv_id || '-' || turn AS node FROM conversations),
    d AS (SELECT a.node, b.node AS dep FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1),
    r AS (SELECT node, 1 AS pass FROM n WHERE node NOT IN (SELECT node FROM d)
          UNION ALL SELECT d.node, greatest(1, r.pass + CASE WHEN d.dep > d.node THEN 1 ELSE 0 END) FROM r JOIN d ON d.dep = r.node)"""


def turn_graph(t):
    n = t.conversations.select("conv_id", "turn", F.concat_ws("-", "role", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node"))
    prev = n.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("node").alias("dep"))
    return n.select("node"), n.join(prev, ["conv_id", "turn"]).select("node", "dep")


@query("gr2_dependency_order", f"WITH RECURSIVE {TURNS_SQL} SELECT node, max(pass) AS pass, false AS cyclic FROM r GROUP BY 1")
def _(t):
    return G.dependency_order(*turn_graph(t))


@query("gr3_has_cycle", f"WITH RECURSIVE {TURNS_SQL} SELECT count(*) > 0 AS has_cycle FROM n WHERE node NOT IN (SELECT node FROM r)")
def _(t):
    return G.has_cycle(*turn_graph(t))


# Cyclic graph: the last turn of a conversation loops back to its second turn when the conversation has an even id.
@query("gr3_cyclic_nodes", """
    WITH n AS (SELECT conv_id, turn, role || '-' || conv_id || '-' || turn AS node, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
    SELECT node FROM n WHERE turn >= 1 AND last > 1 AND conv_id % 2 = 0""")
def _(t):
    return G.cyclic_nodes(*looped_graph(t))


def looped_graph(t):
    nodes, edges = turn_graph(t)
    c = t.conversations
    name = lambda turn: F.concat_ws("-", "role", F.col("conv_id").cast("string"), turn.cast("string"))
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("turn")).filter("turn > 1 AND conv_id % 2 = 0").join(c, ["conv_id", "turn"]).select("conv_id", name(F.col("turn")).alias("dep"))
    loop = c.filter("turn = 1").select("conv_id", name(F.col("turn")).alias("node")).join(ends, "conv_id").select("node", "dep")
    return nodes, edges.unionByName(loop)


@query("gr3_has_cycle_in_loops", """
    WITH RECURSIVE n AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
    e AS (SELECT conv_id, turn AS a, turn - 1 AS b FROM n WHERE turn >= 1 UNION SELECT conv_id, 1, last FROM n WHERE last > 1 AND conv_id % 2 = 0),
    w AS (SELECT conv_id, a, b FROM e UNION SELECT w.conv_id, w.a, e.b FROM w JOIN e ON e.conv_id = w.conv_id AND e.a = w.b)
    SELECT count(*) > 0 AS has_cycle FROM w WHERE a = b""")
def _(t):
    return G.has_cycle(*looped_graph(t))


@query("gr4_clusters", """
    WITH g AS (SELECT text, min(doc_id) AS first, count(*) AS n, string_agg('d' || lpad(CAST(doc_id AS VARCHAR), 9, '0'), ',' ORDER BY doc_id) AS files FROM documents GROUP BY text)
    SELECT files, n FROM g WHERE n BETWEEN 2 AND 6""")
def _(t):
    """Exact copies joined by a star around their smallest id, never by all pairs."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    star = d.groupBy("h").agg(F.min("doc_id").alias("dst")).join(d, "h").select(F.col("doc_id").alias("src"), "dst")
    names = t.documents.select(F.col("doc_id").alias("node"), F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"))
    return G.clusters(star, names).select(F.array_join("files", ",").alias("files"), "n")


@query("gr4_type_clusters", f"""WITH {C_SQL}, pr AS (
      SELECT k.path AS x, o.path AS y FROM k JOIN c o ON o.P = k.P AND o.j = k.t WHERE k.ext
      UNION ALL SELECT a.path, b.path FROM c a JOIN c b ON b.P = a.P WHERE a.j = 0 AND b.j = 10)
    SELECT least(x, y) || ',' || greatest(x, y) AS files, 2 AS n FROM pr""")
def _(t):
    """Files coupled by class and interface extension."""
    f = facts(t, True)
    tag = lambda c: F.concat_ws("/", "project_id", c)
    edges = U.inheritance_edges(f).filter("kind = 'EXTENDS'").select(tag("subtype").alias("src"), tag("supertype").alias("dst"))
    files = f.types.select(tag("fqn").alias("node"), "path")
    return G.clusters(edges, files).select(F.array_join("files", ",").alias("files"), "n")


@query("gr5_closure", """
    WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
             UNION SELECT 'r' || r_regionkey, 'world' FROM region),
    s AS (SELECT src AS x FROM e UNION SELECT dst FROM e),
    r AS (SELECT x AS src, x AS dst FROM s UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM r""")
def _(t):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t.nation.select(tag("n", "n_nationkey").alias("src"), tag("r", "n_regionkey").alias("dst")).unionByName(
        t.customer.select(tag("c", "c_custkey").alias("src"), tag("n", "c_nationkey").alias("dst"))).unionByName(
        t.region.select(tag("r", "r_regionkey").alias("src"), F.lit("world").alias("dst")))
    starts = e.select("src").unionByName(e.select(F.col("dst").alias("src"))).distinct()
    return G.closure(e, starts)


@query("gr5_effective_methods", f"""WITH {C_SQL}, {METHODS_SQL},
    own AS (SELECT project_id, owner, name FROM m JOIN (SELECT DISTINCT project_id, path FROM c) USING (path)),
    up AS (SELECT project_id, 'C' || j AS name, 'C' || j AS anc FROM k UNION SELECT project_id, 'C' || j, 'Api' || i FROM k UNION SELECT project_id, 'C' || j, 'C' || t FROM k WHERE ext
           UNION SELECT project_id, 'C' || j, 'Api0' FROM k WHERE i = 1)
    SELECT DISTINCT up.project_id, up.name, own.name AS method FROM up JOIN own ON own.project_id = up.project_id AND own.owner = up.anc""")
def _(t):
    f = facts(t, True)
    starts = f.types.filter("kind = 'CLASS'").select("project_id", "name")
    return T.effective_methods(f, starts).select("project_id", "name", "method").distinct()


@query("gr6_ctor_reachable", f"WITH {C_SQL} SELECT path, 'C' || j AS owner, x AS method FROM k, (VALUES ('start'), ('helper')) AS v(x)")
def _(t):
    return U.ctor_reachable(facts(t, True)).select("path", "owner", "method")


@query("gr7_blueprint", f"""WITH {C_SQL}, {EDGES_SQL},
    cb AS (SELECT callee, count(DISTINCT caller) AS n FROM e GROUP BY 1),
    dp AS (SELECT caller, string_agg(DISTINCT callee, ',' ORDER BY callee) AS deps FROM e GROUP BY 1),
    b AS (SELECT *, package || CASE WHEN j % 10 = 0 THEN '.Api' || i ELSE '.C' || j END AS fqn, j % 10 <> 0 AND (s % 7 = 0 OR s % 13 <= 1) AS feat FROM c)
    SELECT path, CASE WHEN j % 10 = 0 THEN 'Interface' WHEN feat THEN 'Messaging Adapter' WHEN s % 4 = 0 THEN 'Service' ELSE 'Class' END AS role,
      CASE WHEN j % 10 = 0 AND i = 1 THEN 'com.acme.p' || P || '.api.Api0' WHEN j % 10 <> 0 AND ext THEN 'com.acme.p' || P || '.core.C' || t END AS extends,
      CASE WHEN j % 10 = 0 THEN '' ELSE 'com.acme.p' || P || '.api.Api' || i END AS implements, coalesce(deps, '') AS depends_on, coalesce(cb.n, 0) AS called_by,
      CASE WHEN j % 10 = 0 THEN NULL WHEN s % 7 = 0 AND s % 13 = 1 THEN 'Migrate: pubsub.publish-single -> producer.send; pubsub.subscription'
           WHEN s % 7 = 0 OR s % 13 = 0 THEN 'Migrate: pubsub.publish-single -> producer.send' WHEN s % 13 = 1 THEN 'Migrate: pubsub.subscription' END AS notes
    FROM b LEFT JOIN cb ON cb.callee = fqn LEFT JOIN dp ON dp.caller = fqn""")
def _(t):
    hits = N.first_hits(code_files(t).select("project_id", "path", "content"), U.FEATURE_RULES)
    feats = hits.withColumn("target", F.when(F.col("feature_id") == "pubsub.publish-single", "producer.send"))
    bp = U.blueprint(facts(t, True), feats)
    return bp.select("path", "role", "extends", F.array_join("implements", ",").alias("implements"), F.array_join("depends_on", ",").alias("depends_on"), "called_by", "notes")


@query("gr7_relevant_files", f"""WITH {C_SQL} SELECT project_id, count(*) FILTER (WHERE j % 10 <> 0 AND (s % 7 = 0 OR s % 13 <= 1)) AS relevant, count(*) AS files FROM c GROUP BY 1""")
def _(t):
    hits = N.first_hits(code_files(t).select("project_id", "path", "content"), U.FEATURE_RULES).withColumn("target", F.lit(None).cast("string"))
    return U.relevant_files(U.blueprint(facts(t, True), hits))


@query("gr2_migration_order", f"""WITH RECURSIVE {C_SQL}, {EDGES_SQL},
    d AS (SELECT project_id || '/' || caller AS node, project_id || '/' || callee AS dep FROM e WHERE caller <> callee
          UNION SELECT project_id || '/' || package || '.C' || j, project_id || '/com.acme.p' || P || '.api.Api' || i FROM k
          UNION SELECT DISTINCT project_id || '/com.acme.p' || P || '.api.Api1', project_id || '/com.acme.p' || P || '.api.Api0' FROM c),
    n AS (SELECT path, project_id || '/' || package || CASE WHEN j % 10 = 0 THEN '.Api' || i ELSE '.C' || j END AS node FROM c),
    r AS (SELECT node, 1 AS pass FROM n WHERE node NOT IN (SELECT node FROM d)
          UNION ALL SELECT d.node, greatest(1, r.pass + CASE WHEN d.dep > d.node THEN 1 ELSE 0 END) FROM r JOIN d ON d.dep = r.node)
    SELECT path, node, max(pass) AS pass FROM r JOIN n USING (node) GROUP BY 1, 2""")
def _(t):
    f = facts(t, True)
    nodes = f.types.select(F.concat_ws("/", "project_id", "fqn").alias("node"), "path")
    ordered = G.dependency_order(nodes.select("node"), U.dependency_edges(f))
    return G.file_order(ordered, nodes).select("path", "rank.node", F.col("rank").getField("col2").alias("pass"))


# ---- profiles ----------------------------------------------------------------------------

@query("ag24_profile_projects", f"""WITH {SUP_SQL}
    SELECT project_id, CASE n % 3 WHEN 0 THEN 'MAVEN' WHEN 1 THEN 'GRADLE_GROOVY' ELSE 'GRADLE_KOTLIN' END AS build_system, 'YAML' AS config_format,
      'SPRING_BOOT' AS framework, n % 3 <> 2 AND n % 4 = 0 AS eligible FROM sup""")
def _(t):
    return U.profile_projects(build_files(t)).select("project_id", "build_system", "config_format", "framework", "eligible")


@query("ag25_detect_stack", f"""WITH {SUP_SQL}
    SELECT project_id, CASE n % 3 WHEN 0 THEN 'Maven' WHEN 1 THEN 'Gradle (Groovy)' ELSE 'unknown' END AS build_system, CASE WHEN n % 3 <> 2 THEN CAST(n + 1 AS VARCHAR) END AS version,
      CASE WHEN n % 3 = 2 THEN 'unknown' ELSE CASE n % 5 WHEN 0 THEN 'Spring Boot' WHEN 1 THEN 'Quarkus' WHEN 2 THEN 'Jakarta EE' ELSE 'unknown' END END AS framework,
      CASE WHEN n % 3 <> 2 THEN CASE n % 5 WHEN 0 THEN 'Embedded (Spring Boot)' WHEN 1 THEN 'Quarkus' END END AS runtime FROM sup""")
def _(t):
    return U.detect_stack(build_files(t)).select("project_id", "build_system", "version", "framework", "runtime")


@query("ag26_integrations", f"WITH {C_SQL} SELECT project_id, 'GCP Pub/Sub' AS integration, path FROM k WHERE s % 7 = 0")
def _(t):
    return U.integrations(facts(t)).select("project_id", "integration", "path")


@query("fn18_role", f"""WITH {C_SQL} SELECT path, CASE WHEN j % 10 = 0 THEN CASE WHEN i = 1 THEN 'Messaging Port' ELSE 'Interface' END WHEN ext THEN 'Messaging Adapter'
    WHEN s % 4 = 0 THEN 'Service' ELSE 'Class' END AS role FROM c""")
def _(t):
    ty = facts(t).types
    return ty.select("path", U.role(F.col("annotations"), F.col("kind"), F.size("extends") > 0).alias("role"))


@query("cd17_semantic_report", f"""WITH {C_SQL}
    SELECT project_id, 'CONTRACT' AS category, count(*) AS n FROM k WHERE s % 5 = 0 GROUP BY 1
    UNION ALL SELECT project_id, 'PUBSUB_LEAK', count(*) FROM k WHERE s % 7 = 0 GROUP BY 1
    UNION ALL SELECT project_id, 'CONSUMER_NOT_CONVERTED', count(*) FROM k WHERE s % 13 <= 1 GROUP BY 1""")
def _(t):
    f = facts(t, True)
    parts = {"CONTRACT": T.unresolved_imports(f), "PUBSUB_LEAK": U.leak_imports(f), "CONSUMER_NOT_CONVERTED": U.unconverted(f)}
    return N.category_counts(N.semantic_report({n: df.withColumn("message", F.col("symbol")) for n, df in parts.items()}))


# ---- the whole report --------------------------------------------------------------------

# The registered checks that make up each category; their SQL gives a row for each finding.
REPORT_CHECKS = {
    "CONTRACT": ["ct1_file_class_mismatch", "ct2_unresolved_imports", "ct3_missing_imports", "ct4_missing_interface_methods", "ct5_signature_mismatches",
                 "ct6_bad_constructor_arity", "ct7_unknown_calls", "ct8_invalid_overrides", "ct9_package_private_uses"],
    "PUBSUB_LEAK": ["cd3_leak_imports", "cd4_leak_types", "cd5_leak_calls"], "FORBIDDEN_IMPORT": ["cd15_forbidden_imports"], "OVERENGINEERING": ["cd10_listener_misuse"],
    "TX_GAP": ["cd12_scope_gap"], "TARGET_DRIFT": ["cd11_target_drift"], "CONSUMER_NOT_CONVERTED": ["cd13_unconverted"],
}
REPORT_SQL = " UNION ALL ".join(
    f"SELECT split_part(path, '/', 1) AS project_id, '{category}' AS category FROM ({ORACLES[name]})" for category, names in REPORT_CHECKS.items() for name in names)
REPORT_SQL = f"""
    report AS ({REPORT_SQL} UNION ALL
        SELECT project_id, 'NO_LISTENERS_FOUND' FROM (WITH {C_SQL} SELECT project_id FROM c GROUP BY 1 HAVING NOT bool_or(j % 10 <> 0 AND s % 13 = 0))),
    sizes AS (WITH {C_SQL} SELECT project_id, count(*) AS files FROM c GROUP BY 1)"""


def _report(t):
    deny = t.spark.sql("SELECT * FROM VALUES (0, 'java.util.List'), (1, 'com.google.cloud.pubsub.*'), (2, 'com.google.*') AS d(ord, key)")
    files = code_files(t)
    return N.full_report(facts(t, True), files, deny), files


@query("cd17_full_report", f"WITH {REPORT_SQL} SELECT project_id, category, count(*) AS n FROM report GROUP BY 1, 2")
def _(t):
    return N.category_counts(_report(t)[0])


@query("cd17_verdict", f"""WITH {REPORT_SQL}, found AS (SELECT project_id, count(*) AS findings FROM report GROUP BY 1)
    SELECT project_id, files, coalesce(findings, 0) AS findings, findings IS NULL AS clean FROM sizes LEFT JOIN found USING (project_id)""")
def _(t):
    return N.report_verdict(*_report(t))
