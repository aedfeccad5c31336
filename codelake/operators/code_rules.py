"""Rule scans and detectors over code facts, build files and configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.functions.text import has_marker, notes
from codelake.operators.facts import CALLED, Facts, simple
from codelake.operators.findings import fragment_hits
from codelake.operators.graph import closure
from codelake.operators.joins import prefix_lookup

# Fixed rule lists.
FORBIDDEN_IMPORTS = [
    "com.google.api.services.pubsub", "com.google.cloud.pubsub", "com.google.pubsub", "org.springframework.cloud.gcp.pubsub",
]
FORBIDDEN_TYPES = [
    "Pubsub", "PubsubMessage", "ReceivedMessage", "PublishRequest", "PullRequest", "PullResponse", "PublishResponse",
    "AcknowledgeRequest", "PubSubTemplate", "Subscriber", "Publisher", "TopicAdminClient", "SubscriptionAdminClient",
]
FORBIDDEN_METHODS = ["testIamPermissions", "getOrCreateSubscription"]
FORBIDDEN_CHAINS = [
    ".projects().topics().publish", ".projects().topics().get", ".projects().subscriptions().pull",
    ".projects().subscriptions().acknowledge", ".projects().subscriptions().get",
]
FORBIDDEN_DEPENDENCIES = [
    "google-api-services-pubsub", "google-cloud-pubsub", "spring-cloud-gcp-pubsub", "spring-cloud-gcp-starter-pubsub",
]
FORBIDDEN_KEYS = ["spring.cloud.gcp.pubsub", "gcp.pubsub.", "GOOGLE_APPLICATION_CREDENTIALS", "PUBSUB_EMULATOR_HOST"]
FEATURE_RULES = [
    ("pubsub.publish-single", ["\\.publish\\s*\\(", "projects\\(\\)\\.topics\\(\\)\\.publish"]),
    ("pubsub.pull", ["\\.pull\\s*\\(", "subscriptions\\(\\)\\.pull"]),
    ("pubsub.ack", ["\\.acknowledge\\s*\\(", "subscriptions\\(\\)\\.acknowledge"]),
    ("pubsub.get-or-create-topic", ["getOrCreateTopic", "\\.topics\\(\\)\\.create", "\\.topics\\(\\)\\.get"]),
    ("pubsub.subscription", ["getOrCreateSubscription", "createSubscription", "subscriptions\\(\\)\\.create"]),
    ("pubsub.ordering-key", ["setOrderingKey", "getOrderingKey"]),
    ("pubsub.test-iam", ["testIAMPermissions", "testIamPermissions"]),
]
PUBSUB_MARKERS = [
    "google.cloud.pubsub", "PubSubTemplate", "@PubSubListener", "@SubscriberHandler", "MessagePublisher",
    "com.google.api.services.pubsub", "google.api.services.pubsub", "ReceivedMessage", "PubsubMessage", "PubsubService",
    "PubSubService", "PubsubClient", "PubSubClient", "PubsubConfig", "PubSubConfig", "getOrCreateTopic",
    "getOrCreateSubscription", "google-api-services-pubsub", "google-cloud-pubsub", "spring-cloud-gcp-pubsub",
    "spring-cloud-gcp-starter-pubsub", "spring.cloud.gcp.pubsub", "gcp.pubsub", "GOOGLE_APPLICATION_CREDENTIALS",
    "PUBSUB_EMULATOR_HOST", "Pubsub", "PubSub", "pubsub",
]
MANAGED_CONTAINERS = [
    "KafkaMessageListenerContainer", "ConcurrentMessageListenerContainer", "MessageListenerContainer", "ContainerProperties",
]
REDUNDANT_FACTORIES = [
    "ConsumerFactory", "DefaultKafkaConsumerFactory", "KafkaListenerContainerFactory", "ConcurrentKafkaListenerContainerFactory",
]
SCAFFOLD_TYPES = ["SpringKafkaConfig", "SpringContextBootstrapper", "AppStartupListener", "SpringBeanBridge", "CdiLookup"]
RAW_CLIENTS = ["KafkaProducer", "KafkaConsumer"]
RAW_PROPERTIES = ["producerProperties", "consumerProperties", "adminProperties"]

KEYS = ["project_id", "path"]


def _leak(df: DataFrame, symbol: Column, kind: str) -> DataFrame:
    return df.select(*KEYS, "line", symbol.alias("symbol"), F.lit(kind).alias("kind"))


def under_prefix(col: Column, prefixes: Sequence[str]) -> Column:
    """The first prefix that is the name or a package above it, else null."""
    hit = F.lit(None).cast("string")
    for p in reversed(list(prefixes)):
        hit = F.when((col == p) | col.startswith(p + "."), p).otherwise(hit)
    return hit


def leak_imports(f: Facts) -> DataFrame:
    return _leak(f.imports.filter(under_prefix(F.col("name"), FORBIDDEN_IMPORTS).isNotNull()), F.col("name"), "IMPORT")


def leak_types(f: Facts) -> DataFrame:
    """Forbidden type names, unless the project declares a type of that name."""
    own = f.types.select("project_id", "name").distinct()
    return _leak(f.type_refs.filter(F.col("name").isin(FORBIDDEN_TYPES)).join(own, ["project_id", "name"], "left_anti"), F.col("name"), "TYPE")


def leak_calls(f: Facts) -> DataFrame:
    named = F.col("name").isin(FORBIDDEN_METHODS)
    chained = has_marker(F.col("chain"), FORBIDDEN_CHAINS)
    return _leak(f.calls.filter(named | chained), F.when(named, F.col("name")).otherwise(F.col("chain")), "CALL")


def leak_dependencies(files: DataFrame) -> DataFrame:
    build = files.filter(F.lower("path").rlike("(pom\\.xml|\\.gradle|\\.gradle\\.kts|ivy\\.xml)$"))
    return fragment_hits(build, FORBIDDEN_DEPENDENCIES, "DEPENDENCY").select(*KEYS, "line", "symbol", "kind")


def leak_config(files: DataFrame) -> DataFrame:
    """Forbidden keys, and YAML blocks ``pubsub:`` right under a ``gcp:`` block."""
    config = files.filter(F.lower("path").rlike("(\\.ya?ml|\\.properties)$"))
    keys = fragment_hits(config, FORBIDDEN_KEYS, "CONFIG_KEY").select(*KEYS, "line", "symbol", "kind")
    indent = lambda s: F.length(s) - F.length(F.ltrim(s))
    lines = F.transform(F.split("content", "\n", -1), lambda s, i: F.struct(
        (i + 1).alias("line"), indent(s).alias("indent"), F.ltrim(s).alias("text")))
    solid = F.filter(lines, lambda x: (x["text"] != "") & ~x["text"].startswith("#"))
    blocks = (
        config.filter(F.lower("path").rlike("\\.ya?ml$") & F.col("content").contains("pubsub:"))
        .withColumn("_l", solid)
        .select(*KEYS, "_l", F.inline(F.filter("_l", lambda x: x["text"].startswith("pubsub:"))))
    )
    above = F.filter("_l", lambda x: (x["line"] < F.col("line")) & (x["indent"] < F.col("indent")))
    under_gcp = F.try_element_at(above, F.lit(-1))["text"].startswith("gcp:")
    yaml = blocks.filter(under_gcp).select(*KEYS, "line", F.lit("pubsub:").alias("symbol"), F.lit("CONFIG_KEY").alias("kind"))
    return keys.unionByName(yaml)


def _listeners(f: Facts) -> DataFrame:
    return f.methods.filter(F.array_contains("annotations", "KafkaListener")).select(*KEYS, "owner").distinct()


def listener_misuse(f: Facts) -> DataFrame:
    """Managed container fields and redundant factory beans inside a class with a listener method."""
    own = [*KEYS, "owner"]
    fields = f.variables.filter(F.col("is_field") & F.col("type").isin(MANAGED_CONTAINERS)).join(_listeners(f), own, "left_semi")
    beans = f.methods.filter(F.array_contains("annotations", "Bean") & F.col("return_type").isin(REDUNDANT_FACTORIES)).join(_listeners(f), own, "left_semi")
    return _leak(fields, F.col("type"), "MANUAL_CONTAINER").unionByName(_leak(beans, F.col("return_type"), "REDUNDANT_BEAN"))


def target_drift(f: Facts) -> DataFrame:
    """Raw clients constructed or configured outside the scaffold files."""
    scaffold = f.types.filter(F.col("name").isin(SCAFFOLD_TYPES)).select(*KEYS).distinct()
    raw = f.creations.filter(F.col("type").isin(RAW_CLIENTS)).join(scaffold, KEYS, "left_anti")
    admin = (F.col("name") == "create") & (F.col("receiver") == "AdminClient")
    props = F.col("name").isin(RAW_PROPERTIES)
    used = f.calls.filter(admin | props).join(scaffold, KEYS, "left_anti")
    return _leak(raw, F.concat(F.lit("new "), "type"), "TARGET_DRIFT").unionByName(
        _leak(used, F.when(admin, "AdminClient.create").otherwise(F.concat("name", F.lit("()"))), "TARGET_DRIFT"))


def scope_gap(f: Facts) -> DataFrame:
    """Lookups in listener files whose target is still application scoped, or not a class literal."""
    scoped = (
        f.types.withColumn("scope", F.when(F.array_contains("annotations", "Stateless"), "Stateless")
                           .when(F.array_contains("annotations", "ApplicationScoped"), "ApplicationScoped"))
        .filter("scope IS NOT NULL").groupBy("project_id", F.col("name").alias("target"))
        .agg(F.max_by("scope", F.struct("path", "pos")).alias("scope"))
    )
    lookups = f.calls.filter((F.col("name") == "get") & (F.col("receiver") == "CdiLookup") & (F.col("arity") >= 1)).join(
        _listeners(f).select(*KEYS).distinct(), KEYS, "left_semi")
    arg = F.regexp_extract("args", "^([^,]*)", 1)
    literal = F.regexp_extract(arg, "^([\\w.]+)\\.class$", 1)
    called = lookups.withColumn("arg", arg).withColumn("target", F.when(literal != "", simple(literal)))
    joined = called.join(scoped, ["project_id", "target"], "left")
    return _leak(joined.filter("target IS NULL"), F.regexp_replace("arg", CALLED, "()"), "TX_GAP_UNVERIFIED").unionByName(
        _leak(joined.filter("scope = 'ApplicationScoped'"), F.col("target"), "TX_GAP"))


def unconverted(f: Facts) -> DataFrame:
    """consume(…) left outside a listener, or publish(a, b) inside one.

    A call belongs to the last declaration of its method's name before it, so overloads
    are judged each by its own annotations.
    """
    decl = f.methods.select(*KEYS, "owner", F.col("name").alias("method"), F.col("pos").alias("at"), F.array_contains("annotations", "KafkaListener").alias("listens"))
    found = f.calls.filter(F.col("name").isin("publish", "consume")).join(decl, [*KEYS, "owner", "method"]).filter(F.col("at") <= F.col("pos"))
    call = [*KEYS, "line", "owner", "method", "name", "arity", "pos", "n"]
    inside = found.groupBy(*call).agg(F.max_by("listens", "at").alias("listens"))
    gap = F.col("listens") & (F.col("name") == "publish") & (F.col("arity") == 2)
    left = ~F.col("listens") & (F.col("name") == "consume")
    return _leak(inside.filter(gap | left), F.concat("method", F.lit(" ("), "name", F.lit(")")), "NOT_CONVERTED")


def no_listeners(files: DataFrame) -> DataFrame:
    """One finding without a place for each project of which no file names a listener."""
    some = files.groupBy("project_id").agg(F.coalesce(F.bool_or(F.col("content").contains("@KafkaListener")), F.lit(False)).alias("some"))
    return some.filter("NOT some").select(
        "project_id", F.lit("").alias("path"), F.lit(-1).alias("line"), F.lit("").alias("symbol"), F.lit("NO_LISTENERS_FOUND").alias("kind"))


BINDING_ARG = "(?:[\\w.]+\\s*\\(\\s*)?(?:\\w+\\.)*(\\w+)\\s*\\)?"
BINDING_RX = f"getOrCreateSubscription\\s*\\(\\s*{BINDING_ARG}\\s*,\\s*{BINDING_ARG}\\s*[,)]"


def bindings(f: Facts) -> DataFrame:
    """(project_id, subscription, topic) from two-argument calls; the first one wins."""
    found = f.statements.filter(F.col("flat").contains("getOrCreateSubscription") & ((F.col("mname") == "") | (F.col("level") > 0))).select(
        "project_id", "path", "pos", F.posexplode(F.regexp_extract_all("flat", F.lit(BINDING_RX), 0)).alias("n", "c"))
    return (
        found.select("project_id", "path", "pos", "n", F.regexp_extract("c", BINDING_RX, 1).alias("topic"), F.regexp_extract("c", BINDING_RX, 2).alias("subscription"))
        .groupBy("project_id", "subscription").agg(F.min_by("topic", F.struct("path", "pos", "n")).alias("topic"))
    )


def forbidden_imports(f: Facts, deny: DataFrame) -> DataFrame:
    """Imports that equal a denied name or lie under a denied ``pkg.*``; ``deny`` is (ord, key)."""
    rules = deny.select("ord", "key", F.col("key").alias("dependency"), F.lit(False).alias("hybrid_only"))
    hit = prefix_lookup(f.imports.filter("NOT is_static"), rules, True).filter("dependency IS NOT NULL")
    return hit.select(*KEYS, "line", F.col("name").alias("symbol"), F.col("dependency").alias("rule"))


def glue_classes(f: Facts) -> DataFrame:
    """Files whose first class only wraps the old client: it produces the client as a bean, or
    injects it and offers publish/consume."""
    old = F.lit(False)
    for p in FORBIDDEN_IMPORTS:
        old = old | F.col("name").startswith(p)
    client_imports = f.imports.filter(old)
    named = client_imports.filter("NOT wildcard").select(*KEYS, simple(F.col("name")).alias("type"))
    star = client_imports.filter("wildcard").select(*KEYS, F.explode(F.array(*[F.lit(t) for t in FORBIDDEN_TYPES])).alias("type"))
    client = named.unionByName(star).distinct()
    first = f.types.filter(F.col("kind").isin("CLASS", "INTERFACE")).groupBy(*KEYS).agg(
        F.min_by(F.struct("name", "kind"), "pos").alias("t")).filter("t.kind = 'CLASS'").select(*KEYS, F.col("t.name").alias("owner"))
    mine = [*KEYS, "owner"]
    methods = f.methods.join(first, mine, "left_semi")
    produces = methods.filter(F.array_contains("annotations", "Produces")).withColumnRenamed("return_type", "type").join(
        client, [*KEYS, "type"], "left_semi").select(*KEYS).distinct().withColumn("reason", F.lit("produces the raw client"))
    injected = f.variables.filter(F.col("is_field") & F.array_contains("annotations", "Inject")).join(first, mine, "left_semi").join(
        client, [*KEYS, "type"], "left_semi").select(*KEYS).distinct()
    seam = methods.filter(F.col("name").isin("publish", "consume")).select(*KEYS).distinct()
    wraps = injected.join(seam, KEYS, "left_semi").join(produces, KEYS, "left_anti").withColumn("reason", F.lit("wraps the injected client"))
    return produces.unionByName(wraps)


# ---- project profiles ----------------------------------------------------------------

def profile_projects(files: DataFrame, max_files: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Build system, config format, framework and eligibility per project.

    The whole project is scanned unless a file or character limit is asked for.
    """
    from pyspark.sql import Window

    lower = F.lower("path")
    named = files.groupBy("project_id").agg(
        F.bool_or(lower.endswith("build.gradle.kts")).alias("kts"), F.bool_or(lower.endswith("build.gradle")).alias("gradle"),
        F.bool_or(lower.endswith("pom.xml")).alias("maven"), F.bool_or(lower.rlike("application\\.ya?ml$")).alias("yaml"),
        F.bool_or(lower.endswith("application.properties")).alias("props"))
    code = files.filter(lower.rlike("(build\\.gradle\\.kts|build\\.gradle|pom\\.xml|\\.java|\\.kt)$"))
    if max_files is not None:
        by = Window.partitionBy("project_id").orderBy("path")
        code = code.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= max_files).drop("_n")
    if max_chars is not None:
        code = code.withColumn("content", F.substring("content", 1, max_chars))
    has = lambda *m: F.bool_or(has_marker(F.col("content"), m))
    scanned = code.groupBy("project_id").agg(
        has("org.springframework.boot").alias("boot"), has("org.springframework.").alias("spring"),
        has("jakarta.ejb", "jakarta.ws.rs", "jakarta.inject").alias("jakarta"), has("javax.ejb", "javax.ws.rs", "javax.inject").alias("javax"),
        has("com.google.cloud.pubsub", "google-cloud-pubsub", "spring-cloud-gcp-pubsub", "pubsub").alias("pubsub"))
    build = F.when(F.col("kts"), "GRADLE_KOTLIN").when(F.col("gradle"), "GRADLE_GROOVY").when(F.col("maven"), "MAVEN").otherwise("GRADLE_KOTLIN")
    fmt = F.when(F.col("yaml"), "YAML").when(F.col("props"), "PROPERTIES").otherwise("YAML")
    framework = F.when(F.col("boot"), "SPRING_BOOT").when(F.col("spring"), "SPRING_FRAMEWORK").when(F.col("jakarta"), "JAKARTA_EE").when(
        F.col("javax"), "JAVA_EE").otherwise("SPRING_BOOT")
    eligible = F.coalesce("pubsub", F.lit(False))
    return named.join(scanned, "project_id", "left").select(
        "project_id", build.alias("build_system"), fmt.alias("config_format"), framework.alias("framework"), eligible.alias("eligible"),
        F.concat_ws(",", framework, build, F.when(eligible, "GCP_PUBSUB")).alias("technologies"))


# Fixed patterns and ladders of build files.
MAVEN_VERSION = "<maven\\.compiler\\.(?:source|release)>\\s*(\\d+)\\s*</maven\\.compiler"
GRADLE_VERSION = "(?:sourceCompatibility|JavaLanguageVersion\\.of)\\s*[=(]?\\s*['\"]?(\\d+)"
FRAMEWORKS = [
    ("Spring Boot", ["spring-boot-starter", "org.springframework.boot"]), ("Quarkus", ["quarkus"]),
    ("Jakarta EE", ["jakarta.jakartaee-api", "jakarta.platform"]), ("Java EE", ["javax.javaee-api"]), ("MicroProfile", ["microprofile"]),
]
RUNTIMES = [
    ("Payara Micro", ["payara-micro"]), ("Quarkus", ["quarkus"]), ("WildFly", ["wildfly"]),
    ("Open Liberty", ["openliberty", "liberty-maven"]), ("Embedded (Spring Boot)", ["spring-boot-starter"]),
]


def _ladder(col: Column, steps: Sequence[tuple[str, Sequence[str]]], default: Column) -> Column:
    out = default
    for name, markers in reversed(list(steps)):
        out = F.when(has_marker(col, markers), name).otherwise(out)
    return out


def detect_stack(files: DataFrame) -> DataFrame:
    """Framework, runtime, build system and Java version from each project's build files."""
    p = F.col("path")
    pick = lambda rank: F.min_by("content", F.when(rank.isNotNull(), F.struct(rank, p)))
    pom = F.when(p == "pom.xml", 0).when(p.endswith("/pom.xml"), 1)
    gradle = F.when(p == "build.gradle", 0).when(p == "build.gradle.kts", 1).when(p.endswith("build.gradle"), 2)
    # Only build files reach the aggregate; a project keeps one of each kind.
    picked = files.groupBy("project_id").agg(
        F.bool_or(p.endswith(".gradle.kts")).alias("kts"), pick(pom).alias("pom"), pick(gradle).alias("gradle"))
    build = F.concat(F.coalesce("pom", F.lit("")), F.lit("\n"), F.coalesce("gradle", F.lit("")))
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    system = F.when(full("pom"), "Maven").when(
        full("gradle"), F.when(F.col("gradle").contains("kotlin") | F.col("kts"), "Gradle (Kotlin DSL)").otherwise("Gradle (Groovy)")).otherwise("unknown")
    version = F.coalesce(F.nullif(F.regexp_extract("pom", MAVEN_VERSION, 1), F.lit("")), F.nullif(F.regexp_extract("gradle", GRADLE_VERSION, 1), F.lit("")))
    return picked.withColumn("build", build).select(
        "project_id", F.lit("Java").alias("language"), version.alias("version"), _ladder(F.col("build"), FRAMEWORKS, F.lit("unknown")).alias("framework"),
        system.alias("build_system"), _ladder(F.col("build"), RUNTIMES, F.lit(None).cast("string")).alias("runtime"))


def integrations(f: Facts, prefixes: Sequence[str] = FORBIDDEN_IMPORTS, name: str = "GCP Pub/Sub", kind: str = "messaging") -> DataFrame:
    """Evidence rows (integration, file): files importing under a listed prefix."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("name").startswith(p)
    return f.imports.filter(hit).select("project_id", F.lit(name).alias("integration"), F.lit(kind).alias("kind"), "path").distinct()


# ---- semantic graph and blueprint ------------------------------------------------------

def role(annotations: Column, kind: Column, has_feature: Column) -> Column:
    """Role of a file from its first type's annotations, kind and feature flag."""
    a = lambda n: F.array_contains(annotations, n)
    return (
        F.when(a("Path"), "REST Resource")
        .when(a("Singleton") & a("Startup"), "EJB Lifecycle/Poller")
        .when(a("Produces"), "CDI Producer")
        .when(kind == "INTERFACE", F.when(has_feature, "Messaging Port").otherwise("Interface"))
        .when(has_feature, "Messaging Adapter")
        .when(a("ApplicationScoped") | a("Stateless") | a("Service"), "Service")
        .when(kind == "ENUM", "Enum").when(kind == "RECORD", "Record").otherwise("Class")
    )


def call_edges(f: Facts) -> DataFrame:
    """(project_id, caller, callee, key, project_owned): calls whose receiver's type is known.

    A receiver is this class, a typed variable, or a type name.
    """
    from codelake.operators.contracts import declared, local_types

    fqn = f.types.select("project_id", "path", F.col("name").alias("owner"), F.col("fqn").alias("caller"))
    r = F.col("receiver")
    c = f.calls.filter(r.rlike("^\\w*$")).join(local_types(f).withColumnRenamed("var", "receiver"), ["project_id", "path", "receiver"], "left")
    target = F.when(r.isin("", "this"), F.col("owner")).otherwise(F.coalesce("type", F.when(r.rlike("^[A-Z]"), r)))
    known = declared(f).select("project_id", F.col("name").alias("target"), F.col("fqn").alias("callee_fqn"))
    named = c.withColumn("target", target).filter("target IS NOT NULL").join(known, ["project_id", "target"], "left").join(
        fqn, ["project_id", "path", "owner"])
    callee = F.coalesce("callee_fqn", "target")
    return named.select("project_id", "path", "caller", callee.alias("callee"),
                        F.concat(callee, F.lit("#"), "name", F.lit("/"), F.col("arity").cast("string")).alias("key"),
                        F.col("callee_fqn").isNotNull().alias("project_owned"))


def inheritance_edges(f: Facts) -> DataFrame:
    """(project_id, subtype, supertype, kind) by qualified name where the project declares it."""
    from codelake.operators.contracts import declared

    rows = lambda c, k: f.types.select("project_id", F.col("fqn").alias("subtype"), F.explode(c).alias("name"), F.lit(k).alias("kind"))
    known = declared(f).select("project_id", "name", F.col("fqn").alias("sup"))
    return rows("extends", "EXTENDS").unionByName(rows("implements", "IMPLEMENTS")).join(known, ["project_id", "name"], "left").select(
        "project_id", "subtype", F.coalesce("sup", "name").alias("supertype"), "kind")


def dependency_edges(f: Facts) -> DataFrame:
    """(node, dep) of inheritance and project-owned calls, for the migration order."""
    tag = lambda c: F.concat_ws("/", "project_id", c)
    inh = inheritance_edges(f).select(tag("subtype").alias("node"), tag("supertype").alias("dep"))
    call = call_edges(f).filter("project_owned").select(tag("caller").alias("node"), tag("callee").alias("dep"))
    return inh.unionByName(call).filter("node != dep").distinct()


def ctor_reachable(f: Facts) -> DataFrame:
    """(project_id, path, owner, method): own methods that a constructor reaches by same-class calls."""
    own = f.methods.select(*KEYS, "owner", "name").distinct()
    local = f.calls.filter(F.col("receiver").isin("", "this")).join(own, [*KEYS, "owner", "name"], "left_semi")
    node = lambda c: F.concat_ws("\u0000", *KEYS, "owner", c)
    edges = local.select(node("method").alias("src"), node("name").alias("dst"))
    starts = f.constructors.select(F.concat_ws("\u0000", *KEYS, "owner", "owner").alias("src"))
    reached = closure(edges, starts).filter("src != dst")
    part = lambda i: F.element_at(F.split("dst", "\u0000", -1), i)
    return reached.select(part(1).alias("project_id"), part(2).alias("path"), part(3).alias("owner"), part(4).alias("method")).distinct()


def blueprint(f: Facts, features: DataFrame) -> DataFrame:
    """One row per file: kind, role, supertypes, dependencies, caller count, features, notes.

    A file's own outgoing lists are bounded by its text and stay arrays.  Its callers
    are not, so they are counted here and listed by ``graph.callers``.
    ``features`` is (project_id, path, ord, feature_id, target).
    """
    primary = f.types.groupBy(*KEYS).agg(F.min_by(F.struct("name", "fqn", "kind", "package", "annotations"), "pos").alias("t")).select(*KEYS, "t.*")
    feats = features.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("ord", F.col("feature_id").alias("id"), "target"))).alias("features"))
    inh = inheritance_edges(f)
    sup = inh.groupBy("project_id", F.col("subtype").alias("fqn")).agg(
        F.max(F.when(F.col("kind") == "EXTENDS", F.col("supertype"))).alias("extends"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "IMPLEMENTS", F.col("supertype")))).alias("implements"))
    edges = call_edges(f)
    out = edges.filter("project_owned").groupBy("project_id", F.col("caller").alias("fqn")).agg(F.sort_array(F.collect_set("callee")).alias("depends_on"))
    called = edges.select("project_id", F.col("callee").alias("fqn"), "caller").distinct().groupBy("project_id", "fqn").agg(F.count(F.lit(1)).alias("called_by"))
    joined = primary.join(feats, KEYS, "left")
    for side in (sup, out, called):
        joined = joined.join(side, ["project_id", "fqn"], "left")
    none = F.array().cast("array<string>")
    has_feature = F.coalesce(F.size("features") > 0, F.lit(False))
    return joined.select(
        *KEYS, "name", "kind", "package", role(F.col("annotations"), F.col("kind"), has_feature).alias("role"), "extends",
        F.coalesce("implements", none).alias("implements"), F.coalesce("depends_on", none).alias("depends_on"),
        F.coalesce("called_by", F.lit(0)).alias("called_by"), F.coalesce(F.size("features"), F.lit(0)).alias("n_features"), notes(F.col("features")).alias("notes"))


def relevant_files(bp: DataFrame) -> DataFrame:
    return bp.groupBy("project_id").agg(F.count_if(F.col("n_features") > 0).alias("relevant"), F.count(F.lit(1)).alias("files"))
