"""Cross-file contract checks: joins over the code fact tables.

Every check returns (project_id, path, line, symbol, kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.operators.corpus import common_prefix
from codelake.operators.facts import Facts, simple
from codelake.operators.graph import closure

OUT = ["project_id", "path", "line", "symbol", "kind"]

# Fixed list of names that need no import.
JAVA_LANG = [
    "String", "Object", "Integer", "Long", "Double", "Float", "Short", "Byte", "Boolean", "Character", "Number",
    "Math", "System", "Thread", "Runnable", "Void", "Class", "Enum", "Iterable", "Comparable", "CharSequence",
    "StringBuilder", "StringBuffer", "Exception", "RuntimeException", "Throwable", "Error", "Override", "Deprecated",
    "SuppressWarnings", "FunctionalInterface", "SafeVarargs", "Cloneable", "AutoCloseable", "Record", "Process",
    "Appendable", "IllegalStateException", "IllegalArgumentException", "NullPointerException",
    "UnsupportedOperationException", "IndexOutOfBoundsException", "ArrayIndexOutOfBoundsException",
    "StringIndexOutOfBoundsException", "ClassCastException", "NumberFormatException", "ArithmeticException",
    "InterruptedException", "SecurityException", "ClassNotFoundException", "CloneNotSupportedException",
    "IllegalAccessException", "InstantiationException", "NoSuchMethodException", "NoSuchFieldException",
    "NegativeArraySizeException", "ArrayStoreException", "IllegalMonitorStateException", "AssertionError",
    "StackOverflowError", "OutOfMemoryError", "NoClassDefFoundError", "Runtime", "ThreadLocal", "ClassLoader",
    "ProcessBuilder", "StackTraceElement",
]


def _out(df: DataFrame, symbol: Column, kind: str) -> DataFrame:
    return df.select("project_id", "path", "line", symbol.alias("symbol"), F.lit(kind).alias("kind"))


def declared(f: Facts) -> DataFrame:
    """First top-level declaration per (project, simple name), by path."""
    return f.once("declared", lambda: _declared(f))


def _declared(f: Facts) -> DataFrame:
    rank = F.struct("path", "pos")
    return (
        f.types.filter("top_level").groupBy("project_id", "name")
        .agg(F.min_by(F.struct("package", "fqn", "is_public", "path"), rank).alias("d"))
        .select("project_id", "name", "d.package", "d.fqn", "d.is_public", F.col("d.path").alias("decl_path"))
    )


def supertypes(f: Facts, with_implements: bool = True) -> DataFrame:
    """(project_id, sub, super) edges by simple name, of top-level declarations."""
    cols = ["extends", "implements"] if with_implements else ["extends"]
    return (
        f.types.filter("top_level")
        .select("project_id", F.col("name").alias("sub"), F.explode(F.concat(*cols)).alias("super"))
        .distinct()
    )


def ancestors(f: Facts, with_implements: bool = True) -> DataFrame:
    """(project_id, name, ancestor) of all top-level types, none the ancestor of itself."""
    def make():
        edges = supertypes(f, with_implements)
        node = lambda c: F.concat_ws("\u0000", "project_id", c)
        pairs = closure(edges.select(node("sub").alias("src"), node("super").alias("dst")), edges.select(node("sub").alias("src")).distinct())
        part = lambda c, i: F.element_at(F.split(c, "\u0000", -1), i)
        return pairs.filter("src != dst").select(part("src", 1).alias("project_id"), part("src", 2).alias("name"), part("dst", 2).alias("ancestor"))

    return f.once(f"ancestors {with_implements}", make)


def member_methods(f: Facts) -> DataFrame:
    """Methods by (project, owner), with record accessors and generated bean methods."""
    return f.once("members", lambda: _member_methods(f))


def _member_methods(f: Facts) -> DataFrame:
    own = f.methods.select("project_id", "owner", "name", "arity", "param_types", "return_type", F.lit(False).alias("generated"))
    none = F.array().cast("array<string>")
    extra = lambda df, name, arity: df.select("project_id", "owner", name.alias("name"), F.lit(arity).alias("arity"),
                                              none.alias("param_types"), F.lit(None).cast("string").alias("return_type"), F.lit(True).alias("generated"))
    accessors = f.constructors.join(
        f.types.filter("kind = 'RECORD'").select("project_id", "path", F.col("name").alias("owner"), "pos"), ["project_id", "path", "owner", "pos"]
    ).select("project_id", "owner", F.explode("params").alias("p"))
    has = lambda *names: F.arrays_overlap("annotations", F.array(*[F.lit(n) for n in names]))
    bean = f.types.select("project_id", "path", F.col("name").alias("owner"), has("Getter", "Data", "Value").alias("g"),
                          has("Setter", "Data").alias("s"), has("Builder", "SuperBuilder", "Value").alias("b"))
    fields = f.fields.select("project_id", "path", "owner", "var").join(bean.filter("g OR s"), ["project_id", "path", "owner"])
    cap = F.concat(F.upper(F.substring("var", 1, 1)), F.substr("var", F.lit(2)))
    return (
        own.unionByName(extra(accessors, F.col("p.name"), 0))
        .unionByName(extra(bean.filter("b"), F.lit("builder"), 0))
        .unionByName(extra(fields.filter("g"), F.concat(F.lit("get"), cap), 0))
        .unionByName(extra(fields.filter("g"), F.concat(F.lit("is"), cap), 0))
        .unionByName(extra(fields.filter("s"), F.concat(F.lit("set"), cap), 1))
        .distinct()
    )


def all_methods(f: Facts, with_implements: bool = True) -> DataFrame:
    """(project_id, name, method, arity, key, generated): own and inherited methods of all types, some of them repeated.

    ``key`` is the method with its types; ``generated`` marks what no source declares.
    """
    def make():
        key = F.concat("name", F.lit("("), F.array_join("param_types", ","), F.lit("):"), "return_type")
        own = member_methods(f).select("project_id", "owner", F.col("name").alias("method"), "arity", key.alias("key"), "generated")
        inherited = ancestors(f, with_implements).withColumnRenamed("ancestor", "owner").join(own, ["project_id", "owner"])
        cols = ["project_id", "name", "method", "arity", "key", "generated"]
        return own.withColumnRenamed("owner", "name").select(*cols).unionByName(inherited.select(*cols))

    return f.once(f"all methods {with_implements}", make)


def effective_methods(f: Facts, starts: DataFrame, with_implements: bool = True) -> DataFrame:
    """Own and inherited methods of the start types (project_id, name)."""
    return all_methods(f, with_implements).join(starts.select("project_id", "name").distinct(), ["project_id", "name"], "left_semi").distinct()


def file_class_mismatch(f: Facts) -> DataFrame:
    """The first public top-level type must carry the file's name."""
    first = f.types.filter("top_level AND is_public").groupBy("project_id", "path").agg(F.min_by(F.struct("name", "line"), "pos").alias("t"))
    base = F.regexp_replace(F.regexp_extract("path", "[^/\\\\]*$", 0), "\\.[^.]*$", "")
    wrong = first.select("project_id", "path", "t.line", "t.name").filter(F.col("name") != base)
    return _out(wrong, F.col("name"), "FILE_CLASS_MISMATCH")


def unresolved_imports(f: Facts) -> DataFrame:
    """Imports under the project's base package whose simple name no file declares."""
    base = common_prefix(f.types.filter("top_level AND package != ''"), ["project_id"], "package").filter("prefix != ''")
    own = f.imports.filter("NOT is_static AND NOT wildcard").join(base, "project_id").filter(
        F.startswith("name", F.concat("prefix", F.lit("."))) | (F.col("name") == F.col("prefix"))
    ).withColumn("simple", simple(F.col("name")))
    missing = own.join(declared(f).select("project_id", F.col("name").alias("simple")), ["project_id", "simple"], "left_anti")
    return _out(missing, F.col("name"), "UNRESOLVED_INTRA_PROJECT_IMPORT")


def missing_imports(f: Facts) -> DataFrame:
    """Types used but neither imported, local, in the same package nor built in; once per (file, type)."""
    file = ["project_id", "path"]
    wild = f.imports.filter("wildcard").select(*file).distinct()
    refs = (
        f.type_refs.filter((F.length("name") > 1) & ~F.col("name").isin(JAVA_LANG))
        .groupBy(*file, "name").agg(F.min(F.struct("pos", "line", "package")).alias("at"))
        .select(*file, "at.package", "name", "at.line")
    )
    imported = f.imports.filter("NOT is_static AND NOT wildcard").select(*file, simple(F.col("name")).alias("name"))
    known = imported.unionByName(f.types.select(*file, "name")).unionByName(f.type_params.select(*file, "name"))
    left = refs.join(known, [*file, "name"], "left_anti").join(wild, file, "left_anti")
    decl = declared(f).select("project_id", "name", F.col("package").alias("decl_package"))
    return _out(
        left.join(decl, ["project_id", "name"], "left").filter("decl_package IS NULL OR decl_package != package"),
        F.col("name"), "MISSING_IMPORT")


def _implementing(f: Facts) -> DataFrame:
    """Concrete top-level classes with each interface they name."""
    return f.types.filter("top_level AND kind = 'CLASS' AND NOT is_abstract").select(
        "project_id", "path", "line", "name", F.explode("implements").alias("iface"))


def _required(f: Facts, written: bool) -> DataFrame:
    """Each concrete class with the methods of the interfaces it names, all or those that a source declares."""
    need = all_methods(f).filter("NOT generated" if written else "true").withColumnRenamed("name", "iface")
    return _implementing(f).join(need, ["project_id", "iface"])


def missing_interface_methods(f: Facts) -> DataFrame:
    """Interface methods (name, arity) that a concrete class neither has nor inherits by extends."""
    lacking = _required(f, False).select("project_id", "path", "line", "name", "iface", "method", "arity").join(
        all_methods(f, False).select("project_id", "name", "method", "arity"), ["project_id", "name", "method", "arity"], "left_anti").distinct()
    return _out(lacking, F.concat_ws("/", "method", F.col("arity").cast("string")), "MISSING_INTERFACE_METHOD")


def signature_mismatches(f: Facts) -> DataFrame:
    """The class has a method of that name, but none with the interface's exact types."""
    have = all_methods(f, False).filter("NOT generated")
    by_type = ["project_id", "name"]
    wrong = (
        _required(f, True).select("project_id", "path", "line", "name", "iface", "method", "key")
        .join(have.select(*by_type, "key"), [*by_type, "key"], "left_anti")
        .join(have.select(*by_type, "method"), [*by_type, "method"], "left_semi")
        .select("project_id", "path", "line", "name", "iface", "key").distinct()
    )
    return _out(wrong, F.concat_ws(".", "name", "key"), "INTERFACE_SIGNATURE_MISMATCH")


def arity_violations(uses: DataFrame, declared_arities: DataFrame) -> DataFrame:
    """Uses (project_id, type, arity, …) of types that declare arities, none of them this one."""
    d = declared_arities.select("project_id", "type", "arity").distinct()
    return uses.join(d.select("project_id", "type").distinct(), ["project_id", "type"], "left_semi").join(
        d, ["project_id", "type", "arity"], "left_anti")


def bad_constructor_arity(f: Facts) -> DataFrame:
    bad = arity_violations(f.creations, f.constructors.withColumnRenamed("owner", "type"))
    return _out(bad, F.concat_ws("/", "type", F.col("arity").cast("string")), "BAD_CONSTRUCTOR_ARITY")


def local_types(f: Facts) -> DataFrame:
    """Type of every variable name per file; locals shadow parameters, these shadow fields."""
    return f.variables.groupBy("project_id", "path", "var").agg(
        F.max_by("type", F.struct("rank", "pos")).alias("type")
    ).withColumn("type", F.regexp_replace("type", "\\[\\]$", ""))


def unknown_calls(f: Facts) -> DataFrame:
    """Calls on a variable of a project type that has methods, but none of that name."""
    on_var = f.calls.filter(F.col("receiver").rlike("^\\w+$")).withColumnRenamed("receiver", "var").join(
        local_types(f), ["project_id", "path", "var"]).select("project_id", "path", "line", "type", "name")
    names = all_methods(f).select("project_id", F.col("name").alias("type"), F.col("method").alias("name"))
    bad = on_var.join(names, ["project_id", "type", "name"], "left_anti").join(names.select("project_id", "type"), ["project_id", "type"], "left_semi")
    return _out(bad, F.concat_ws(".", "type", "name"), "UNKNOWN_METHOD_CALL")


def invalid_overrides(f: Facts) -> DataFrame:
    """@Override methods that no project supertype declares; external supertypes are skipped."""
    marked = f.methods.filter(F.array_contains("annotations", "Override")).select("project_id", "path", "line", "owner", "name", "arity")
    parents = supertypes(f).join(marked.select("project_id", F.col("owner").alias("sub")).distinct(), ["project_id", "sub"], "left_semi")
    offered = parents.join(all_methods(f).withColumnRenamed("name", "super"), ["project_id", "super"]).select(
        "project_id", F.col("sub").alias("owner"), F.col("method").alias("name"), "arity")
    bad = marked.join(offered, ["project_id", "owner", "name", "arity"], "left_anti").join(offered.select("project_id", "owner"), ["project_id", "owner"], "left_semi")
    return _out(bad, F.concat(F.concat_ws(".", "owner", "name"), F.lit("/"), F.col("arity").cast("string")), "INVALID_OVERRIDE")


def package_private_uses(f: Facts) -> DataFrame:
    """Imports of a project type that is not public, from another package."""
    decl = declared(f).select("project_id", F.col("name").alias("simple"), F.col("package").alias("decl_package"), "is_public")
    hits = f.imports.filter("NOT is_static AND NOT wildcard").withColumn("simple", simple(F.col("name"))).join(decl, ["project_id", "simple"])
    return _out(hits.filter("decl_package != package AND NOT is_public"), F.col("name"), "NON_PUBLIC_TYPE_USED_CROSS_PACKAGE")


CHECKS = [
    file_class_mismatch, unresolved_imports, missing_imports, missing_interface_methods, signature_mismatches,
    bad_constructor_arity, unknown_calls, invalid_overrides, package_private_uses,
]


def contract_violations(f: Facts) -> DataFrame:
    """All nine checks."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [check(f) for check in CHECKS])
