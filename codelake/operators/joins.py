"""Lookups and reconciliations between file, catalogue and import tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.functions.text import has_marker, is_migratable


def change_tree(source: DataFrame, changed: DataFrame) -> DataFrame:
    """Status of every source path, plus created paths that the source lacks.

    ``changed`` is (original_path, new_path, change_type, ord); the first row per key wins.
    """
    key = F.when(F.trim(F.coalesce("original_path", F.lit(""))) != "", F.col("original_path")).otherwise(F.col("new_path"))
    status = changed.groupBy(key.alias("path")).agg(F.min_by("change_type", "ord").alias("change_type"))
    created = (
        changed.filter(F.upper("change_type") == "CREATED")
        .select(F.coalesce("new_path", "original_path").alias("path"))
        .distinct()
        .join(source.select("path"), "path", "left_anti")
        .select("path", F.lit("CREATED").alias("status"))
    )
    tree = source.select("path").distinct().join(status, "path", "left").select(
        "path", F.coalesce("change_type", F.lit("UNTOUCHED")).alias("status")
    )
    return tree.unionByName(created).orderBy("path")


def enrich_features(features: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add target and description of a feature id; unknown ids get a default text."""
    return features.join(catalogue, "feature_id", "left").withColumn(
        "description", F.coalesce("description", F.concat(F.lit("Detected "), F.col("feature_id")))
    )


def prefix_lookup(names: DataFrame, rules: DataFrame, hybrid: bool, col: str = "name") -> DataFrame:
    """First rule in list order whose key is the name, or ``pkg.*`` above it.

    ``rules`` is (ord, key, dependency, hybrid_only).  Instead of comparing every name
    with every rule, a name is expanded into its few dotted prefixes and equi-joined.
    """
    usable = rules if hybrid else rules.filter(~F.col("hybrid_only"))
    keyed = usable.withColumn("_exact", ~F.col("key").endswith(".*")).withColumn(
        "_key", F.regexp_replace("key", "\\.\\*$", "")
    )
    parts = F.split(F.col(col), "\\.", -1)
    probes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), ".").alias("_key"), (n == F.size(parts)).alias("_exact")),
    )
    hits = (
        names.select(col).distinct()
        .select(col, F.inline(probes))
        .join(keyed, ["_key", "_exact"])
        .groupBy(col)
        .agg(F.min_by("dependency", "ord").alias("dependency"))
    )
    return names.join(hits, col, "left")


def missing_dependencies(imports: DataFrame, rules: DataFrame, declared: DataFrame, hybrid: bool = False) -> DataFrame:
    """Dependencies that imports need and the build lacks, with the first place that needs them.

    ``imports`` is (project_id, path, name); ``declared`` is (project_id, dependency).
    """
    needed = prefix_lookup(imports, rules, hybrid).filter(F.col("dependency").isNotNull())
    first = needed.groupBy("project_id", "dependency").agg(F.min(F.struct("path", "name")).alias("_w"))
    return first.join(declared, ["project_id", "dependency"], "left_anti").select(
        "project_id", "dependency", "_w.path", "_w.name"
    )


def unresolved_imports(imports: DataFrame, types: DataFrame, base: Column) -> DataFrame:
    """Imports under the base package whose simple name no file of the project declares.

    ``imports`` is (project_id, path, name, is_static, wildcard); ``types`` is (project_id, name).
    """
    own = imports.filter(
        ~F.col("is_static") & ~F.col("wildcard")
        & (F.startswith("name", F.concat(base, F.lit("."))) | (F.col("name") == base))
    ).withColumn("simple", F.substring_index("name", ".", -1))
    declared = types.select("project_id", F.col("name").alias("simple")).distinct()
    return own.join(declared, ["project_id", "simple"], "left_anti")


def select_context(files: DataFrame, plan: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Planned files plus statically relevant ones; a project without a plan keeps all."""
    planned = plan.select("project_id", "path").distinct().withColumn("_named", F.lit(True))
    with_plan = plan.select("project_id").distinct().withColumn("_plan", F.lit(True))
    relevant = is_migratable(F.col("path")) & has_marker(F.col("content"), markers)
    return (
        files.join(with_plan, "project_id", "left")
        .join(planned, ["project_id", "path"], "left")
        .filter(F.col("_plan").isNull() | F.col("_named").isNotNull() | relevant)
        .drop("_plan", "_named")
    )


def cache_key(prompt: str, path: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.lit(prompt + "|"), path, F.lit("|"), content), 256)


def cache_split(files: DataFrame, cache: DataFrame, prompt: str) -> DataFrame:
    """Files with their cache key; ``hit`` rows carry the cached result, the rest is work."""
    keyed = files.withColumn("cache_key", cache_key(prompt, F.col("path"), F.col("content")))
    return keyed.join(cache, "cache_key", "left").withColumn("hit", F.col("result").isNotNull())


def normalise_path(col: Column) -> Column:
    """Forward slashes, nothing up to ``/workspace/``, no leading slash."""
    path = F.replace(col, F.lit("\\"), F.lit("/"))
    at = F.instr(path, "/workspace/")
    path = F.when(at > 0, F.substr(path, at + len("/workspace/"), F.length(path))).otherwise(path)
    return F.regexp_replace(path, "^/+", "")


def _suffixes(col: str) -> Column:
    parts = F.split(F.col(col), "/", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"),
    )


def match_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of equal paths, or where one ends with ``/`` and the other.

    Each side is expanded into its path suffixes and equi-joined with the other
    side's whole paths, so a frequent base name yields no false candidates.
    """
    left = a.select(normalise_path(F.col("path")).alias("a_path")).filter("a_path != ''").distinct()
    right = b.select(normalise_path(F.col("path")).alias("b_path")).filter("b_path != ''").distinct()
    down = left.select("a_path", F.explode(_suffixes("a_path")).alias("b_path")).join(right, "b_path")
    up = right.select("b_path", F.explode(_suffixes("b_path")).alias("a_path")).filter("a_path != b_path").join(left, "a_path")
    return down.select("a_path", "b_path").unionByName(up.select("a_path", "b_path"))


def name_diff(cand: DataFrame, ref: DataFrame) -> DataFrame:
    """Base names only in one of the two path sets, with the side."""
    base = F.regexp_extract("path", "[^/\\\\]*$", 0).alias("name")
    c, r = cand.select(base), ref.select(base)
    return (
        c.subtract(r).withColumn("side", F.lit("extra"))
        .unionByName(r.subtract(c).withColumn("side", F.lit("missing")))
    )


def deny_list(global_list: DataFrame, per_mapping: DataFrame) -> DataFrame:
    """Ordered distinct union of two (ord, name) lists, the global one first."""
    both = global_list.select(F.lit(0).alias("src"), "ord", "name").unionByName(
        per_mapping.select(F.lit(1).alias("src"), "ord", "name")
    )
    return both.groupBy("name").agg(F.min(F.struct("src", "ord")).alias("_p")).orderBy("_p").select("name", "_p.src", "_p.ord")


def type_index(fqns: DataFrame) -> DataFrame:
    """Simple name to its first qualified name by ``pos``; wildcards and malformed names dropped."""
    dot = F.length("fqn") - F.length(F.substring_index("fqn", ".", -1))
    good = (F.trim("fqn") != "") & ~F.endswith(F.col("fqn"), F.lit(".*")) & (dot > 1) & (dot < F.length("fqn"))
    return (
        fqns.filter(good)
        .groupBy(F.substring_index("fqn", ".", -1).alias("simple"))
        .agg(F.min_by("fqn", F.struct("pos", "fqn")).alias("fqn"))
    )


def merge_lists(a: Column, b: Column) -> Column:
    """First list first, distinct."""
    return F.array_distinct(F.concat(a, b))


def dependency_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, dependency) sets to added and removed rows; projects missing on a side give nothing."""
    both = old.select("project_id").distinct().join(new.select("project_id").distinct(), "project_id", "left_semi")
    key = ["project_id", "dependency"]
    o = old.select(key).distinct().join(both, "project_id", "left_semi")
    n = new.select(key).distinct().join(both, "project_id", "left_semi")
    added = n.join(o, key, "left_anti").withColumn("change", F.lit("added"))
    removed = o.join(n, key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed).orderBy("project_id", "change", "dependency")


def change_counts(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """Files per change type as columns; types without files count 0."""
    kinds = ["MODIFIED", "CREATED", "DELETED", "UNCHANGED"]
    return files.groupBy(*by).pivot("change_type", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)
