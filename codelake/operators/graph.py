"""Graph operators over node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.text import simple_name
from codelake.session import checkpoint


def callers(calls: DataFrame) -> DataFrame:
    """Distinct (callee, simple name of a caller)."""
    return calls.select("callee", simple_name(F.col("caller")).alias("caller")).distinct()


def callees(calls: DataFrame) -> DataFrame:
    """Distinct (caller, project-owned callee owner)."""
    return calls.filter("project_owned").select("caller", "callee").distinct()


def importers(imports: DataFrame) -> DataFrame:
    return imports.select("target", "importer").distinct()


def methods_of(methods: DataFrame, types: DataFrame) -> DataFrame:
    """(fqn, method, arity) of every type: its own methods, inherited ones not among them."""
    own = types.select("project_id", "path", F.col("name").alias("owner"), "fqn")
    return methods.join(own, ["project_id", "path", "owner"]).select("project_id", "fqn", F.col("name").alias("method"), "arity").distinct()


def classes_by_file(types: DataFrame) -> DataFrame:
    """(project_id, path, fqn, position): the types of each file in their order."""
    return types.select("project_id", "path", "fqn", F.row_number().over(Window.partitionBy("project_id", "path").orderBy("pos", "fqn")).alias("position"))


def degree(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Distinct neighbours per node; duplicates are removed before counting, so no set is built."""
    return edges.select(node, other).distinct().groupBy(node).agg(F.count(F.lit(1)).alias("n"))


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """All (src, dst) pairs reachable over ``edges`` (src, dst) from ``starts`` (src), each start reaching itself.

    Lengths double: after round k all walks of fewer than 2**k steps are known, and a table
    of jumps of 2**k steps extends them.  Each round appends only its new pairs as a part of
    its own; a round without any ends it, on cycles too.  A chain of n nodes takes log2(n)
    rounds.  The jumps start at every node, so this is for graphs whose own closure is no
    problem, such as inheritance or calls inside a class.
    """
    jumps = checkpoint(edges.select("src", "dst").filter("src != dst").distinct())
    parts = [checkpoint(starts.select("src", F.col("src").alias("dst")).distinct())]
    while True:
        found = _union(parts)
        step = jumps.select(F.col("src").alias("dst"), F.col("dst").alias("nxt"))
        further = found.join(step, "dst").select("src", F.col("nxt").alias("dst")).distinct()
        fresh = checkpoint(further.join(found, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return found
        parts.append(fresh)
        jumps = checkpoint(jumps.join(jumps.select(F.col("src").alias("dst"), F.col("dst").alias("nxt")), "dst").select("src", F.col("nxt").alias("dst")).distinct())


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dependency_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, pass, cyclic): dependencies first, then by (pass, node).

    A node is emitted in the first alphabetical sweep in which all it depends on are out: a
    dependency that sorts after it costs one more sweep.  Nodes on or behind a cycle stay
    and are appended with ``cyclic``.  ``edges`` is (node, dep); self and foreign edges are
    ignored.

    Each round settles the nodes that wait for nothing and then shortens what is left: an
    edge to a node that waits for one other only goes on to that other, with the sweeps in
    between as its weight.  Chains and trees so halve their depth, and no edge is added.
    When no node is ready, every node left can follow its edges for ever: a cycle.
    """
    own = nodes.select("node").distinct()
    live = (
        edges.select("node", "dep").filter("node != dep").distinct()
        .join(own, "node", "left_semi")
        .join(own.select(F.col("node").alias("dep")), "dep", "left_semi")
    )
    live = checkpoint(live.select("node", "dep", F.when(F.col("dep") > F.col("node"), 1).otherwise(0).cast("bigint").alias("w")))
    # the least pass of each node as far as its settled dependencies tell
    least = checkpoint(own.select("node", F.lit(1).cast("bigint").alias("p")))
    # behind a cycle sums double for ever, and mean nothing
    bounded = lambda c: F.least(c, F.lit(1 << 40))
    parts = []
    while True:
        waits = live.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("next"), F.max("w").alias("w"))
        state = checkpoint(least.join(waits, "node", "left"))
        ready = state.filter("n IS NULL").select("node", F.col("p").cast("int").alias("pass"))
        if ready.isEmpty():
            break
        parts.append(ready)
        # what a node's dependency is: settled, waiting for one other that isn't settled, or neither
        single = state.filter("n = 1").select("node", "next", F.col("w").alias("next_w")).join(ready.select(F.col("node").alias("next")), "next", "left_anti")
        about = state.select(F.col("node"), F.col("p").alias("dep_p"), F.col("n").isNull().alias("settled")).join(single, "node", "left").withColumnRenamed("node", "dep")
        seen = live.join(about, "dep")
        told = seen.filter("settled OR next IS NOT NULL").groupBy("node").agg(F.max(bounded(F.col("dep_p") + F.col("w"))).alias("told"))
        moved = seen.filter("NOT settled").select(
            "node", F.coalesce("next", "dep").alias("dep"), bounded(F.col("w") + F.when(F.col("next").isNotNull(), F.col("next_w")).otherwise(0)).alias("w"))
        least = state.filter("n IS NOT NULL").select("node", "p").join(told, "node", "left").select("node", F.greatest("p", F.coalesce("told", F.lit(1))).alias("p"))
        # a node that has found itself behind its own dependency keeps that edge and is never ready
        live = checkpoint(moved.groupBy("node", "dep").agg(F.max("w").alias("w")))
        if len(parts) == 32:  # keep the final union short on graphs that stay deep
            parts = [checkpoint(_union(parts))]
    settled = _union(parts) if parts else state.select("node", F.col("p").cast("int").alias("pass")).limit(0)
    rest = state.filter("n IS NOT NULL")
    return (
        settled.withColumn("cyclic", F.lit(False))
        .unionByName(rest.select("node", F.lit(None).cast("int").alias("pass"), F.lit(True).alias("cyclic")))
    )


def file_order(ordered: DataFrame, files: DataFrame) -> DataFrame:
    """Files at the first position of one of their classes."""
    rank = F.struct(F.col("cyclic"), F.coalesce("pass", F.lit(0)), F.col("node"))
    return ordered.join(files, "node").groupBy("path").agg(F.min(rank).alias("rank")).orderBy("rank")


def cyclic_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no order holds: those on a cycle and those that depend on one."""
    return dependency_order(nodes, edges).filter("cyclic").select("node")


def has_cycle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the flag; a remainder exists only if there is a real cycle."""
    return cyclic_nodes(nodes, edges).agg((F.count(F.lit(1)) > 0).alias("has_cycle"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of the component as its label.

    Rounds of neighbour minimum and pointer jumping, so long chains need few rounds.
    """
    both = edges.select("src", "dst").filter("src != dst")
    both = checkpoint(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = checkpoint(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select(
        "node", F.least("node", "m").alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst")
        near = seen.groupBy(F.col("src").alias("node")).agg(F.min("c").alias("c"))
        hooked = labels.join(near, "node").select("node", "component", F.least("component", "c").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        moved = checkpoint(hooked.join(jump, "new", "left").select(
            "node", F.least("new", F.coalesce("far", F.col("new"))).alias("component"), F.col("component").alias("old")))
        labels = moved.select("node", "component")
        if moved.filter("component != old").isEmpty():
            return labels


def clusters(edges: DataFrame, files: DataFrame, max_files: int = 6) -> DataFrame:
    """(component, files, n) of coupled types spread over 2..max_files files.

    Sizes are counted before any list is built, so an oversized component is never
    collected.
    """
    placed = components(edges).join(files, "node").select("component", "path").distinct()
    sized = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, max_files))
    return placed.join(sized, "component").groupBy("component", "n").agg(F.sort_array(F.collect_list("path")).alias("files"))
