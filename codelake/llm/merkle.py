"""Merkle manifest of a table by butterfly exchange: every row gets its leaf, the roots above it and a proof.

Leaves stand in blocks of consecutive places.  A task hashes a block to its top node and
knows the way there.  Then blocks meet in rounds.  In round r a block meets those whose
numbers differ from its own in digit r alone, base ``fanout``: they swap the tops of their
aligned subtrees, and each hashes the ancestors that they share by itself.  The subtrees
grow by ``fanout`` each round, and after the last one every block holds all siblings on
its way to the root, without a pass back down.  Only digests and paths of blocks move.

A subtree at the table's end has fewer blocks than its neighbours; these answer for the
missing ones, in turn, so that no block waits in vain and none answers for all.

The roots of the groups are the leaves of one more tree of the same kind.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import saved, table
from codelake.llm.order import placed
from codelake.llm.registry import query

#: Nodes under one parent; levels that one block holds; levels that one round adds.
ARITY, BLOCK_LEVELS, ROUND_LEVELS = 2, 10, 4
DIGEST = 32


def digest(*values: Column) -> Column:
    """Hex SHA-256 of the values behind one another: each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


# ---------------------------------------------------------------- one subtree


def parents(nodes: list[bytes], arity: int) -> list[bytes]:
    """The next level: each run's hash, over its digests as hex text."""
    return [sha256(b"".join(x.hex().encode() for x in nodes[k : k + arity])).digest() for k in range(0, len(nodes), arity)]


def climb(nodes: list[bytes], arity: int, most: int) -> list[list[bytes]]:
    """The levels from ``nodes`` up: ``most`` more of them."""
    levels = [nodes]
    for _ in range(most):
        levels.append(parents(levels[-1], arity))
    return levels


def way(levels: list[list[bytes]], at: int, arity: int) -> tuple[bytes, bytes]:
    """(the siblings' digests, place and width of each run) on the way from node ``at`` to the last level."""
    siblings, turns = [], bytearray()
    for nodes in levels[:-1]:
        first = at - at % arity
        run = nodes[first : first + arity]
        siblings += run[: at - first] + run[at - first + 1 :]
        turns += bytes((at - first, len(run)))
        at = first // arity
    return b"".join(siblings), bytes(turns)


def fold(leaf: bytes, siblings: bytes, turns: bytes) -> bytes:
    """The root that follows from a leaf and its proof."""
    node, at = leaf, 0
    for k in range(0, len(turns), 2):
        place, width = turns[k], turns[k + 1]
        run = [siblings[at + DIGEST * j : at + DIGEST * (j + 1)] for j in range(width - 1)]
        at += DIGEST * (width - 1)
        node = sha256(b"".join(x.hex().encode() for x in (*run[:place], node, *run[place:]))).digest()
    return node


def height(n: int, arity: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


# ---------------------------------------------------------------- the exchange


def _tops(part: pa.Table, arity: int, levels: int) -> pa.Table:
    """A block's top node; the only block of a group goes up to the root, others by all levels."""
    part = part.sort_by("position")
    size = part.column("size")[0].as_py()
    top = climb(part.column("digest").to_pylist(), arity, min(levels, height(size, arity)))[-1][0]
    return pa.table([part.column("g")[:1], part.column("block")[:1], pa.array([-(-size // arity**levels)], pa.int64()), pa.array([top], pa.binary()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())], names=_PATH)


_PATH = ["g", "block", "blocks", "top", "siblings", "turns"]
_PATH_SCHEMA = "g string, block bigint, blocks bigint, top binary, siblings binary, turns binary"


def _swapped(part: pa.Table, arity: int, levels: int, width: int) -> pa.Table:
    """Tops of neighbouring subtrees in, what stands ``levels`` higher out, for those that stand here for themselves."""
    part = part.sort_by("digit")
    tops = part.column("top").to_pylist()
    nodes = -(-part.column("blocks")[0].as_py() // width)  # subtrees in the whole group
    up = climb(tops, arity, min(levels, height(nodes, arity)))
    own = part.filter(part.column("own"))
    ways = [way(up, d, arity) for d in own.column("digit").to_pylist()]
    siblings = [a + b for a, (b, _) in zip(own.column("siblings").to_pylist(), ways, strict=True)]
    turns = [a + b for a, (_, b) in zip(own.column("turns").to_pylist(), ways, strict=True)]
    columns = [own.column("g"), own.column("block"), own.column("blocks"), pa.array([up[-1][0]] * len(own), pa.binary()), pa.array(siblings, pa.binary()), pa.array(turns, pa.binary())]
    return pa.table(columns, names=_PATH)


def _swap(arity: int, levels: int, width: int):
    return lambda part: _swapped(part, arity, levels, width)


def exchanged(paths: DataFrame, arity: int, levels: int) -> DataFrame:
    """Every block's root and path, from every block's top: rounds of swaps inside aligned groups of arity**levels subtrees."""
    fanout, width, done = arity**levels, 1, []
    most = paths.agg(F.max("blocks").alias("n")).collect()[0]["n"] or 0
    while width < most:
        ended, active = paths.filter(F.col("blocks") <= width), paths.filter(F.col("blocks") > width)
        done.append(ended)
        w = F.lit(width)
        tree = F.floor(F.col("block") / w).cast("bigint")
        low, digit = F.col("block") % w, tree % fanout
        here = F.least(w.cast("bigint"), F.col("blocks") - tree * w)  # blocks of the subtree
        # a short subtree has subtrees only before it; its blocks also answer those that ask for a missing one
        asked = F.when(digit == 0, F.array(low)).otherwise(F.sequence(low, F.lit(width - 1).cast("bigint"), here))
        sent = active.select("*", digit.alias("digit"), F.floor(F.col("block") / (w * fanout)).cast("bigint").alias("meeting"), low.alias("_low"), F.explode(asked).alias("lane"))
        own = F.col("_low") == F.col("lane")
        none = F.lit(None).cast("binary")
        sent = sent.select("g", "meeting", "lane", "digit", own.alias("own"), "block", "blocks", "top", F.when(own, F.col("siblings")).otherwise(none).alias("siblings"), F.when(own, F.col("turns")).otherwise(none).alias("turns"))
        paths = saved(sent.groupBy("g", "meeting", "lane").applyInArrow(_swap(arity, levels, width), _PATH_SCHEMA))
        width *= fanout
    for part in done:
        paths = paths.unionByName(part)
    return paths


def proved(nodes: DataFrame, arity: int = ARITY, block_levels: int = BLOCK_LEVELS, round_levels: int = ROUND_LEVELS) -> DataFrame:
    """``nodes`` (g, position, size, digest and more) with root, siblings and turns."""
    block = F.floor(F.col("position") / F.lit(arity**block_levels)).cast("bigint")
    nodes = nodes.withColumn("block", block)
    tops = saved(nodes.select("g", "block", "position", "size", "digest").groupBy("g", "block").applyInArrow(lambda t: _tops(t, arity, block_levels), _PATH_SCHEMA))
    paths = exchanged(tops, arity, round_levels)
    keep = [f for f in nodes.schema.fields if f.name not in ("g", "block")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)

    def below(rows: pa.Table, path: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        levels = climb(rows.column("digest").to_pylist(), arity, min(block_levels, height(rows.column("size")[0].as_py(), arity)))
        ways = [way(levels, k, arity) for k in range(len(rows))]
        above, turned, root = (path.column(c)[0].as_py() for c in ("siblings", "turns", "top"))
        columns = [pa.array([root] * len(rows), pa.binary()), pa.array([a + above for a, _ in ways], pa.binary()), pa.array([b + turned for _, b in ways], pa.binary())]
        return pa.table([*rows.select(["g", *[f.name for f in keep]]).columns, *columns], names=["g", *[f.name for f in keep], "root", "siblings", "turns"])

    return nodes.groupBy("g", "block").cogroup(paths.groupBy("g", "block")).applyInArrow(below, f"g string, {schema}, root binary, siblings binary, turns binary")


# ---------------------------------------------------------------- manifest and check


def manifest(df: DataFrame, doc_id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             changed: dict[str, Column] | None = None, arity: int = ARITY, block_levels: int = BLOCK_LEVELS, round_levels: int = ROUND_LEVELS) -> DataFrame:
    """(doc_id, group, leaf, presented, subroot, root, siblings, turns), one row for each row of ``df``.

    A leaf is the digest of the row's ``fields``.  Within a group leaves ascend by id; rows with
    the same id follow by digest, null ids come first.  Every ``arity`` consecutive nodes (the
    last run may be shorter, even one) become one by hashing, until one is left, the subroot.
    Subroots ascend by group, null first, and become the root in the same way.  ``siblings`` are
    the 32-byte digests that lead from leaf to root, ``turns`` the node's place and its run's
    width, a byte each, for every level.  ``presented`` is the digest of the row as somebody
    else shows it, with the columns of ``changed`` in place of its own.

    Null fields have a digest of their own, empty texts too; texts of any length are hashed
    whole in the JVM.  Repeated rows are leaves of their own.  An empty table gives an empty
    one.  Other columns of ``df`` are left out, so none clashes.
    """
    if not 2 <= arity <= 255:
        raise ValueError("a run's width has one byte: arity is 2 to 255")
    changed = changed or {}
    own = digest(*[F.col(f"`{c}`") for c in fields])
    shown = digest(*[changed.get(c, F.col(f"`{c}`")) for c in fields])
    raw = lambda c: F.unhex(c)
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = saved(df.select(F.col(f"`{doc_id}`").alias("id"), key.alias("g"), raw(own).alias("digest"), raw(shown).alias("presented")))
    inner = saved(proved(placed(leaves, "g", [F.col("id").asc_nulls_first(), "digest"]), arity, block_levels, round_levels))

    one = inner.filter("position = 0").select(F.lit("").alias("g"), F.col("g").alias("member"), F.col("root").alias("digest"))
    outer = proved(placed(one, "g", ["member"]), arity, block_levels, round_levels)
    outer = saved(outer.select(F.col("member").alias("g"), F.col("root").alias("whole"), F.col("siblings").alias("more_siblings"), F.col("turns").alias("more_turns")))
    out = inner.join(outer, "g")
    hex_ = lambda c: F.lower(F.hex(c))
    return out.select(
        F.col("id").alias(doc_id), F.expr("CASE WHEN g != '' THEN substr(g, 2) END").cast(df.schema[group].dataType).alias(group), hex_("digest").alias("leaf"), hex_("presented").alias("presented"),
        hex_("root").alias("subroot"), hex_("whole").alias("root"), F.concat("siblings", "more_siblings").alias("siblings"), F.concat("turns", "more_turns").alias("turns"))


def folded(proofs: DataFrame, leaf: str = "presented", into: str = "folded_root") -> DataFrame:
    """All rows with the root that each leaf leads to with its proof; equal to ``root`` if nothing was changed."""
    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (leaf, "siblings", "turns"))
            roots = [None if None in row else fold(bytes.fromhex(row[0]), *row[1:]).hex() for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema.fields if f.name != into)
    return proofs.drop(into).mapInArrow(run, f"{schema}, `{into}` string")


@query("op12_merkle_manifest")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    # one more than the largest bigint has a decimal too
    raised = F.when(hit, (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    proofs = manifest(table(spark, sf_dir, "documents"), changed={"n_chars": raised})
    done = folded(proofs)
    return done.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
