"""Near duplicates by an LSH forest over MinHash signatures.

Each tree is a sorted order of all distinct sets by its own few minima.  Sets whose minima
begin alike stand together there: a region.  In a small region all are candidates of each
other.  A crowded one is taken apart at the next minimum, and the next, where it is crowded
and only there; besides, each set keeps its nearest neighbours of the order as candidates,
with which it shares the longest prefixes.  What agrees in every minimum stays together
whatever its number.  Candidates whose sketches of 64 bytes differ too much are none.

Candidates connect clusters.  In a cluster links are confirmed on full sets.  A cluster too
large for one task is first compared with some of its own members; whatever then isn't in
its largest group is compared with all of it, in slices.  So nothing is lost there, and
the work grows with what the members didn't connect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import extended, mix, output, saved, slices, table, unclashed
from codelake.llm.linking import components, labels
from codelake.llm.ngram_join import _sets_of, set_id, shingle_sets
from codelake.llm.order import attached, placed
from codelake.llm.registry import query

WORDS, PERCENT = 5, 85
#: Trees, minima that a region shares at least, and at most.
TREES, SHALLOW, DEEP = 16, 3, 6
#: Bytes of a sketch, each from one minimum.
SKETCH = 64
#: Sets in a region whose pairs are all candidates; neighbours on either side in a larger one.
REGION, NEAREST = 256, 16
#: Places of an order that one task compares, and the next ones that it sees too.
BLOCK = 8192
#: Shingles on either side of one comparison of sets.
SHINGLES = 1_000_000


def agreement(percent: int) -> int:
    """Bytes of two sketches that agree at least if the sets are similar: five deviations below the mean."""
    p = percent / 100
    return int(SKETCH * p - 5 * (SKETCH * p * (1 - p)) ** 0.5)


_SEED = mix(np.arange(1, 2 * TREES * DEEP + 1, dtype=np.uint64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of TREES * DEEP minima, 32 bits each, for every set; none is empty."""
    if not sets:
        return np.zeros((0, TREES * DEEP), np.uint32)
    flat = np.concatenate(sets)
    first = np.append(0, np.cumsum([len(s) for s in sets])[:-1])
    out = np.empty((len(sets), TREES * DEEP), np.uint32)
    for k in range(TREES * DEEP):
        h = (flat ^ _SEED[2 * k]) * (_SEED[2 * k + 1] | np.uint64(1))
        h ^= h >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(h * np.uint64(0x9E3779B97F4A7C15), first) >> np.uint64(16)
    return out


def signed(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` (row, text) with k1 (the set's name; null without words), n_shingles, and the signature where a task sees the set first."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), words)
                names = [set_id(s) if len(s) else None for s in sets]
                new = []
                for k, name in enumerate(names):
                    if name is not None and name not in seen:
                        seen.add(name)
                        new.append(k)
                made = signatures([sets[k] for k in new])
                signature = [None] * len(sets)
                for k, row in zip(new, made, strict=True):
                    signature[k] = row.tobytes()
                yield output(part, ["row"], k1=pa.array(names, pa.int64()), n_shingles=pa.array([len(s) for s in sets], pa.int64()), signature=pa.array(signature, pa.binary()))

    return docs.select("row", "text").mapInArrow(run, extended(docs.select("row"), "k1 bigint, n_shingles bigint, signature binary"))


# ---------------------------------------------------------------- the forest


def _planted(sets: DataFrame) -> DataFrame:
    """(tree, minima, k1, sketch): each set once in every tree; minima sort as bytes."""
    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.slice(k, 1024)
                rows = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(len(part), TREES * DEEP)
                sketch = pa.array([r.tobytes() for r in rows[:, :SKETCH].astype(np.uint8)], pa.binary())
                for t in range(TREES):
                    own = rows[:, t * DEEP : (t + 1) * DEEP].astype(">u4")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), t, np.int32)), pa.array([r.tobytes() for r in own], pa.binary()), part.column("k1"), sketch], names=["tree", "minima", "k1", "sketch"])

    return sets.select("k1", "signature").mapInArrow(run, "tree int, minima binary, k1 bigint, sketch binary")


def _all_pairs(a: int, b: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places a..b-1 in pairs that are at least ``least`` apart."""
    x, y = np.triu_indices(b - a, least)
    return x + a, y + a


def candidates(minima: np.ndarray, sketches: np.ndarray, need: int, shallow: int = SHALLOW, region: int = REGION, nearest: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
    """Places of candidate pairs in a sorted stretch of one tree."""
    n, deep = minima.shape
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix = np.cumprod(minima[1:] == minima[:-1], axis=1).sum(axis=1)  # shared with the set before
    found = []

    def keep(x, y):
        for k in range(0, len(x), 1 << 16):
            i, j = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            good = np.count_nonzero(sketches[i] == sketches[j], axis=1) >= need
            found.append((i[good], j[good]))

    near = np.append(prefix >= shallow, False)
    together = near.copy()  # place k and k + step are in one region
    for step in range(1, nearest + 1):
        at = np.flatnonzero(together)
        if not len(at):
            break
        keep(at, at + step)
        together[: n - step] &= near[step:]
        together[n - step :] = False
    bounds = np.flatnonzero(np.append(True, prefix < shallow))
    ends = np.append(bounds[1:], n)
    wide = ends - bounds > nearest + 1
    stack = [(a, b, shallow) for a, b in zip(bounds[wide].tolist(), ends[wide].tolist(), strict=True)]
    while stack:
        a, b, depth = stack.pop()
        if b - a <= nearest + 1:
            continue
        if b - a <= region:
            keep(*_all_pairs(a, b, nearest + 1))
        elif depth == deep:
            found.append((np.arange(a, b - 1), np.arange(a + 1, b)))
        else:
            inner = np.append(a, np.flatnonzero(prefix[a : b - 1] <= depth) + a + 1)
            stack += [(x, y, depth + 1) for x, y in zip(inner.tolist(), [*inner[1:].tolist(), b], strict=True)]
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def _block_links(part: pa.Table, need: int, sizes: dict) -> pa.Table:
    part = part.sort_by("position")
    minima = np.frombuffer(b"".join(part.column("minima").to_pylist()), ">u4").reshape(len(part), DEEP)
    sketches = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(len(part), SKETCH)
    names = part.column("k1").to_numpy()
    p = labels(len(names), *candidates(minima, sketches, need, **sizes))
    moved = np.flatnonzero(p != np.arange(len(p)))
    return pa.table({"src": names[moved], "dst": names[p[moved]]})


def candidate_links(sets: DataFrame, percent: int = PERCENT, block: int = BLOCK, region: int = REGION, nearest: int = NEAREST) -> DataFrame:
    """(src, dst) that connect all candidates of all trees.  ``sets``: (k1, signature)."""
    need, sizes = agreement(percent), {"region": region, "nearest": nearest}
    rows = placed(_planted(sets), "tree", ["minima", "k1"])
    here = F.floor(F.col("position") / F.lit(block)).cast("bigint")
    # the first places of a block are seen from the one before, so no region is parted
    into = F.when((F.col("position") % block < region) & (here > 0), F.array(here, here - 1)).otherwise(F.array(here))
    rows = rows.select("tree", F.explode(into).alias("block"), "position", "minima", "k1", "sketch")
    return rows.groupBy("tree", "block").applyInArrow(lambda t: _block_links(t, need, sizes), "src bigint, dst bigint")


# ---------------------------------------------------------------- links on full sets


def confirmed(sets: list[np.ndarray], sketches: np.ndarray, asking: np.ndarray, indexed: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between asking and indexed sets that connect what similarity connects, checked on whole sets."""
    need, size = agreement(percent), np.array([len(s) for s in sets], np.int64)
    # ascending by size, so that sizes which can't reach the similarity are a slice
    other = np.flatnonzero(indexed)
    other = other[np.argsort(size[other], kind="stable")]
    sizes, seen = size[other], sketches[other]
    group, links = np.arange(len(sets)), []
    for q in np.flatnonzero(asking):
        a, b = np.searchsorted(sizes, (-(-percent * size[q] // 100), 100 * size[q] // percent + 1))
        agree = np.count_nonzero(seen[a:b] == sketches[q], axis=1)
        near = np.flatnonzero(agree >= need)
        near = other[a + near[np.argsort(-agree[near], kind="stable")]]
        near = near[group[near] != group[q]]
        while len(near):
            k, near = near[0], near[1:]
            both = len(np.intersect1d(sets[q], sets[k], assume_unique=True))
            if 100 * both >= percent * (size[q] + size[k] - both):
                links.append((int(q), int(k)))
                x, y = sorted((group[q], group[k]))
                group[group == y] = x
                near = near[group[near] != x]
    return links


def _confirm_part(part: pa.Table, percent: int) -> pa.Table:
    """The clusters of a part, one by one."""
    part = part.sort_by("component")
    component, names = part.column("component").to_numpy(), part.column("k1").to_numpy()
    sets = [np.frombuffer(b, np.uint64) for b in part.column("shingles").to_pylist()]
    sketches = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(len(part), SKETCH)
    asking, indexed = (part.column(c).to_numpy() for c in ("asking", "indexed"))
    bounds = np.append(np.flatnonzero(np.append(True, component[1:] != component[:-1])), len(part))
    src, dst = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        for x, y in confirmed(sets[a:b], sketches[a:b], asking[a:b], indexed[a:b], percent):
            src.append(names[a + x])
            dst.append(names[a + y])
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def _confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """``rows``: (part, component, k1, shingles, sketch, asking, indexed)."""
    return rows.groupBy("part").applyInArrow(lambda t: _confirm_part(t, percent), "src bigint, dst bigint")


def similar_sets(docs: DataFrame, sets: DataFrame, words: int = WORDS, percent: int = PERCENT, shingles: int = SHINGLES, **sizes) -> DataFrame:
    """(node, component) of all sets with a partner.  ``docs``: (text); ``sets``: (k1, n_shingles, signature), each once."""
    clusters = components(candidate_links(sets, percent, **sizes))
    members = saved(clusters.withColumnRenamed("node", "k1").join(sets, "k1"))
    weights = saved(members.groupBy("component").agg(F.sum("n_shingles").alias("w"), F.count(F.lit(1)).alias("m")))
    total = weights.agg(F.sum("m").alias("m"), F.sum(F.when(F.col("w") <= shingles, F.col("w"))).alias("w")).collect()[0]
    named = saved(attached(members, weights, "component", "m", total["m"] or 0).select("k1", "component", "w", "signature"))
    whole = saved(_sets_of(docs, words, named.select("k1")).dropDuplicates(["k1"]).join(named, "k1"))
    whole = _with_sketch(whole)
    yes, no = F.lit(True), F.lit(False)
    hashed = lambda seed, n: F.pmod(F.xxhash64("k1", F.lit(seed)), n)
    part = lambda a, b, c: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), c.cast("bigint").alias("c")).alias("part")
    columns = ["component", "k1", "shingles", "sketch"]
    bins = max(1, -(-(total["w"] or 0) // shingles))
    one, zero = F.lit(-1), F.lit(0)
    small, large = whole.filter(F.col("w") <= shingles), whole.filter(F.col("w") > shingles)
    n = F.ceil(F.col("w") / shingles).cast("bigint")
    rows = small.select(part(F.pmod(F.xxhash64("component"), F.lit(bins)), one, zero), *columns, yes.alias("asking"), yes.alias("indexed"))
    rows = rows.unionByName(large.select(part(F.col("component"), zero, hashed(1, n)), *columns, yes.alias("asking"), no.alias("indexed")))
    leading = large.filter(hashed(2, n) == 0).select(F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("s"), *columns)
    rows = rows.unionByName(leading.select(part(F.col("component"), zero, F.col("s")), *columns, no.alias("asking"), yes.alias("indexed")))
    links = saved(_confirmed(rows, percent))
    if weights.filter(F.col("w") > shingles).isEmpty():
        return components(links)

    joined = components(links).select(F.col("node").alias("k1"), F.col("component").alias("found"))
    labelled = large.select("k1", "component", F.octet_length("shingles").alias("bytes")).join(joined, "k1", "left").withColumn("found", F.coalesce("found", "k1"))
    labelled = saved(labelled)
    held = labelled.groupBy("component", "found").agg(F.sum("bytes").alias("bytes"))
    largest = held.groupBy("component").agg(F.max(F.struct("bytes", "found")).alias("top"), F.sum("bytes").alias("all"))
    facts = saved(largest.select("component", F.col("top.found").alias("found"), F.ceil((F.col("all") - F.col("top.bytes")) / (8 * shingles)).cast("bigint").alias("slices")).join(weights.select("component", "m"), "component"))
    outside = saved(labelled.join(facts, ["component", "found"], "left_anti").select("k1"))
    asked = attached(large, facts.select("component", "slices", "m"), "component", "m", total["m"]).filter("slices > 0")
    seeking = asked.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("s"), hashed(1, n).alias("q"), *columns)
    seeking = seeking.select(part(F.col("component"), F.col("s") + 1, F.col("q")), *columns, yes.alias("asking"), no.alias("indexed"))
    found = asked.join(outside, "k1").select(hashed(3, F.col("slices")).alias("s"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("q"), *columns)
    found = found.select(part(F.col("component"), F.col("s") + 1, F.col("q")), *columns, no.alias("asking"), yes.alias("indexed"))
    more = saved(_confirmed(seeking.unionByName(found), percent))
    return components(links.unionByName(more))


def _with_sketch(rows: DataFrame) -> DataFrame:
    """The sketch in place of the signature: the low byte of each of its first minima."""
    hex_ = F.hex("signature")
    low = F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda k: F.substring(hex_, k * 8 + 1, F.lit(2)))
    return rows.withColumn("sketch", F.unhex(F.array_join(low, ""))).drop("signature")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, **sizes) -> DataFrame:
    """All rows, the text left out, with n_shingles, component_id (the least id that links reach) and kept (the id is that one).

    Two documents link when 100 * intersection >= percent * union of their shingle sets.  A
    text with fewer words than a shingle is one shingle; a null text or one without words
    has an empty set, links with nothing and keeps its own id.  Equal sets count once in the
    forest, and repeated rows link; among them the least id counts, null ids only where
    there is no other.  Texts of any length are read whole.  Links are confirmed on whole
    sets of 64-bit hashes.  A similar pair is missed where no tree has both in one region:
    with 16 trees and 3 minima, 3 in 10 million pairs at 0.85, fewer above.  An empty table
    gives an empty one; columns with the new names are replaced, and no other name clashes.
    """
    added = ["n_shingles", "component_id", "kept"]
    frame = unclashed(df, [c for c in added if c not in (doc_id, text)])
    keep = [c for c in frame.columns if c != text]
    docs = frame.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    own = saved(signed(docs, words))
    sets = saved(own.filter("signature IS NOT NULL").select("k1", "n_shingles", "signature").dropDuplicates(["k1"]))
    found = similar_sets(docs.select("text"), sets, words, percent, **sizes)

    names = own.filter("k1 IS NOT NULL").groupBy("k1").agg(F.count(F.lit(1)).alias("copies"), F.min(F.col(f"row.`{doc_id}`")).alias("least"))
    names = saved(names.join(found.select(F.col("node").alias("k1"), "component"), "k1", "left"))
    grouped = names.filter("component IS NOT NULL")
    least = saved(grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m")))
    n = least.agg(F.sum("m").alias("m")).collect()[0]["m"] or 0
    values = names.filter("component IS NULL").select("k1", "copies", F.col("least").alias("component_id")).unionByName(
        attached(grouped, least, "component", "m", n).select("k1", "copies", "component_id"))
    values = saved(values)
    n_rows = values.agg(F.sum("copies").alias("n")).collect()[0]["n"] or 0
    own_id = F.col(f"row.`{doc_id}`")
    linked = attached(own.filter("k1 IS NOT NULL").select("row", "n_shingles", "k1"), values, "k1", "copies", n_rows).select("row", "n_shingles", "component_id")
    alone = own.filter("k1 IS NULL").select("row", "n_shingles", own_id.alias("component_id"))
    return linked.unionByName(alone).select(*[F.col(f"row.`{c}`") for c in keep], "n_shingles", "component_id", own_id.eqNullSafe(F.col("component_id")).alias("kept"))


@query("op13_minhash_forest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
